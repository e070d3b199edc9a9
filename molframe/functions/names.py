"""Cleaning of file names that went through a wrong text encoding."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that betray UTF-8 read as a one-byte encoding, and the encodings tried.
MOJIBAKE_PROBES = "ÂÃÎÏÐÑâ"
ONE_BYTE_ENCODINGS = ("latin-1", "cp1252")
REPAIR_ROUNDS = 2
DROPPED_CATEGORIES = ("Cc", "Cf", "Cs")
PLAIN = r"\A[\x20-\x7e]*\z"


def _redecode(text: str) -> str | None:
    for encoding in ONE_BYTE_ENCODINGS:
        try:
            candidate = text.encode(encoding).decode("utf-8")
        except UnicodeError:
            continue
        if candidate and candidate != text:
            return candidate
    return None


def repair(text: str) -> str:
    if text.isascii() or not set(MOJIBAKE_PROBES) & set(text):
        return text
    for _ in range(REPAIR_ROUNDS):
        better = _redecode(text)
        if better is None:
            break
        text = better
    return text


def tidy(text: str) -> str:
    folded = unicodedata.normalize("NFKC", text)
    return "".join(c for c in folded if unicodedata.category(c) not in DROPPED_CATEGORIES).strip()


@F.pandas_udf(T.StringType())
def _repair_and_tidy(names: pd.Series) -> pd.Series:
    return names.map(lambda s: tidy(repair(s)), na_action="ignore")


@F.pandas_udf(T.StringType())
def _repair_only(names: pd.Series) -> pd.Series:
    return names.map(repair, na_action="ignore")


@F.pandas_udf(T.StringType())
def _fold_only(names: pd.Series) -> pd.Series:
    return names.map(lambda s: unicodedata.normalize("NFKC", s).strip(), na_action="ignore")


@F.pandas_udf(T.StringType())
def _casefold(names: pd.Series) -> pd.Series:
    return names.map(str.casefold, na_action="ignore")


def _only_where_needed(name: Column, udf) -> Column:
    """Printable ASCII only needs trimming, in the JVM; Python sees NULL for it."""
    return F.when(name.rlike(PLAIN), F.trim(name)).otherwise(udf(F.when(~name.rlike(PLAIN), name)))


def clean_name(name: Column) -> Column:
    return F.coalesce(_only_where_needed(name, _repair_and_tidy), F.lit(""))


def folded_name(name: Column) -> Column:
    return F.coalesce(_only_where_needed(name, _fold_only), F.lit(""))


def casefold(name: Column) -> Column:
    return F.when(name.rlike(PLAIN), F.lower(name)).otherwise(_casefold(F.when(~name.rlike(PLAIN), name)))


def _last_suffix(name: Column) -> Column:
    """The part from the last dot on, unless only dots stand before it."""
    return F.lower(F.regexp_extract(name, r"^(?s)\.*[^.].*?(\.[^.]*)\z", 1))


def file_extension(cleaned: Column, raw: Column) -> Column:
    """Lower-case extension of a cleaned name; non-ASCII remains fall back to the repaired raw name."""
    plain = r"\A[A-Za-z0-9.]+\z"
    first = _last_suffix(cleaned)
    repaired = _last_suffix(
        F.when(raw.rlike(PLAIN), raw).otherwise(_repair_only(F.when(~raw.rlike(PLAIN), raw)))
    )
    tail = F.regexp_replace(first, "[^A-Za-z0-9.]", "")
    return (
        F.when(first.rlike(plain), first)
        .when(repaired.rlike(plain), repaired)
        .when(tail.rlike(r"\A\.[A-Za-z0-9.]+\z"), tail)
        .otherwise(first)
    )
