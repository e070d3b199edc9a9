"""Text inputs: one row per file for record-like formats, one row per line for large row-oriented ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_key() -> Column:
    """The path of a row's file as it is written, with what the scan encodes (blanks, %, #) taken back."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(mol_id, text, modified)``: every file whole, keyed by its full path. Nothing is shuffled to read it."""
    docs = spark.read.text(path, wholetext=True)
    modified = F.col("_metadata.file_modification_time").alias("modified")
    return docs.select(file_key().alias("mol_id"), F.col("value").alias("text"), modified)


def read_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(mol_id, line)``: splittable, for files whose lines stand on their own."""
    rows = spark.read.text(path)
    return rows.select(file_key().alias("mol_id"), F.col("value").alias("line"))


def lines_of(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def tokens_of(line: Column) -> Column:
    """Whitespace-separated tokens; an empty line has the single token ''."""
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def to_double(token: Column) -> Column:
    """A number, or NULL. Type suffixes that a cast would accept (``1.5d``) are not numbers here."""
    return F.when(~token.rlike(r"[0-9.][dDfF]\s*\z"), token.try_cast("double"))


def to_double_fortran(token: Column) -> Column:
    """As :func:`to_double`, with D allowed as the exponent mark."""
    return to_double(F.regexp_replace(token, "[Dd]", "E"))


def to_int(token: Column) -> Column:
    return F.when(token.rlike(r"\A[+-]?\d+\z"), token.try_cast("int"))


def fix_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions read instead of repeating.

    The optimizer merges neighbouring projections and would copy a column's expression into every place
    that uses it, lambdas included; a one-element generator computes it once per row.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
