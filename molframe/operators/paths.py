"""Resolution of requested paths against a listing with slightly different names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.functions.names import casefold, clean_name, folded_name


def _parent() -> Column:
    return F.regexp_extract("path", r"^(.*)/[^/]*$", 1)


def _keys(df: DataFrame) -> DataFrame:
    """One row per distinct non-empty match key of the path's last part."""
    name = F.element_at(F.split("path", "/"), -1)
    named = df.withColumn("_p", _parent()).withColumn("_n", name)
    keys = F.array_distinct(
        F.array(casefold(clean_name(F.col("_n"))), casefold(folded_name(F.col("_n"))))
    )
    return (
        named.withColumn("_keys", keys)
        .withColumn("_key", F.explode("_keys"))
        .filter("_key <> ''")
        .drop("_keys", "_n")
    )


def resolve_paths(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """``(path, resolved, how)`` for distinct wanted paths: exact entry, else matching sibling, else as given.

    ``listing`` holds ``(path, pos)``; of several matching siblings the first in the listing is taken.
    The join key is the parent and the name key, so a huge folder is no hot key.
    """
    exact = wanted.join(listing.select("path"), "path", "left_semi").select("path", F.lit(True).alias("_exact"))
    entries = _keys(listing.select("path", "pos")).select(
        "_p", "_key", F.col("path").alias("candidate"), "pos"
    )
    first = entries.groupBy("_p", "_key").agg(
        F.min_by(F.struct("candidate", "pos"), "pos").alias("_c")
    )
    matched = (
        _keys(wanted.select("path"))
        .join(first, ["_p", "_key"])
        .groupBy("path")
        .agg(F.min_by("_c.candidate", "_c.pos").alias("_match"))
    )
    return (
        wanted.select("path")
        .join(exact, "path", "left")
        .join(matched, "path", "left")
        .select(
            "path",
            F.when(F.col("_exact"), F.col("path")).otherwise(F.coalesce("_match", "path")).alias("resolved"),
            F.when(F.col("_exact"), "exact")
            .when(F.col("_match").isNotNull(), "matched")
            .otherwise("unresolved")
            .alias("how"),
        )
    )
