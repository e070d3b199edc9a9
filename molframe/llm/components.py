"""Connected components over an edge table, as repeated joins; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import discard, written


def _nearest(edges: DataFrame, both: bool) -> DataFrame:
    """Each edge with the smallest node that its first end touches; ``both`` looks along both directions."""
    if both:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; ``edges`` has u > v."""
    large = _nearest(edges, True).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.filter("u <> v").distinct()
    near = _nearest(large, False)
    small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return small.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node it reaches.

    Large-star and small-star steps alternate until the edges no longer change; each round is written to the
    shared folder and replaces the one before. An empty table gives an empty result; loops and repeated links are harmless.
    """
    edges = written(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = None
    while True:
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(sums) or not sums[0]:
            break
        state = tuple(sums)
        last, edges = edges, written(_round(edges))
        discard(last)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
