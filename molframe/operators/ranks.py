"""Average ranks over whole tables, and rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.session import materialise


def ranked(
    counted: DataFrame, keys: list[str], value: str, counts: dict[str, str], ranges: int | None = None
) -> DataFrame:
    """``(keys, value, counts, ranks)``: for each count column the average rank of each distinct value.

    ``counted`` has one row per key and value, and ``counts`` names the rank of each count column. Values are
    cut into ranges by Spark's range partitioning (``ranges``, or the session's number of partitions); positions
    are counted inside a range and added to one total per earlier range, so no task orders a whole group.
    """
    columns = [F.col(c) for c in (*keys, value)]
    cut = counted.repartitionByRange(ranges, *columns) if ranges else counted.repartitionByRange(*columns)
    placed = materialise(cut.withColumn("_range", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_{c}") for c in counts])
    earlier = before(Window.partitionBy(*keys).orderBy("_range"))
    offsets = totals.select(
        *keys, "_range", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in counts]
    )
    inside = before(Window.partitionBy(*keys, "_range").orderBy(value))
    rank = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{c}") + (F.col(c) + 1) / 2
    return placed.join(offsets, [*keys, "_range"]).select(
        *keys, value, *counts, *[rank(c).alias(name) for c, name in counts.items()]
    )


def average_ranks(df: DataFrame, value: str, group: str, ranges: int | None = None) -> DataFrame:
    """``(group, value, cnt, rank)`` per distinct value: ties share the mean of their positions.

    Equal values are counted before anything is ordered, so a value that fills a third of the table is one row.
    """
    counted = df.groupBy(group, value).agg(F.count("*").alias("cnt"))
    return ranked(counted, [group], value, {"cnt": "rank"}, ranges)


def pearson(x: Column, y: Column) -> Column:
    """Correlation, NULL for constant input (the built-in ``corr`` raises there in ANSI mode)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def rank_correlations(
    rows: DataFrame, fields: dict[str, tuple[str, str]], masks: dict[str, Column], ranges: int | None = None
) -> DataFrame:
    """``(subset, spearman_<field>...)``: Spearman's correlation of each field's two columns, ranked within each subset.

    A row is laid out once per field. One table counts every distinct value for all subsets side by side, so a
    single ordering ranks all of them. Ranks come back in one join per side; a value that holds a large share of
    the rows is one rank row, and adaptive execution splits the crowd it meets. A subset without rows has NULLs.
    """
    marks = [f"m{i}" for i in range(len(masks))]
    flags = rows.withColumns({m: F.coalesce(c, F.lit(False)) for m, c in zip(marks, masks.values(), strict=True)})
    each = [
        F.struct(F.lit(f).alias("field"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        for f, (x, y) in fields.items()
    ]
    laid = flags.select(F.explode(F.array(*each)).alias("_e"), *marks).select("_e.*", *marks)
    laid = materialise(laid.filter(F.col("x").isNotNull() & F.col("y").isNotNull()))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("value")) for s in "xy"])
    counted = (
        laid.select("field", F.explode(sides).alias("_s"), *marks)
        .groupBy("field", "_s.side", "_s.value")
        .agg(*[F.count_if(m).alias(f"n_{m}") for m in marks])
    )
    ranks = materialise(ranked(counted, ["field", "side"], "value", {f"n_{m}": f"r_{m}" for m in marks}, ranges))
    for s in "xy":
        own = ranks.filter(F.col("side") == s).select(
            "field", F.col("value").alias(s), *[F.col(f"r_{m}").alias(f"{s}_{m}") for m in marks]
        )
        laid = laid.join(own, ["field", s])
    within = lambda s, m: F.when(F.col(m), F.col(f"{s}_{m}"))
    found = laid.groupBy("field").agg(*[pearson(within("x", m), within("y", m)).alias(m) for m in marks])
    labels = F.array(*[F.struct(F.lit(n).alias("subset"), F.col(m).alias("r")) for n, m in zip(masks, marks, strict=True)])
    tall = found.select("field", F.explode(labels).alias("_l")).select("field", "_l.*")
    return tall.groupBy("subset").agg(
        *[F.max(F.when(F.col("field") == f, F.col("r"))).alias(f"spearman_{f}") for f in fields]
    )
