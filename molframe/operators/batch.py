"""Whole batches: run status, summaries, normalisation and median quadrants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.functions.scalars import min_max_score, one_row, quadrant, safe_double
from molframe.operators.quantiles import exact_quantiles

QUADRANTS = ("Q1", "Q2", "Q3", "Q4")


def resolve_status(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Attach results to runs. A successful run without a result, or with an unreadable one, has failed.

    ``results`` holds one row per molecule with a boolean ``readable``; its other columns are carried
    along for readable results of successful runs.
    """
    payload = [c for c in results.columns if c not in ("mol_id", "readable")]
    found = results.select("mol_id", "readable", *payload)
    claimed = F.col("status") == "success"
    good = claimed & F.coalesce("readable", F.lit(False))
    error = (
        F.when(claimed & F.col("readable").isNull(), "Missing result")
        .when(claimed & ~F.col("readable"), "Failed to read result")
        .otherwise(F.col("error"))
    )
    status = F.when(claimed & ~good, "failed").otherwise(F.col("status"))
    kept = [c for c in runs.columns if c not in ("mol_id", "status", "error")]
    return runs.join(found, "mol_id", "left").select(
        "mol_id", *kept, status.alias("status"), error.alias("error"),
        *[F.when(good, F.col(c)).alias(c) for c in payload],
    )


def _summary_columns(total_time: Column) -> list[Column]:
    count = lambda cond: F.count_if(cond)
    return [
        F.count("*").alias("total_files"),
        count(F.col("status") == "success").alias("successful_files"),
        count(~F.col("status").isin("success", "stopped")).alias("failed_files"),
        count(F.col("status") == "stopped").alias("stopped_files"),
        F.round(total_time, 4).alias("total_time_seconds"),
    ]


def batch_summary(records: DataFrame, total_time: float | None = None, by: str | None = None) -> DataFrame:
    """Counts per outcome and total time: the given wall time, or else the summed elapsed seconds."""
    seconds = F.lit(float(total_time)) if total_time is not None else F.coalesce(
        F.sum("elapsed_seconds"), F.lit(0.0)
    )
    groups = records.groupBy(by) if by else records.groupBy()
    return groups.agg(*_summary_columns(seconds))


def throughput(summary: DataFrame) -> DataFrame:
    """Finished molecules per hour and seconds per finished molecule; stopped ones do not count."""
    done = F.greatest(F.col("total_files") - F.col("stopped_files"), F.lit(0))
    seconds = F.col("total_time_seconds")
    return summary.select(
        "*",
        F.when(seconds > 0, done / F.when(seconds > 0, seconds) * 3600)
        .otherwise(0.0)
        .alias("molecules_per_hour"),
        F.when(done > 0, seconds / F.when(done > 0, done)).otherwise(0.0).alias("seconds_per_molecule"),
    )


def normalise(records: DataFrame) -> DataFrame:
    """Add ``snci_norm``, ``scdi_norm`` and ``scdi_source`` to the successful records.

    The fixed-bound score is used only if every successful record has it; otherwise the variance is
    min-max scaled and inverted.
    """
    rows = records.filter("status = 'success'")
    for name in ("snci", "scdi", "scdi_variance"):
        rows = rows.withColumn(name, safe_double(F.col(name)))
    stats = one_row(
        rows.agg(
            F.min("snci").alias("s_lo"),
            F.max("snci").alias("s_hi"),
            F.min("scdi_variance").alias("v_lo"),
            F.max("scdi_variance").alias("v_hi"),
            F.coalesce(F.bool_and(F.col("scdi").isNotNull()), F.lit(False)).alias("complete"),
        )
    )
    fixed = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("scdi")))
    scaled = min_max_score(F.col("scdi_variance"), stats["v_lo"], stats["v_hi"], invert=True)
    return rows.select(
        "*",
        min_max_score(F.col("snci"), stats["s_lo"], stats["s_hi"]).alias("snci_norm"),
        F.when(stats["complete"], fixed).otherwise(scaled).alias("scdi_norm"),
        F.when(stats["complete"], "scdi").otherwise("inverse_variance").alias("scdi_source"),
    )


def norm_medians(normed: DataFrame) -> tuple[float | None, float | None]:
    """Exact medians of both scores over the rows that have both."""
    both = F.col("snci_norm").isNotNull() & F.col("scdi_norm").isNotNull()
    found = exact_quantiles(
        normed,
        {n: (F.when(both, F.col(n)), 0.5) for n in ("snci_norm", "scdi_norm")},
    )
    return found["snci_norm"], found["scdi_norm"]


def quadrants(normed: DataFrame, medians: tuple[float | None, float | None] | None = None) -> DataFrame:
    """Add ``quadrant`` by the medians; rows that lack a score get none."""
    mx, my = norm_medians(normed) if medians is None else medians
    label = quadrant(
        F.col("snci_norm"), F.col("scdi_norm"), F.lit(mx).cast("double"), F.lit(my).cast("double")
    )
    return normed.withColumn("quadrant", label)


def quadrant_head(normed: DataFrame, medians: tuple[float | None, float | None] | None = None) -> DataFrame:
    """One row from which the quadrants can be drawn again: where the second score comes from, both medians, rows with both."""
    mx, my = norm_medians(normed) if medians is None else medians
    both = F.col("snci_norm").isNotNull() & F.col("scdi_norm").isNotNull()
    return normed.agg(F.max("scdi_source").alias("scdi_source"), F.count_if(both).alias("labelled")).select(
        "scdi_source", F.lit(mx).cast("double").alias("snci_median"), F.lit(my).cast("double").alias("scdi_median"), "labelled"
    )


def quadrant_tally(labelled: DataFrame) -> DataFrame:
    """``(quadrant, count)``, all four present. The file lists are the labelled rows themselves."""
    counts = labelled.agg(*[F.count_if(F.col("quadrant") == q).alias(q) for q in QUADRANTS])
    pairs = F.array(*[F.struct(F.lit(q).alias("quadrant"), F.col(q).alias("count")) for q in QUADRANTS])
    return counts.select(F.inline(pairs))


def pending_inputs(inputs: DataFrame, results: DataFrame, force: bool = False) -> DataFrame:
    """Inputs that still need work: those without a result, or all of them when forced."""
    return inputs if force else inputs.join(results.select("mol_id"), "mol_id", "left_anti")


def best_setting(timing: DataFrame) -> DataFrame:
    """Of the newest metrics file with a positive time, the setting with the smallest one.

    ``timing`` holds ``(file, modified, setting, seconds)``; equal times go to the smaller setting.
    """
    valid = timing.filter("seconds > 0")
    per_file = valid.groupBy("file").agg(
        F.max("modified").alias("modified"),
        F.min_by("setting", F.struct("seconds", "setting")).alias("setting"),
        F.min("seconds").alias("seconds"),
    )
    newest = F.max_by(F.struct("file", "setting", "seconds"), F.struct("modified", "file"))
    return per_file.agg(newest.alias("_b")).filter("_b is not null").select("_b.*")


def timing_statistics(timing: DataFrame, baseline: str, points: str | None = None) -> DataFrame:
    """Per method mean, extremes and population deviation, and how much faster it is than ``baseline``."""
    work = [F.sum(points).alias("_points")] if points else []
    stats = timing.groupBy("method").agg(
        F.count("*").alias("runs"),
        F.avg("seconds").alias("mean"),
        F.min("seconds").alias("lowest"),
        F.max("seconds").alias("highest"),
        F.stddev_pop("seconds").alias("deviation"),
        F.sum("seconds").alias("_total"),
        *work,
    )
    reference = timing.filter(F.col("method") == baseline).agg(F.avg("seconds")).scalar()
    rate = [F.try_divide("_points", "_total").alias("points_per_second")] if points else []
    return stats.select(
        "method", "runs", "mean", "lowest", "highest", "deviation",
        F.try_divide(reference, F.col("mean")).alias("speedup"), *rate,
    )
