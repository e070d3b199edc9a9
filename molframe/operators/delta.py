"""Differences between a variant run and its reference run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.constants import BATCH_METRICS, SINGLE_METRICS

SUMMARY_METRICS = (
    "total_files", "successful_files", "failed_files", "stopped_files", "total_time_seconds",
)


def vector_metrics(metrics=SINGLE_METRICS) -> list[Column]:
    """Metric columns from a descriptor record ``(snci, scdi, scdi_variance, f, ...)``; NULL past the end."""
    source = {"SNCI": "snci", "SCDI": "scdi", "SCDI_variance": "scdi_variance"}
    columns = []
    for key, _, _ in metrics:
        if key.startswith("f"):
            columns.append(F.get("f", F.lit(int(key[1:]) - 1)).alias(key))
        else:
            columns.append(F.col(source.get(key, key.lower())).cast("double").alias(key))
    return columns


def keep_last(records: DataFrame, key: str, order: str) -> DataFrame:
    """One record per key, the last by ``order``; merged map-side, so duplicates never meet in one task."""
    rest = [c for c in records.columns if c != key]
    return (
        records.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(F.struct(*rest), order).alias("_r"))
        .select(key, "_r.*")
    )


def _long(metrics, reference: str, variant: str) -> Column:
    """One struct per metric; the deltas need no join, the metric texts are literals."""
    rows = []
    for key, label, unit in metrics:
        old, new = F.col(f"{reference}.{key}"), F.col(f"{variant}.{key}")
        rows.append(
            F.struct(
                F.lit(key).alias("metric"),
                F.lit(label).alias("label"),
                F.lit(unit or None).cast("string").alias("unit"),
                old.cast("double").alias("reference"),
                new.cast("double").alias("variant"),
                (new.cast("double") - old.cast("double")).alias("delta"),
            )
        )
    return F.array(*rows)


def _packed(records: DataFrame, key: str, metrics, name: str) -> DataFrame:
    return records.select(
        key, F.struct(*[F.col(m).cast("double").alias(m) for m, _, _ in metrics]).alias(name)
    )


def compare_runs(reference: DataFrame, variant: DataFrame, key: str = "mol_id", metrics=BATCH_METRICS) -> DataFrame:
    """``(key, metric, label, unit, reference, variant, delta)`` for the union of both key sets.

    Both sides hold one row per key (see :func:`keep_last`) with a column per metric.
    """
    joined = _packed(reference, key, metrics, "_ref").join(
        _packed(variant, key, metrics, "_var"), key, "full_outer"
    )
    return joined.select(key, F.inline(_long(metrics, "_ref", "_var")))


def compare_to_baseline(
    variant: DataFrame, baseline: DataFrame, key: str = "mol_id", metrics=SINGLE_METRICS
) -> DataFrame:
    """As :func:`compare_runs` for the variant's keys only, with ``reference_found``."""
    joined = _packed(variant, key, metrics, "_var").join(
        _packed(baseline, key, metrics, "_ref"), key, "left"
    )
    return joined.select(
        key, F.col("_ref").isNotNull().alias("reference_found"), F.inline(_long(metrics, "_ref", "_var"))
    )


def summary_delta(reference: DataFrame, variant: DataFrame) -> DataFrame:
    """``(metric, reference, variant, delta)`` of two one-row batch summaries."""
    metrics = [(m, m, "") for m in SUMMARY_METRICS]
    one = F.lit(1).alias("_one")
    both = _packed(variant.select("*", one), "_one", metrics, "_var").join(
        _packed(reference.select("*", one), "_one", metrics, "_ref"), "_one", "left"
    )
    return both.select(F.inline(_long(metrics, "_ref", "_var"))).select(
        "metric", "reference", "variant", "delta"
    )
