"""Agreement of a predicted grid with a reference grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.functions.scalars import one_row
from molframe.operators.grid import axis_index, axis_values
from molframe.operators.quantiles import exact_quantiles, smallest_rows
from molframe.operators.ranks import rank_correlations

LOW_RDG = 2.0
TRIM_QUANTILE = 0.999
SUBSETS = ("all", "attractive", "trimmed", "low_rdg")
HISTOGRAM_BINS = 120


def with_axis_indices(points: DataFrame, key: str = "mol_id") -> DataFrame:
    """Add ``ix, iy, iz``: positions among the distinct coordinates of each axis.

    An axis table has as many rows as the axis has planes; the runtime broadcasts it while it is small.
    """
    places = axis_index(axis_values(points, key), key)
    for c in "xyz":
        one = places.filter(F.col("axis") == c).select(key, F.col("v").alias(c), F.col("i").alias(f"i{c}"))
        points = points.join(one, [key, c])
    return points


def align_grids(reference: DataFrame, predicted: DataFrame, key: str = "mol_id") -> DataFrame:
    """``(key, ix, iy, iz, x, y, z, sl2_ref, rdg_ref, sl2_pred, rdg_pred)``.

    The reference has coordinates, the prediction indices; they meet on indices.
    """
    ref = with_axis_indices(reference, key).select(
        key, "ix", "iy", "iz", "x", "y", "z",
        F.col("sl2rho").alias("sl2_ref"), F.col("rdg").alias("rdg_ref"),
    )
    pred = predicted.select(
        key, "ix", "iy", "iz", F.col("sl2rho").alias("sl2_pred"), F.col("rdg").alias("rdg_pred")
    )
    return ref.join(pred, [key, "ix", "iy", "iz"])


def trim_bounds(pairs: DataFrame, q: float = TRIM_QUANTILE) -> tuple[float | None, float | None]:
    """Exact quantiles of the reference's rdg and absolute signed density."""
    found = exact_quantiles(pairs, {"r": (F.col("rdg_ref"), q), "s": (F.abs("sl2_ref"), q)})
    return found["r"], found["s"]


def subset_masks(bounds: tuple[float | None, float | None], low_rdg: float = LOW_RDG) -> dict[str, Column]:
    """Membership by subset, judged on the reference grid only."""
    rdg, size = (F.lit(b).cast("double") for b in bounds)
    return {
        "all": F.lit(True),
        "attractive": F.col("sl2_ref") < 0,
        "trimmed": (F.col("rdg_ref") <= rdg) & (F.abs("sl2_ref") <= size),
        "low_rdg": F.col("rdg_ref") <= low_rdg,
    }


def with_trim_mask(pairs: DataFrame, q: float = TRIM_QUANTILE) -> DataFrame:
    """Add ``trimmed``: inside both quantiles."""
    return pairs.withColumn("trimmed", subset_masks(trim_bounds(pairs, q))["trimmed"])


def _metrics(mask: Column, ref: str, pred: str, name: str) -> list[Column]:
    a, b = F.when(mask, F.col(ref)), F.when(mask, F.col(pred))
    return [
        # NULL for constant input; both columns are NULL outside the mask.
        F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"pearson_{name}"),
        F.avg(F.abs(a - b)).alias(f"mae_{name}"),
        F.sqrt(F.avg((a - b) * (a - b))).alias(f"rmse_{name}"),
    ]


def subset_metrics(pairs: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """One row per subset: n, Pearson, MAE and RMSE of both fields; one pass, four groups.

    A point is repeated once per subset it belongs to and merged again before the shuffle.
    """
    labels = F.array_compact(F.array(*[F.when(mask, F.lit(name)) for name, mask in masks.items()]))
    spread = pairs.select("sl2_ref", "sl2_pred", "rdg_ref", "rdg_pred", F.explode(labels).alias("subset"))
    values = [F.count("*").alias("n")]
    for ref, pred, field in (("sl2_ref", "sl2_pred", "sl2rho"), ("rdg_ref", "rdg_pred", "rdg")):
        values += _metrics(F.col(ref).isNotNull() & F.col(pred).isNotNull(), ref, pred, field)
    found = spread.groupBy("subset").agg(*values)
    # An empty subset keeps its row.
    names = F.array(*[F.lit(n) for n in masks])
    wanted = pairs.sparkSession.range(1).select(F.explode(names).alias("subset"))
    return wanted.join(found, "subset", "left").fillna(0, subset=["n"])


def subset_spearman(pairs: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """``(subset, spearman_sl2rho, spearman_rdg)``; every subset ranks its own points."""
    return rank_correlations(pairs, {"sl2rho": ("sl2_ref", "sl2_pred"), "rdg": ("rdg_ref", "rdg_pred")}, masks)


def agreement(pairs: DataFrame, q: float = TRIM_QUANTILE, low_rdg: float = LOW_RDG) -> DataFrame:
    """All nine metrics for the four subsets."""
    masks = subset_masks(trim_bounds(pairs, q), low_rdg)
    return subset_metrics(pairs, masks).join(subset_spearman(pairs, masks), "subset", "left")


def sample_points(pairs: DataFrame, n: int = 250_000, seed: int = 7, order: Column | None = None, tie: str = "id") -> DataFrame:
    """A repeatable sample without replacement, by a seeded hash of ``tie``; everything when ``n`` covers it."""
    order = F.xxhash64(F.col(tie), F.lit(seed)) if order is None else order
    return smallest_rows(pairs, order, tie, n)


def overlay_extract(pairs: DataFrame, low_rdg: float = LOW_RDG) -> DataFrame:
    """Points whose rdg is low on both grids."""
    return pairs.filter((F.col("rdg_ref") <= low_rdg) & (F.col("rdg_pred") <= low_rdg))


def clip_pairs(pairs: DataFrame, q: float = TRIM_QUANTILE) -> DataFrame:
    """Points inside the quantile of all four quantities."""
    sizes = {
        "a": F.abs("sl2_ref"), "b": F.abs("sl2_pred"), "c": F.col("rdg_ref"), "d": F.col("rdg_pred"),
    }
    found = exact_quantiles(pairs, {n: (c, q) for n, c in sizes.items()})
    inside = F.lit(True)
    for name, column in sizes.items():
        inside = inside & (column <= F.lit(found[name]).cast("double"))
    return pairs.filter(inside)


def parity_histogram(pairs: DataFrame, x: str, y: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``(bx, by, count)`` on ``bins`` equal steps between each quantity's extremes."""
    edges = one_row(
        pairs.agg(*[f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    )
    place = lambda c: F.coalesce(
        F.least(
            F.floor(F.try_divide((F.col(c) - edges[f"lo_{c}"]) * bins, edges[f"hi_{c}"] - edges[f"lo_{c}"])),
            F.lit(bins - 1),
        ),
        F.lit(0),
    ).cast("int")
    return pairs.groupBy(place(x).alias("bx"), place(y).alias("by")).agg(F.count("*").alias("count"))
