"""Charge variance over surface segments, with detection of the area and charge columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (area, charge) column candidates in order of preference, fallback pair, needed share.
ROLE_CANDIDATES = ((6, 5), (5, 6), (7, 5), (5, 7), (6, 7), (7, 6))
FALLBACK_ROLE = 0
POSITIVE_SHARE = 0.95


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _weighted_sums(area: Column, charge: Column, pivot: Column, tag: str) -> list[Column]:
    """Sums of a, a(q - p) and a(q - p)² over the valid segments; the pivot p keeps the digits of close charges."""
    ok = _finite(area) & _finite(charge) & (area > 0)
    a, q = F.when(ok, area), F.when(ok, charge - F.coalesce(pivot, F.lit(0.0)))
    return [
        F.sum(a).alias(f"_w{tag}"),
        F.sum(a * q).alias(f"_s{tag}"),
        F.sum(a * q * q).alias(f"_t{tag}"),
    ]


def _variance(tag: str) -> Column:
    w, s, t = (F.col(f"_{n}{tag}") for n in "wst")
    mean = F.try_divide(s, w)
    return F.coalesce(F.greatest(F.lit(0.0), F.try_divide(t, w) - mean * mean), F.lit(0.0))


def _pivot(charge: Column, valid: Column) -> Column:
    """The plain mean of the valid charges: near enough to the weighted mean for sums around it to be exact."""
    return F.avg(F.when(_finite(charge) & valid, charge))


def weighted_variance(segments: DataFrame) -> DataFrame:
    """``(mol_id, variance)`` of ``charge`` weighted by ``area``; 0 without a valid segment.

    Two aggregations of plain sums: the mean charge of a molecule, then sums around it.
    """
    pivots = segments.groupBy("mol_id").agg(_pivot(F.col("charge"), _finite(F.col("area")) & (F.col("area") > 0)).alias("_p"))
    sums = _weighted_sums(F.col("area"), F.col("charge"), F.col("_p"), "")
    joined = segments.select("mol_id", "area", "charge").join(pivots, "mol_id")
    return joined.groupBy("mol_id").agg(*sums).select("mol_id", _variance("").alias("variance"))


def _role_sums() -> list[Column]:
    sums = []
    for i in (5, 6, 7):
        v = F.get("v", F.lit(i))
        positive = F.when(~F.isnan(v) & (v > 0), 1.0).otherwise(0.0)
        sums += [
            F.avg(positive).alias(f"_pos{i}"),
            F.avg(v).alias(f"_mean{i}"),
            F.avg(F.abs(v)).alias(f"_abs{i}"),
        ]
    return sums


def _best_role() -> Column:
    """Index of the best candidate: share of positive areas, mean area, small charge, near columns."""
    scores = []
    for rank, (a, q) in enumerate(ROLE_CANDIDATES):
        share, mean, size = F.col(f"_pos{a}"), F.col(f"_mean{a}"), F.col(f"_abs{q}")
        fits = (share >= POSITIVE_SHARE) & (mean > 0) & ~F.isnan(mean) & ~F.isnan(size)
        score = F.struct(
            share.alias("share"),
            mean.alias("mean"),
            (-size).alias("size"),
            F.lit(-abs(a - q)).alias("gap"),
            F.lit(-rank).alias("order"),
        )
        scores.append(F.when(fits, score))
    best = F.array_max(F.array_compact(F.array(*scores)))
    return F.coalesce(-best["order"], F.lit(FALLBACK_ROLE))


def _pick(values: list[Column], index: Column) -> Column:
    return F.element_at(F.array(*values), index + 1)


def segment_roles(segments: DataFrame) -> DataFrame:
    """``(mol_id, area_col, charge_col)`` from segment rows ``(mol_id, v)``, in one aggregation."""
    return (
        segments.groupBy("mol_id")
        .agg(*_role_sums())
        .select("mol_id", _best_role().alias("_r"))
        .select(
            "mol_id",
            _pick([F.lit(a) for a, _ in ROLE_CANDIDATES], F.col("_r")).alias("area_col"),
            _pick([F.lit(q) for _, q in ROLE_CANDIDATES], F.col("_r")).alias("charge_col"),
        )
    )


def bounded_score(variance: Column, low: float | None, high: float | None) -> Column:
    """``1 - (variance - low) / (high - low)`` clipped to [0, 1]; NULL unless low < high are both given."""
    if low is None or high is None or high <= low:
        return F.lit(None).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - (variance - low) / (high - low)))


def surface_terms(segments: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """``(mol_id, scdi_variance, scdi)``: one aggregation for roles and mean charges, one for all candidates' sums.

    Only the three columns that can be area or charge matter.
    """
    columns = sorted({q for _, q in ROLE_CANDIDATES})
    first = segments.groupBy("mol_id").agg(*_role_sums(), *(_pivot(F.get("v", F.lit(q)), F.lit(True)).alias(f"_p{q}") for q in columns))
    roles = first.select("mol_id", _best_role().alias("_r"), *(f"_p{q}" for q in columns))
    sums = [F.first("_r").alias("_r")]
    for i, (a, q) in enumerate(ROLE_CANDIDATES):
        sums += _weighted_sums(F.get("v", F.lit(a)), F.get("v", F.lit(q)), F.col(f"_p{q}"), str(i))
    variance = _pick([_variance(str(i)) for i in range(len(ROLE_CANDIDATES))], F.col("_r"))
    valid = _pick([F.col(f"_w{i}").isNotNull() for i in range(len(ROLE_CANDIDATES))], F.col("_r"))
    return (
        segments.select("mol_id", "v")
        .join(roles, "mol_id")
        .groupBy("mol_id")
        .agg(*sums)
        .select("mol_id", variance.alias("scdi_variance"), valid.alias("_valid"))
        .select(
            "mol_id",
            "scdi_variance",
            F.when(F.col("_valid"), bounded_score(F.col("scdi_variance"), low, high)).alias("scdi"),
        )
    )
