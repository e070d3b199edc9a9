"""Run-to-run comparison of a stored grid with the field of a wavefunction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.functions.scalars import to_bohr
from molframe.operators.compare import LOW_RDG, TRIM_QUANTILE, agreement, align_grids
from molframe.operators.density import field
from molframe.operators.grid import completeness
from molframe.sources.grids import require_field


def checked_reference(points: DataFrame, unit: str = "angstrom") -> DataFrame:
    """Reference rows in bohr; fails if any grid is not a complete product of its axes."""
    rows = require_field(points).withColumns({c: to_bohr(F.col(c), unit) for c in "xyz"})
    torn = completeness(rows).filter(~F.col("complete")).limit(5).collect()
    if torn:
        raise ValueError(f"not a complete regular grid: {[r['mol_id'] for r in torn]}")
    return rows


def compare_grids(
    reference: DataFrame,
    predicted: DataFrame,
    unit: str = "angstrom",
    trim_quantile: float = TRIM_QUANTILE,
    low_rdg: float = LOW_RDG,
) -> DataFrame:
    """Agreement by subset; ``predicted`` is keyed by grid index, as :func:`density.field` yields it."""
    return agreement(align_grids(checked_reference(reference, unit), predicted), trim_quantile, low_rdg)


def reference_specs(points: DataFrame) -> DataFrame:
    """The regular grid behind complete reference rows, one row per molecule."""
    ends = [f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    sized = completeness(points).join(points.groupBy("mol_id").agg(*ends), "mol_id")
    step = lambda c: F.when(
        F.col(f"n{c}") > 1, (F.col(f"hi{c}") - F.col(f"lo{c}")) / F.when(F.col(f"n{c}") > 1, F.col(f"n{c}") - 1)
    ).otherwise(F.col("spacing"))
    return sized.select(
        "mol_id", "nx", "ny", "nz",
        F.col("spacing").alias("h"),
        *[F.col(f"lo{c}").alias(f"{c}0") for c in "xyz"],
        *[step(c).alias(f"h{c}") for c in "xyz"],
    )


def compare_wavefunctions(
    reference: DataFrame,
    wf: DataFrame,
    unit: str = "angstrom",
    normalise: bool = False,
    trim_quantile: float = TRIM_QUANTILE,
    low_rdg: float = LOW_RDG,
) -> DataFrame:
    """Evaluate the wavefunctions on the reference's own grid points and report the agreement."""
    rows = checked_reference(reference, unit)
    predicted = field(wf, normalise=normalise, specs=reference_specs(rows))
    return agreement(align_grids(rows, predicted), trim_quantile, low_rdg)
