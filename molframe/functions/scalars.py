"""Column helpers shared by the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.constants import ANGSTROM_TO_BOHR, MINMAX_EPS


def safe_double(value: Column) -> Column:
    """A number, or NULL for NaN and for what is no number."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def one_row(stats: DataFrame) -> Column:
    """A one-row aggregate as a struct value; it runs once and is inlined, no join is planned."""
    return stats.select(F.struct(*stats.columns)).scalar()


def min_max_score(value: Column, low: Column, high: Column, invert: bool = False) -> Column:
    """Position between low and high in [0, 1]; 0.5 when they coincide, NULL stays NULL."""
    width = high - low
    part = F.try_divide(value - low, width)
    part = 1.0 - part if invert else part
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))
    return F.when(value.isNotNull(), F.when(F.abs(width) <= MINMAX_EPS, 0.5).otherwise(clipped))


def quadrant(x: Column, y: Column, mx: Column, my: Column) -> Column:
    """High means at or above the median: Q1 high/high, Q2 low/high, Q3 low/low, Q4 high/low."""
    return (
        F.when((x >= mx) & (y >= my), "Q1")
        .when((x < mx) & (y >= my), "Q2")
        .when((x < mx) & (y < my), "Q3")
        .when(x.isNotNull() & y.isNotNull(), "Q4")
    )


def to_bohr(value: Column, unit: str) -> Column:
    if unit == "bohr":
        return value
    if unit in ("angstrom", "angs"):
        return value * F.lit(ANGSTROM_TO_BOHR)
    raise ValueError(f"unknown length unit {unit!r}")


def from_bohr(value: Column, unit: str) -> Column:
    if unit == "bohr":
        return value
    if unit in ("angstrom", "angs"):
        return value * F.lit(1.0 / ANGSTROM_TO_BOHR)
    raise ValueError(f"unknown length unit {unit!r}")
