"""Moments and integral of the attractive part of a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.operators.grid import volume_elements


def attractive(value: Column) -> Column:
    """The value where it is below zero, else NULL; NaN is not below zero."""
    return F.when(value < 0, value)


def moment_columns(value: Column) -> list[Column]:
    """Count, mean, population deviation and biased skewness of the attractive values; zeros if none."""
    v = attractive(value)
    zero = F.lit(0.0)
    skew = F.when(F.stddev_pop(v) > 0, F.skewness(v))
    return [
        F.count(v).alias("f6"),
        F.coalesce(F.avg(v), zero).alias("f7"),
        F.coalesce(F.stddev_pop(v), zero).alias("f8"),
        F.coalesce(skew, zero).alias("f9"),
    ]


def field_moments(field: DataFrame) -> DataFrame:
    """``(mol_id, f6, f7, f8, f9)`` of ``sl2rho`` in one aggregation."""
    return field.groupBy("mol_id").agg(*moment_columns(F.col("sl2rho")))


def field_terms(field: DataFrame, volumes: DataFrame | None = None) -> DataFrame:
    """``(mol_id, snci, f6, f7, f8, f9)``: the moments and the attractive integral from the same pass.

    ``volumes`` is ``(mol_id, dv)``; without it the volume element comes from the coordinates.
    """
    sums = field.groupBy("mol_id").agg(
        F.coalesce(F.sum(-attractive(F.col("sl2rho"))), F.lit(0.0)).alias("_sum"),
        *moment_columns(F.col("sl2rho")),
    )
    volumes = volume_elements(field) if volumes is None else volumes
    return sums.join(volumes, "mol_id", "left").select(
        "mol_id",
        (F.col("_sum") * F.coalesce("dv", F.lit(1.0))).alias("snci"),
        *[f"f{i}" for i in range(6, 10)],
    )
