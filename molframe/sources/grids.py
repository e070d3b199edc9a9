"""Grid fields: whitespace text rows, and the Parquet field table with its required columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.sources.text import to_double, tokens_of

FIELD_COLUMNS = ("x", "y", "z", "sl2rho", "rdg")


def parse_grid_rows(rows: DataFrame) -> DataFrame:
    """``(mol_id, line)`` to ``(mol_id, x, y, z, sl2rho, rdg)``; comments, short and bad rows are skipped."""
    kept = rows.filter(~F.col("line").startswith("#")).select("mol_id", tokens_of(F.col("line")).alias("_t"))
    values = [to_double(F.get("_t", F.lit(i))).alias(name) for i, name in enumerate(FIELD_COLUMNS)]
    numbers = kept.filter(F.size("_t") >= 5).select("mol_id", *values)
    # NaN is a number of the file; only what is no number at all is NULL here.
    return numbers.filter(" and ".join(f"{c} is not null" for c in FIELD_COLUMNS))


def missing_columns(field: DataFrame) -> list[str]:
    return sorted(set(FIELD_COLUMNS) - set(field.columns))


def require_field(field: DataFrame) -> DataFrame:
    """Fail with the list of absent columns; return the table unchanged otherwise."""
    missing = missing_columns(field)
    if missing:
        raise ValueError(f"incomplete grid table, missing columns: {missing}")
    return field


def read_field(spark: SparkSession, path: str) -> DataFrame:
    return require_field(spark.read.parquet(path))
