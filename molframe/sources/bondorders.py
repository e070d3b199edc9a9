"""Bond-order lists: ``i j value`` per line, 1-based in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.sources.text import to_double, to_int, tokens_of


def parse_bond_orders(rows: DataFrame) -> DataFrame:
    """``(mol_id, line)`` to ``(mol_id, i, j, wbo)`` with 0-based atoms; other lines are skipped."""
    token = lambda i: F.get("_t", F.lit(i))
    return (
        rows.select("mol_id", tokens_of(F.col("line")).alias("_t"))
        .select(
            "mol_id",
            (to_int(token(0)) - 1).alias("i"),
            (to_int(token(1)) - 1).alias("j"),
            to_double(token(2)).alias("wbo"),
        )
        .filter("i is not null and j is not null and wbo is not null")
    )
