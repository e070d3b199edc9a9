"""Dipole and polarizability from program logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.sources.text import fix_columns, lines_of, to_double, tokens_of

# Texts and patterns of the log format.
DIPOLE_HEADER = "molecular dipole:"
DIPOLE_ROW = "full:"
DIPOLE_LOOKAHEAD = 9
DIPOLE_LINE = r"total dipole moment:\s+([\d\.]+)\s+Debye"
POLARIZABILITY = r"Mol\.\s+(?:alpha|α\(0\))\s+/au\s+:\s+([\d\.]+)"
POLARIZABILITY_OTHER = r"isotropic polarizability:\s+([\d\.]+)"


def _first(pattern: str) -> Column:
    found = F.regexp_extract("text", pattern, 1)
    return F.when(found != "", to_double(found))


def _block_dipole() -> Column:
    """The first block whose first ``full:`` row, at most nine lines below the header, ends in a number."""
    headers = F.filter(
        F.transform(F.col("_lines"), lambda x, i: F.when(x.contains(DIPOLE_HEADER), i)),
        lambda i: i.isNotNull(),
    )
    row = lambda i: F.get(
        F.filter(
            F.slice(F.col("_lines"), i + 2, F.lit(DIPOLE_LOOKAHEAD)), lambda x: x.contains(DIPOLE_ROW)
        ),
        F.lit(0),
    )
    values = F.transform(headers, lambda i: to_double(F.element_at(tokens_of(row(i)), -1)))
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def scrape_logs(docs: DataFrame) -> DataFrame:
    """``(mol_id, dipole, polarizability, reason)``; the reason is set when a value is missing."""
    scraped = fix_columns(docs, _lines=lines_of(F.col("text"))).select(
        "mol_id",
        F.coalesce(_block_dipole(), _first(DIPOLE_LINE)).alias("dipole"),
        F.coalesce(_first(POLARIZABILITY), _first(POLARIZABILITY_OTHER)).alias("polarizability"),
    )
    reason = F.when(F.col("dipole").isNull(), "dipole not found").when(
        F.col("polarizability").isNull(), "polarizability not found"
    )
    return scraped.withColumn("reason", reason)
