"""Surface segment rows of solvation files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.sources.text import lines_of, to_double, tokens_of


def parse_segments(docs: DataFrame) -> DataFrame:
    """``(mol_id, seg_no, v)``: rows of eight or more numbers behind ``$segment_information``.

    The block ends at the next ``$`` line. Comments, short rows and rows with any non-number are skipped.
    """
    after = F.get(F.split(F.col("text"), r"(?m)^[ \t]*\$segment_information[ \t\r]*$", 2), F.lit(1))
    block = F.split(after, r"(?m)^[ \t]*\$", 2)[0]
    rows = F.filter(
        F.transform(lines_of(block), tokens_of), lambda t: (F.size(t) >= 8) & ~t[0].startswith("#")
    )
    numbers = F.transform(rows, lambda t: F.transform(t, to_double))
    return docs.select(
        "mol_id",
        F.posexplode(F.filter(numbers, lambda v: F.forall(v, lambda q: q.isNotNull()))).alias("seg_no", "v"),
    )
