"""Molecule structure files: MOL/SDF V2000 and XYZ text to atoms and bonds, bad files to rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.constants import ELEMENTS
from molframe.sources.text import fix_columns, lines_of, to_double, to_int, tokens_of


def element_table(spark: SparkSession) -> DataFrame:
    """Fixed reference rows ``(el, an, mass, radius)``; always small enough to broadcast."""
    return spark.createDataFrame(ELEMENTS, "el string, an int, mass double, radius double")


def with_elements(atoms: DataFrame) -> DataFrame:
    return atoms.join(F.broadcast(element_table(atoms.sparkSession)), "el", "left")


def _unknown(element: Column) -> Column:
    return ~F.coalesce(element, F.lit("")).isin(*(row[0] for row in ELEMENTS))


def _fixed(line: Column, start: int, width: int) -> Column:
    return F.trim(F.substring(line, start, width))


def parse_mol(docs: DataFrame) -> DataFrame:
    """V2000 blocks to ``(mol_id, atoms, bonds, reason)``. Of an SDF only the first record counts."""
    lines = lines_of(F.split(F.col("text"), r"(?m)^\$\$\$\$", 2)[0])
    counts = F.get(F.col("_lines"), F.lit(3))
    atom = lambda x, i: F.struct(
        i.cast("int").alias("atom"),
        _fixed(x, 32, 3).alias("el"),
        to_double(_fixed(x, 1, 10)).alias("x"),
        to_double(_fixed(x, 11, 10)).alias("y"),
        to_double(_fixed(x, 21, 10)).alias("z"),
    )
    bond = lambda x: F.struct(
        (to_int(_fixed(x, 1, 3)) - 1).alias("a"), (to_int(_fixed(x, 4, 3)) - 1).alias("b")
    )
    parsed = fix_columns(docs.select("mol_id", "text"), _lines=lines)
    parsed = fix_columns(
        parsed, _na=to_int(_fixed(counts, 1, 3)), _nb=to_int(_fixed(counts, 4, 3))
    )
    n_atoms, n_bonds = F.coalesce("_na", F.lit(0)), F.coalesce("_nb", F.lit(0))
    parsed = fix_columns(
        parsed,
        atoms=F.transform(F.slice("_lines", F.lit(5), n_atoms), atom),
        bonds=F.transform(F.slice("_lines", n_atoms + 5, n_bonds), bond),
    )
    bad_atom = F.exists("atoms", lambda a: (a.x + a.y + a.z).isNull() | (a.el == ""))
    bad_bond = F.exists(
        "bonds",
        lambda b: (b.a + b.b).isNull() | (F.least(b.a, b.b) < 0) | (F.greatest(b.a, b.b) >= F.col("_na")),
    )
    reason = (
        F.when(F.col("_na").isNull() | F.col("_nb").isNull(), "unreadable counts line")
        .when(F.col("_na") == 0, "no atoms")
        .when((F.size("atoms") < F.col("_na")) | bad_atom, "unreadable atom line")
        .when((F.size("bonds") < F.col("_nb")) | bad_bond, "unreadable bond line")
        .when(F.exists("atoms", lambda a: _unknown(a.el)), "unknown element")
    )
    return parsed.select("mol_id", "atoms", "bonds", reason.alias("reason"))


def parse_xyz(docs: DataFrame) -> DataFrame:
    """XYZ text to ``(mol_id, atoms, reason)``; bonds follow from distances."""
    row = lambda x, i: F.struct(i.cast("int").alias("atom"), tokens_of(x).alias("t"))
    atom = lambda r: F.struct(
        r.atom.alias("atom"),
        r.t[0].alias("el"),
        to_double(F.get(r.t, F.lit(1))).alias("x"),
        to_double(F.get(r.t, F.lit(2))).alias("y"),
        to_double(F.get(r.t, F.lit(3))).alias("z"),
    )
    parsed = fix_columns(docs.select("mol_id", "text"), _lines=lines_of(F.col("text")))
    parsed = fix_columns(parsed, _na=to_int(F.trim(F.get("_lines", F.lit(0)))))
    rows = F.transform(F.slice("_lines", F.lit(3), F.coalesce("_na", F.lit(0))), row)
    parsed = fix_columns(parsed, atoms=F.transform(rows, atom))
    reason = (
        F.when(F.col("_na").isNull() | (F.col("_na") <= 0), "unreadable atom count")
        .when(F.size("atoms") < F.col("_na"), "fewer atoms than announced")
        .when(F.exists("atoms", lambda a: (a.x + a.y + a.z).isNull()), "unreadable atom line")
        .when(F.exists("atoms", lambda a: _unknown(a.el)), "unknown element")
    )
    return parsed.select("mol_id", "atoms", reason.alias("reason"))


def atoms_of(parsed: DataFrame) -> DataFrame:
    """``(mol_id, atom, el, an, mass, x, y, z)`` of the readable molecules."""
    rows = parsed.filter(F.col("reason").isNull()).select("mol_id", F.inline("atoms"))
    return with_elements(rows).select("mol_id", "atom", "el", "an", "mass", "x", "y", "z")


def bonds_of(parsed: DataFrame) -> DataFrame:
    """Undirected bonds ``(mol_id, a, b)`` with a < b."""
    rows = parsed.filter(F.col("reason").isNull()).select("mol_id", F.inline("bonds"))
    return rows.select("mol_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def rejects_of(parsed: DataFrame, source: str) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select(
        "mol_id", F.lit(source).alias("source"), "reason"
    )
