"""Wavefunction text (Molden) to tables.

Every step works inside the file's own row with array functions, so parsing a corpus needs no shuffle at
all; rows multiply only in the final ``explode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.constants import ANGSTROM_TO_BOHR, SHELL_LETTERS
from molframe.sources.text import fix_columns, lines_of, to_double_fortran, to_int, tokens_of


def _header_name(line: Column) -> Column:
    return F.when(
        F.trim(line).rlike(r"^\[[^\]]*\]"),
        F.lower(F.trim(F.regexp_extract(F.trim(line), r"^\[([^\]]*)\]", 1))),
    )


def sections(docs: DataFrame) -> DataFrame:
    """Add ``_lines`` and ``sections``: array of ``(name, start, stop)``, 0-based, header excluded.

    Names are case-insensitive, the last duplicate wins and ends where the next kept header stands.
    """
    named = F.filter(
        F.transform(
            "_lines", lambda x, i: F.struct(_header_name(x).alias("name"), i.cast("int").alias("at"))
        ),
        lambda h: h["name"].isNotNull(),
    )
    kept = F.filter(
        "_named",
        lambda h: ~F.exists("_named", lambda g: (g["name"] == h["name"]) & (g["at"] > h["at"])),
    )
    bounded = F.transform(
        "_kept",
        lambda h, i: F.struct(
            h["name"].alias("name"),
            (h["at"] + 1).alias("start"),
            F.coalesce(F.get("_kept", i + 1)["at"], F.size("_lines")).alias("stop"),
        ),
    )
    df = fix_columns(docs.select("mol_id", "text"), _lines=lines_of(F.col("text"))).drop("text")
    df = fix_columns(fix_columns(df, _named=named), _kept=kept)
    return fix_columns(df, sections=bounded).drop("_named", "_kept")


def _section_lines(name: str) -> Column:
    found = F.get(F.filter("sections", lambda s: s["name"] == name), F.lit(0))
    return F.slice("_lines", found["start"] + 1, found["stop"] - found["start"])


def section_table(docs: DataFrame) -> DataFrame:
    """``(mol_id, name, start, stop)``."""
    return sections(docs).select("mol_id", F.inline("sections"))


def parse_wavefunction(docs: DataFrame) -> DataFrame:
    """``(mol_id, atoms, shells, orbitals, reason)``: one row per file, coordinates in bohr."""
    return _with_reason(_with_orbitals(_with_shells(_with_atoms(sections(docs)))))


def _with_atoms(df: DataFrame) -> DataFrame:
    header_at = F.get(F.filter("sections", lambda s: s["name"] == "atoms"), F.lit(0))["start"] - 1
    header = F.lower(F.get("_lines", header_at))
    # A name such as [Atoms] never holds the unit itself; the unit stands behind the bracket.
    unit = F.when(header.contains("angs"), F.lit(ANGSTROM_TO_BOHR)).otherwise(F.lit(1.0))
    rows = F.filter(F.transform(_section_lines("atoms"), tokens_of), lambda t: F.size(t) >= 6)
    atom = lambda t, i: F.struct(
        i.cast("int").alias("center"),
        t[0].alias("el"),
        (to_double_fortran(t[3]) * F.col("_unit")).alias("x"),
        (to_double_fortran(t[4]) * F.col("_unit")).alias("y"),
        (to_double_fortran(t[5]) * F.col("_unit")).alias("z"),
    )
    return fix_columns(fix_columns(df, _unit=unit, _rows=rows), atoms=F.transform("_rows", atom)).drop("_rows")


def _with_shells(df: DataFrame) -> DataFrame:
    """Shell lines own the next n_prim non-blank lines; digit lines elsewhere set the centre."""
    letters = list(SHELL_LETTERS)
    tokens = F.filter(F.transform(_section_lines("gto"), tokens_of), lambda t: t[0] != "")
    head = lambda t, i: F.struct(
        i.cast("int").alias("at"),
        F.array_position(F.array(*map(F.lit, letters)), F.lower(t[0])).cast("int").alias("kind"),
        to_int(F.get(t, F.lit(1))).alias("n_prim"),
        F.when(F.size(t) >= 3, to_double_fortran(F.get(t, F.lit(2)))).otherwise(F.lit(1.0)).alias("scale"),
    )
    heads = F.filter(F.transform("_gto", head), lambda h: h["kind"] > 0)
    gap_start = lambda i: F.when(i == 0, F.lit(0)).otherwise(
        F.get("_heads", i - 1)["at"] + 1 + F.coalesce(F.get("_heads", i - 1)["n_prim"], F.lit(0))
    )
    gap = lambda h, i: F.slice("_gto", gap_start(i) + 1, F.greatest(h["at"] - gap_start(i), F.lit(0)))
    centre = lambda h, i: F.element_at(
        F.concat(
            F.array(F.lit(None).cast("int")),
            F.transform(
                F.filter(gap(h, i), lambda t: t[0].rlike(r"^\d+$")), lambda t: t[0].try_cast("int") - 1
            ),
        ),
        -1,
    )
    carried = F.aggregate(
        "_gap_centers",
        F.array().cast("array<int>"),
        lambda acc, c: F.concat(
            acc, F.array(F.coalesce(c, F.when(F.size(acc) > 0, F.get(acc, F.size(acc) - 1))))
        ),
    )
    prims = lambda h: F.transform(
        F.slice("_gto", h["at"] + 2, F.coalesce(h["n_prim"], F.lit(0))),
        lambda t: F.struct(
            to_double_fortran(t[0]).alias("exp"),
            (to_double_fortran(F.get(t, F.lit(1))) * h["scale"]).alias("coef"),
        ),
    )
    shell = lambda h, i: F.struct(
        F.get("_centers", i).alias("center"),
        i.cast("int").alias("shell"),
        (h["kind"] - 1).alias("l"),
        h["n_prim"].alias("n_prim"),
        prims(h).alias("prims"),
    )
    df = fix_columns(fix_columns(df, _gto=tokens), _heads=heads)
    df = fix_columns(fix_columns(df, _gap_centers=F.transform("_heads", centre)), _centers=carried)
    return fix_columns(df, shells=F.transform("_heads", shell)).drop(
        "_gto", "_heads", "_gap_centers", "_centers"
    )


def _with_orbitals(df: DataFrame) -> DataFrame:
    """One block per ``Sym=`` line; coefficients keep file order and the printed index is ignored."""
    text = F.concat(F.lit("\n"), F.array_join(_section_lines("mo"), "\n"))
    blocks = F.slice(F.split(text, r"\n\s*Sym="), F.lit(2), F.size("_lines"))
    # The rest of the Sym= line itself is no row of the block.
    rows = lambda b: F.transform(F.slice(lines_of(b), F.lit(2), F.length(b) + 1), lambda x: F.trim(x))
    split_rows = lambda x: F.struct(
        F.filter(x, lambda y: y.startswith("Occup=")).alias("occ"),
        F.filter(
            F.transform(F.filter(x, lambda y: ~y.contains("=")), tokens_of),
            lambda t: (F.size(t) >= 2) & t[0].rlike(r"^[+-]*\d+$"),
        ).alias("coef"),
    )
    last = lambda b: F.trim(F.substring(F.element_at(b["occ"], -1), 7, 2147483647))
    orbital = lambda b, i: F.struct(
        i.cast("int").alias("mo"),
        F.when(F.size(b["occ"]) == 0, 0.0).otherwise(to_double_fortran(last(b))).alias("occ"),
        F.transform(b["coef"], lambda t: to_double_fortran(t[1])).alias("coef"),
    )
    df = fix_columns(df, _blocks=F.transform(F.transform(blocks, rows), split_rows))
    return fix_columns(df, orbitals=F.transform("_blocks", orbital)).drop("_blocks")


def _with_reason(df: DataFrame) -> DataFrame:
    has = lambda name: F.exists("sections", lambda s: s["name"] == name)
    bad_shell = F.exists(
        "shells",
        lambda s: s["n_prim"].isNull()
        | (F.size(s["prims"]) < s["n_prim"])
        | F.exists(s["prims"], lambda p: (p["exp"] + p["coef"]).isNull()),
    )
    width = F.size(F.get("orbitals", F.lit(0))["coef"])
    reason = (
        F.when(~has("atoms") | ~has("gto") | ~has("mo"), "missing section")
        .when(F.size("atoms") == 0, "no atoms")
        .when(F.exists("atoms", lambda a: (a.x + a.y + a.z).isNull()), "unreadable atom line")
        .when(F.size("shells") == 0, "no basis functions")
        .when(F.exists("shells", lambda s: s["center"].isNull()), "shell before centre")
        .when(
            F.exists("shells", lambda s: (s["center"] < 0) | (s["center"] >= F.size("atoms"))),
            "shell centre out of range",
        )
        .when(bad_shell, "unreadable shell")
        .when(F.size("orbitals") == 0, "no orbitals")
        .when(
            F.exists("orbitals", lambda o: o["occ"].isNull() | F.exists(o["coef"], lambda c: c.isNull())),
            "unreadable orbital",
        )
        .when(F.exists("orbitals", lambda o: F.size(o["coef"]) != width), "orbitals of unequal length")
    )
    return df.select("mol_id", "atoms", "shells", "orbitals", reason.alias("reason"))


def atom_table(wf: DataFrame) -> DataFrame:
    """``(mol_id, center, el, x, y, z)`` in bohr."""
    return wf.filter(F.col("reason").isNull()).select("mol_id", F.inline("atoms"))


def shell_table(wf: DataFrame) -> DataFrame:
    """``(mol_id, center, shell, l, prims)``."""
    rows = wf.filter(F.col("reason").isNull()).select("mol_id", F.inline("shells"))
    return rows.select("mol_id", "center", "shell", "l", "prims")


def orbital_table(wf: DataFrame) -> DataFrame:
    """``(mol_id, mo, occ, coef)``."""
    return wf.filter(F.col("reason").isNull()).select("mol_id", F.inline("orbitals"))
