"""Cartesian basis functions from shells, and the check that orbitals fit them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.constants import CARTESIAN_POWERS


def powers_literal() -> Column:
    """Array indexed by l of arrays of ``(lx, ly, lz)``: 35 fixed rows, folded into the plan."""
    triple = lambda p: F.struct(*[F.lit(d).alias(n) for d, n in zip(p, ("lx", "ly", "lz"), strict=True)])
    return F.array(*[F.array(*map(triple, row)) for row in CARTESIAN_POWERS])


def _odd_product(n: Column) -> Column:
    """(2n - 1)!! for powers 0 to 4."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in (1, 1, 3, 15, 105)]), n + 1)


def primitive_norm(alpha: Column, power: Column) -> Column:
    total = power["lx"] + power["ly"] + power["lz"]
    below = _odd_product(power["lx"]) * _odd_product(power["ly"]) * _odd_product(power["lz"])
    return F.pow(2.0 * alpha / math.pi, F.lit(0.75)) * F.pow(4.0 * alpha, 0.5 * total) / F.sqrt(below)


def expand_basis(wf: DataFrame, normalise: bool = False) -> DataFrame:
    """``(mol_id, mu, center, lx, ly, lz, prims)`` from wavefunction rows, shell by shell."""
    prims = lambda s, p: (
        F.transform(
            s["prims"],
            lambda q: F.struct(
                q["exp"].alias("exp"), (q["coef"] * primitive_norm(q["exp"], p)).alias("coef")
            ),
        )
        if normalise
        else s["prims"]
    )
    function = lambda s: F.transform(
        F.get(powers_literal(), s["l"]),
        lambda p: F.struct(
            s["center"].alias("center"),
            p["lx"].alias("lx"),
            p["ly"].alias("ly"),
            p["lz"].alias("lz"),
            prims(s, p).alias("prims"),
        ),
    )
    return wf.filter(F.col("reason").isNull()).select(
        "mol_id", F.posexplode(F.flatten(F.transform("shells", function))).alias("mu", "_f")
    ).select("mol_id", "mu", "_f.*")


def basis_guard(wf: DataFrame) -> DataFrame:
    """``(mol_id, n_cart, n_sph, n_basis, verdict)``: ok, unsupported (spherical shells) or mismatch."""
    count = lambda f: F.aggregate("shells", F.lit(0), lambda s, x: s + f(x["l"]))
    sized = wf.filter(F.col("reason").isNull()).select(
        "mol_id",
        count(lambda l: ((l + 1) * (l + 2) / 2).cast("int")).alias("n_cart"),
        count(lambda l: 2 * l + 1).alias("n_sph"),
        F.size(F.get("orbitals", F.lit(0))["coef"]).alias("n_basis"),
    )
    verdict = (
        F.when(F.col("n_basis") == F.col("n_cart"), "ok")
        .when(F.col("n_basis") == F.col("n_sph"), "unsupported")
        .otherwise("mismatch")
    )
    return sized.withColumn("verdict", verdict)


def usable(wf: DataFrame) -> DataFrame:
    """Readable wavefunctions whose orbitals match the Cartesian basis; decided inside each row."""
    cartesian = F.aggregate(
        "shells", F.lit(0), lambda s, x: s + ((x["l"] + 1) * (x["l"] + 2) / 2).cast("int")
    )
    return wf.filter(
        F.col("reason").isNull() & (F.size(F.get("orbitals", F.lit(0))["coef"]) == cartesian)
    )
