"""From parsed inputs to one descriptor record per molecule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.constants import ANGSTROM_TO_BOHR, GRID_PADDING, GRID_SPACING, RHO_FLOOR
from molframe.operators.basis import basis_guard
from molframe.operators.density import field
from molframe.operators.fragments import fragments, override_fragments
from molframe.operators.geometry import shape_terms, strongest_link
from molframe.operators.moments import field_terms
from molframe.operators.surface import surface_terms
from molframe.session import materialise


@dataclass(frozen=True)
class Options:
    """Settings of one run; ``solvent`` names the variant a record belongs to."""

    charge: int = 0
    spin: int = 1
    solvent: str = "default"
    spacing: float = GRID_SPACING
    padding: float = GRID_PADDING
    rho_floor: float = RHO_FLOOR
    primitive_norm: bool = False
    variance_min: float | None = None
    variance_max: float | None = None


@dataclass(frozen=True)
class Inputs:
    """Parsed tables, all keyed by ``mol_id``; the optional ones may be absent."""

    atoms: DataFrame
    bonds: DataFrame
    wbo: DataFrame
    logs: DataFrame
    field: DataFrame | None = None
    wavefunctions: DataFrame | None = None
    segments: DataFrame | None = None
    topology_atoms: DataFrame | None = None
    topology_bonds: DataFrame | None = None
    # Molecules whose bond-order file exists, be it empty; by default those with a row.
    wbo_listed: DataFrame | None = None
    rejects: DataFrame | None = None


def assemble_vector(*terms: Column) -> Column:
    """The nine terms in order, all as doubles."""
    return F.array(*[t.cast("double") for t in terms])


def wavefunction_terms(wf: DataFrame, options: Options) -> DataFrame:
    """Field moments and integral straight from wavefunctions; the volume element is known, not measured."""
    points = field(
        wf, options.spacing, options.padding, normalise=options.primitive_norm, rho_floor=options.rho_floor
    )
    h = options.spacing * ANGSTROM_TO_BOHR
    volumes = wf.select("mol_id", F.lit(h * h * h).alias("dv"))
    return field_terms(points, volumes)


def _field_part(inputs: Inputs, options: Options) -> DataFrame | None:
    if inputs.field is not None:
        return field_terms(inputs.field)
    if inputs.wavefunctions is not None:
        return wavefunction_terms(inputs.wavefunctions, options)
    return None


def wavefunction_errors(wf: DataFrame) -> DataFrame:
    """``(mol_id, wf_error)`` of every wavefunction; null where its field can be evaluated."""
    verdict = F.col("verdict")
    problem = F.when(verdict == "unsupported", "spherical basis functions").when(verdict == "mismatch", "orbitals do not fit the basis")
    return wf.select("mol_id", "reason").join(basis_guard(wf), "mol_id", "left").select("mol_id", F.coalesce("reason", problem).alias("wf_error"))


def describe(inputs: Inputs, options: Options | None = None) -> DataFrame:
    """``(mol_id, solvent, status, error, snci, scdi, scdi_variance, f, meta)`` per molecule.

    Six independent aggregates meet on ``mol_id``; fragment labels, which several of them read, are stored
    once. A log or bond-order list that is missing fails the molecule, and so does a wavefunction that is missing,
    unreadable, spherical or of another size than its basis: its zeros would enter the norms of the whole batch. A stored
    grid or surface that is missing leaves zeros and is named in ``meta.status``. An empty bond-order list is f3 = 0.
    """
    options = options or Options()
    frags = materialise(fragments(inputs.atoms, inputs.bonds))
    link_frags = frags
    if inputs.topology_atoms is not None and inputs.topology_bonds is not None:
        link_frags = materialise(
            override_fragments(frags, fragments(inputs.topology_atoms, inputs.topology_bonds))
        )
    listed = inputs.wbo if inputs.wbo_listed is None else inputs.wbo_listed
    listed = listed.select("mol_id").distinct().withColumn("_wbo", F.lit(True))
    records = (
        materialise(shape_terms(inputs.atoms, inputs.bonds, frags))
        .join(strongest_link(inputs.wbo, link_frags), "mol_id", "left")
        .join(listed, "mol_id", "left")
        .join(inputs.logs.select("mol_id", "dipole", "polarizability", "reason"), "mol_id", "left")
    )
    empty = {"snci": 0.0, "f6": 0, "f7": 0.0, "f8": 0.0, "f9": 0.0}
    terms = _field_part(inputs, options)
    if terms is None:
        records = records.withColumns({n: F.lit(v) for n, v in empty.items()} | {"_field": F.lit(False)})
    else:
        records = records.join(terms.withColumn("_field", F.lit(True)), "mol_id", "left").fillna(
            {**empty, "_field": False}
        )
    if inputs.segments is None:
        records = records.withColumns(
            {"scdi_variance": F.lit(0.0), "scdi": F.lit(None).cast("double"), "_surface": F.lit(False)}
        )
    else:
        surface = surface_terms(inputs.segments, options.variance_min, options.variance_max)
        records = records.join(surface.withColumn("_surface", F.lit(True)), "mol_id", "left").fillna(
            {"scdi_variance": 0.0, "_surface": False}
        )
    error = F.when(F.col("dipole").isNull() & F.col("reason").isNull(), "log not found").otherwise(
        F.coalesce("reason", F.when(F.col("_wbo").isNull(), "bond orders not found"))
    )
    if inputs.field is None and inputs.wavefunctions is not None:
        states = wavefunction_errors(inputs.wavefunctions).withColumn("_wave", F.lit(True))
        records = records.join(states, "mol_id", "left")
        absent = F.when(F.col("_wave").isNull(), "wavefunction not found").otherwise(F.col("wf_error"))
        thin = F.when(~F.col("_field"), "grid too thin for differences")
        error = F.coalesce(error, absent, thin)
    missing = F.concat_ws(
        ", ",
        F.when(~F.col("_field"), "no field"),
        F.when(~F.col("_surface"), "no surface"),
    )
    vector = assemble_vector(
        *[F.col(c) for c in ("f1", "f2", "f3", "dipole", "polarizability", "f6", "f7", "f8", "f9")]
    )
    meta = F.struct(
        F.lit(options.charge).alias("charge"),
        F.lit(options.spin).alias("spin"),
        F.col("fragments"),
        F.when(missing == "", "success").otherwise(missing).alias("status"),
    )
    return records.select(
        "mol_id",
        F.lit(options.solvent).alias("solvent"),
        F.when(error.isNull(), "success").otherwise("failed").alias("status"),
        error.alias("error"),
        "snci", "scdi", "scdi_variance",
        vector.alias("f"),
        meta.alias("meta"),
    )
