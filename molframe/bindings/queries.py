"""One query per operator, each over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.bindings.views import VIEWS, numbered_view, spread_view, table, view
from molframe.constants import BATCH_METRICS, SINGLE_METRICS
from molframe.functions.names import clean_name, file_extension
from molframe.functions.scalars import to_bohr
from molframe.operators import basis, batch, compare, delta, geometry, grid, moments, stencil, surface
from molframe.operators.density import density, field
from molframe.operators.fragments import fragments, override_fragments
from molframe.operators.paths import resolve_paths
from molframe.plans.descriptors import assemble_vector
from molframe.plans.compare import compare_grids
from molframe.session import materialise, written
from molframe.sources import bondorders, corpus, grids, logs, molden, results, sinks, structures
from molframe.sources import surface as surface_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DENSITY_SPACING, DENSITY_PADDING = 0.6, 0.5


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Fixed digits for comparison; adding 0.0 turns minus zero into zero."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


# --- sources ----------------------------------------------------------------------------------------


@query
def corpus_scan(spark, sf):
    files = corpus.structure_files(view(spark, sf, "name_paths"))
    return files.select("page_id", "path", "ext").orderBy("path")


@query
def mol_atoms(spark, sf):
    return structures.atoms_of(structures.parse_mol(view(spark, sf, "mol_docs")))


@query
def mol_bonds(spark, sf):
    return structures.bonds_of(structures.parse_mol(view(spark, sf, "mol_docs")))


@query
def bonds_by_distance(spark, sf):
    return geometry.bonds_by_distance(view(spark, sf, "atoms"))


def _wave_docs(spark, sf):
    return spread_view(spark, sf, "wave_docs", "part", "p_partkey")


def _waves(spark, sf):
    return molden.parse_wavefunction(_wave_docs(spark, sf))


@query
def molden_sections(spark, sf):
    return molden.section_table(_wave_docs(spark, sf))


@query
def molden_atoms(spark, sf):
    return rounded(molden.atom_table(_waves(spark, sf)), 10, "x", "y", "z")


@query
def molden_prims(spark, sf):
    flat = molden.shell_table(_waves(spark, sf)).select(
        "mol_id", "center", "shell", "l", F.posexplode("prims").alias("prim", "_p")
    )
    return flat.select("mol_id", "center", "shell", "l", "prim", "_p.exp", F.round("_p.coef", 12).alias("coef"))


@query
def molden_mo(spark, sf):
    flat = molden.orbital_table(_waves(spark, sf))
    return flat.select("mol_id", "mo", "occ", F.posexplode("coef").alias("mu", "coef"))


@query
def grid_rows(spark, sf):
    return grids.parse_grid_rows(view(spark, sf, "grid_lines"))


@query
def grid_required(spark, sf):
    cells = grids.require_field(view(spark, sf, "field"))
    return cells.groupBy("mol_id").agg(F.count("*").alias("points"), F.max("rdg").alias("top_rdg"))


@query
def segment_rows(spark, sf):
    rows = surface_files.parse_segments(view(spark, sf, "segment_docs"))
    last = F.element_at("v", -1).alias("last")
    return rows.select("mol_id", "seg_no", F.size("v").alias("width"), F.get("v", F.lit(5)).alias("q"),
                       F.get("v", F.lit(6)).alias("a"), last)


@query
def wbo_rows(spark, sf):
    return bondorders.parse_bond_orders(view(spark, sf, "wbo_lines"))


@query
def results_read(spark, sf):
    read = results.parse_results(view(spark, sf, "result_docs"))
    return read.select("mol_id", "readable", "snci", "scdi", "scdi_variance", F.get("f", F.lit(2)).alias("f3"),
                       F.get("f", F.lit(3)).alias("f4"), "fragments")


@query
def batch_read(spark, sf):
    rows = results.parse_batches(view(spark, sf, "batch_docs"))
    return rows.select("file", "mol_id", "status", "error", "readable", "snci", "scdi", "scdi_variance",
                       F.size("f").alias("width"), F.get("f", F.lit(1)).alias("f2"))


# --- scalar work ------------------------------------------------------------------------------------


@query
def clean_names(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", clean_name(F.col("text")).alias("cleaned"))


@query
def clean_ext(spark, sf):
    names = view(spark, sf, "name_paths").select("page_id", F.element_at(F.split("path", "/"), -1).alias("name"))
    return names.select("page_id", file_extension(clean_name(F.col("name")), F.col("name")).alias("ext"))


def _terms(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("mol_id")).agg(
        *[F.min(c).alias(a) for a, c in (("t1", "l_quantity"), ("t2", "l_discount"), ("t3", "l_tax"))],
        *[F.max(c).alias(a) for a, c in (("t4", "l_quantity"), ("t5", "l_discount"))],
        F.count("*").alias("t6"),
        *[F.max(c).alias(a) for a, c in (("t7", "l_tax"), ("t8", "l_extendedprice"), ("t9", "l_orderkey"))],
    )


@query
def assembled_vector(spark, sf):
    packed = _terms(spark, sf).select("mol_id", assemble_vector(*[F.col(f"t{i}") for i in range(1, 10)]).alias("f"))
    return packed.select("mol_id", *[F.get("f", F.lit(i)).alias(f"f{i + 1}") for i in range(10)])


@query
def log_scrape(spark, sf):
    return logs.scrape_logs(view(spark, sf, "log_docs"))


@query
def scdi_fixed(spark, sf):
    spread = surface.weighted_variance(view(spark, sf, "weighted"))
    score = surface.bounded_score(F.col("variance"), 0.0005, 0.002)
    return rounded(spread.select("mol_id", score.alias("scdi"), surface.bounded_score(F.col("variance"), 1.0, 1.0).alias("unbounded")), 8, "scdi")


# --- geometry ---------------------------------------------------------------------------------------


def _molecules(spark, sf):
    return view(spark, sf, "atoms"), view(spark, sf, "bonds")


@query
def fragment_labels(spark, sf):
    return fragments(*_molecules(spark, sf))


@query
def com(spark, sf):
    atoms, bonds = _molecules(spark, sf)
    return rounded(geometry.labelled_centres(fragments(atoms, bonds, geometry.PLACED)), 8, "mass", "x", "y", "z")


@query
def frag_pairs(spark, sf):
    atoms, bonds = _molecules(spark, sf)
    centres = geometry.labelled_centres(fragments(atoms, bonds, geometry.PLACED))
    return rounded(geometry.pair_distances(centres), 8, "mean_distance")


def _labelled(spark, sf):
    """Atoms that carry their fragment, and bonds, which several steps read: the line items are joined once."""
    atoms, bonds = _molecules(spark, sf)
    bonds = materialise(bonds)
    return fragments(atoms, bonds, ("el", *geometry.PLACED)), bonds


@query
def hb_angle(spark, sf):
    atoms, bonds = _labelled(spark, sf)
    return rounded(geometry.hydrogen_bonds(materialise(atoms), bonds), 6, "distance", "angle")


@query
def f1_f2(spark, sf):
    return rounded(geometry.shape_terms(*_labelled(spark, sf)), 6, "f1", "f2")


@query
def f3_wbo(spark, sf):
    return geometry.strongest_link(view(spark, sf, "wbo"), fragments(*_molecules(spark, sf)))


@query
def frag_override(spark, sf):
    atoms, bonds = _molecules(spark, sf)
    own = fragments(atoms, bonds)
    other = atoms.filter("mol_id % 3 = 0").select("mol_id", "atom", F.lit(1).alias("frag"))
    return override_fragments(own, other)


def _large(spark, sf):
    """Atoms and bonds; the line items are numbered once, as both are made of them."""
    atoms = numbered_view(spark, sf, "large_atoms", "el")
    return atoms, spark.sql(VIEWS["large_bonds"], large_atoms=atoms)


@query
def fragments_large(spark, sf):
    """Molecules of many blocks, so that labels meet across blocks."""
    return fragments(*_large(spark, sf))


@query
def frag_pairs_large(spark, sf):
    """Molecules of many packs of fragments."""
    atoms, bonds = _large(spark, sf)
    centres = geometry.labelled_centres(fragments(atoms, bonds, geometry.PLACED, written))
    return rounded(geometry.pair_distances(centres), 7, "mean_distance")


# --- surfaces, fields, moments ----------------------------------------------------------------------


@query
def segment_roles(spark, sf):
    values = F.array(*[F.col(f"v{i}") for i in range(8)]).alias("v")
    return surface.segment_roles(view(spark, sf, "segments").select("mol_id", values))


@query
def scdi_var(spark, sf):
    return rounded(surface.weighted_variance(view(spark, sf, "weighted")), 10, "variance")


@query
def surface_scores(spark, sf):
    values = F.array(*[F.col(f"v{i}") for i in range(8)]).alias("v")
    rows = surface.surface_terms(view(spark, sf, "segments").select("mol_id", values), 0.0, 0.01)
    return rounded(rows, 8, "scdi_variance", "scdi")


@query
def delta_v(spark, sf):
    return rounded(grid.volume_elements(view(spark, sf, "signed")), 9, "dv")


@query
def snci(spark, sf):
    return rounded(moments.field_terms(view(spark, sf, "signed")).select("mol_id", "snci"), 8, "snci")


@query
def nci_stats(spark, sf):
    return rounded(moments.field_moments(view(spark, sf, "signed")), 7, "f7", "f8", "f9")


@query
def grid_points(spark, sf):
    extents = grid.extents_of(molden.atom_table(_waves(spark, sf)))
    specs = grid.grid_specs(extents, DENSITY_SPACING, DENSITY_PADDING)
    return rounded(grid.grid_points(specs), 9, "x", "y", "z")


@query
def basis_guard(spark, sf):
    return basis.basis_guard(_waves(spark, sf))


@query
def basis_expand(spark, sf):
    rows = basis.expand_basis(basis.usable(_waves(spark, sf)), normalise=True)
    flat = rows.select("mol_id", "mu", "center", "lx", "ly", "lz", F.posexplode("prims").alias("prim", "_p"))
    return flat.select("mol_id", "mu", "center", "lx", "ly", "lz", "prim", "_p.exp", F.round("_p.coef", 9).alias("coef"))


@query
def density_field(spark, sf):
    points = density(_waves(spark, sf), DENSITY_SPACING, DENSITY_PADDING)
    return rounded(points, 8, "x", "y", "z", "rho")


@query
def wave_field(spark, sf):
    """Density, differences and interaction field in one pass; every point of every usable file."""
    points = field(_waves(spark, sf), DENSITY_SPACING, DENSITY_PADDING)
    # The sign of a middle eigenvalue at rounding level may differ, so the density stands without it.
    rows = points.select("mol_id", "ix", "iy", "iz", F.abs("sl2rho").alias("rho"), "rdg")
    return rounded(rows, 6, "rho", "rdg")


def _differences(spark, sf):
    return stencil.derivatives(stencil.with_shape(view(spark, sf, "grid")))


@query
def stencil_first(spark, sf):
    rows = _differences(spark, sf).select("mol_id", "ix", "iy", "iz", "gx", "gy", "gz")
    return rounded(rows, 8, "gx", "gy", "gz")


@query
def stencil_second(spark, sf):
    rows = _differences(spark, sf).select("mol_id", "ix", "iy", "iz", "hxx", "hyy", "hzz")
    return rounded(rows, 8, "hxx", "hyy", "hzz")


@query
def stencil_cross(spark, sf):
    rows = _differences(spark, sf).select("mol_id", "ix", "iy", "iz", "hxy", "hxz", "hyz")
    return rounded(rows, 8, "hxy", "hxz", "hyz")


@query
def lambda2(spark, sf):
    rows = stencil.with_middle_eigenvalue(view(spark, sf, "hessian"))
    return rounded(rows.select("mol_id", "line", "l_partkey", "l_suppkey", "lambda2"), 7, "lambda2")


@query
def nci_field(spark, sf):
    field_rows = stencil.interaction_field(stencil.with_shape(view(spark, sf, "grid")))
    return rounded(field_rows, 8, "rho", "rdg", "sl2rho")


# --- batches ----------------------------------------------------------------------------------------


@query
def run_status(spark, sf):
    return batch.resolve_status(view(spark, sf, "runs"), view(spark, sf, "results"))


@query
def batch_summary(spark, sf):
    records = batch.resolve_status(view(spark, sf, "runs"), view(spark, sf, "results"))
    return rounded(batch.batch_summary(records), 2, "total_time_seconds")


@query
def throughput(spark, sf):
    records = batch.resolve_status(view(spark, sf, "runs"), view(spark, sf, "results"))
    rates = batch.throughput(batch.batch_summary(records, by="lane"))
    return rounded(rates, 4, "total_time_seconds", "molecules_per_hour", "seconds_per_molecule")


@query
def summary_delta(spark, sf):
    records = batch.resolve_status(view(spark, sf, "runs"), view(spark, sf, "results"))
    early, late = (batch.batch_summary(records.filter(c)) for c in ("mol_id % 2 = 0", "mol_id % 2 = 1"))
    return rounded(delta.summary_delta(early, late), 2, "reference", "variant", "delta")


def _normed(spark, sf):
    return batch.normalise(view(spark, sf, "records"))


@query
def normalize(spark, sf):
    rows = _normed(spark, sf).select("mol_id", "snci_norm", "scdi_norm", "scdi_source")
    return rounded(rows, 8, "snci_norm", "scdi_norm")


@query
def quadrants(spark, sf):
    return batch.quadrants(_normed(spark, sf)).select("mol_id", "quadrant")


@query
def quadrant_head(spark, sf):
    return rounded(batch.quadrant_head(_normed(spark, sf)), 8, "snci_median", "scdi_median")


@query
def quadrant_tally(spark, sf):
    return batch.quadrant_tally(batch.quadrants(_normed(spark, sf)))


@query
def pending_inputs(spark, sf):
    done = view(spark, sf, "results").filter("readable")
    return batch.pending_inputs(view(spark, sf, "runs").select("mol_id", "lane"), done)


def _runs(spark, sf, metrics):
    rows = view(spark, sf, "variant")
    if metrics is BATCH_METRICS:
        named = {"SNCI": "snci", "SCDI": "scdi", "SCDI_variance": "scdi_variance",
                 "SNCI_Norm": "snci_norm", "SCDI_Norm": "scdi_norm"}
    else:
        named = {"SNCI": "snci", "SCDI": "scdi", "SCDI_variance": "scdi_variance"}
    keep = [F.col(named.get(m, m)).alias(m) for m, _, _ in metrics]
    sides = []
    for line in ("F", "O"):
        one = rows.filter(F.col("run") == line).select("mol_id", "seen", *keep)
        sides.append(delta.keep_last(one, "mol_id", "seen"))
    return sides


@query
def delta_long(spark, sf):
    rows = delta.compare_runs(*_runs(spark, sf, BATCH_METRICS))
    return rounded(rows, 6, "reference", "variant", "delta")


@query
def delta_single(spark, sf):
    reference, variant = _runs(spark, sf, SINGLE_METRICS)
    return rounded(delta.compare_to_baseline(variant, reference), 6, "reference", "variant", "delta")


@query
def best_setting(spark, sf):
    return batch.best_setting(view(spark, sf, "timing"))


@query
def timing_stats(spark, sf):
    rows = batch.timing_statistics(view(spark, sf, "timing"), "click", "points")
    return rounded(rows, 6, "mean", "lowest", "highest", "deviation", "speedup", "points_per_second")


@query
def resolved_paths(spark, sf):
    listed = view(spark, sf, "name_paths").select("path", F.col("page_id").alias("pos"))
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    asked = (
        F.when(F.col("pos") % 3 == 0, F.col("path"))
        .when(F.col("pos") % 3 == 1, F.concat(parent, F.lit("/"), F.upper(name)))
        .otherwise(F.concat("path", F.lit("~")))
    )
    return resolve_paths(listed.select(asked.alias("path")).distinct(), listed)


# --- agreement of two grids -------------------------------------------------------------------------


def _pairs(spark, sf):
    return view(spark, sf, "pairs")


def _with_scaled(columns: list[str]) -> list[Column]:
    return [to_bohr(F.col(c), "angstrom").alias(c) for c in columns]


@query
def grid_complete(spark, sf):
    return rounded(grid.completeness(view(spark, sf, "field")), 9, "spacing")


@query
def grid_align(spark, sf):
    reference = view(spark, sf, "field")
    predicted = view(spark, sf, "grid").select(
        "mol_id", "ix", "iy", "iz", (F.col("rho") - 0.3).alias("sl2rho"), (F.col("rho") * 2).alias("rdg")
    )
    cells = compare.align_grids(reference.drop("ix", "iy", "iz"), predicted)
    return rounded(cells, 8, "x", "y", "z", "sl2_ref", "rdg_ref", "sl2_pred", "rdg_pred")


@query
def grid_compare(spark, sf):
    """Coordinates in angstrom against a prediction in bohr, down to the agreement of all points."""
    reference = view(spark, sf, "field").select("mol_id", *_with_scaled(["x", "y", "z"]), "sl2rho", "rdg")
    predicted = view(spark, sf, "grid").select(
        "mol_id", "ix", "iy", "iz", (F.col("rho") - 0.25 + F.col("iz") / 100).alias("sl2rho"),
        (F.col("rho") * 3 + F.col("ix") / 10).alias("rdg"),
    )
    cells = compare.align_grids(reference, predicted)
    rows = compare.subset_metrics(cells, compare.subset_masks((None, None), 1.0))
    return rounded(rows, 6, *[c for c in rows.columns if c not in ("subset", "n")])


@query
def trim_mask(spark, sf):
    pairs = compare.with_trim_mask(_pairs(spark, sf), 0.99)
    return pairs.groupBy("trimmed").agg(
        F.count("*").alias("n"), F.max("rdg_ref").alias("top_rdg"), F.round(F.max(F.abs("sl2_ref")), 9).alias("top_sl2")
    )


@query
def subset_metrics(spark, sf):
    pairs = _pairs(spark, sf)
    rows = compare.subset_metrics(pairs, compare.subset_masks(compare.trim_bounds(pairs)))
    return rounded(rows, 6, *[c for c in rows.columns if c not in ("subset", "n")])


@query
def spearman(spark, sf):
    pairs = _pairs(spark, sf)
    rows = compare.subset_spearman(pairs, compare.subset_masks(compare.trim_bounds(pairs)))
    return rounded(rows, 7, "spearman_sl2rho", "spearman_rdg")


def _rounded_agreement(rows):
    ranks = {c: 7 if c.startswith("spearman") else 6 for c in rows.columns if c not in ("subset", "n")}
    for c, digits in ranks.items():
        rows = rounded(rows, digits, c)
    return rows


@query
def agreement(spark, sf):
    """All metrics of all subsets, as a user calls it."""
    return _rounded_agreement(compare.agreement(_pairs(spark, sf)))


@query
def grid_agreement(spark, sf):
    """A stored grid in angstrom against a prediction by index: completeness, alignment, trimming and all metrics."""
    reference = view(spark, sf, "field").select("mol_id", "x", "y", "z", "sl2rho", "rdg")
    predicted = view(spark, sf, "grid").select(
        "mol_id", "ix", "iy", "iz", (F.col("rho") - 0.25 + F.col("iz") / 100).alias("sl2rho"),
        (F.col("rho") * 3 + F.col("ix") / 10).alias("rdg"),
    )
    return _rounded_agreement(compare_grids(reference, predicted, trim_quantile=0.9, low_rdg=1.0))


@query
def parity_hist(spark, sf):
    return compare.parity_histogram(_pairs(spark, sf), "rdg_ref", "rdg_pred", 40)


@query
def parity_hist_clipped(spark, sf):
    inside = compare.clip_pairs(_pairs(spark, sf))
    return compare.parity_histogram(inside, "sl2_ref", "sl2_pred", 40)


@query
def sample_points(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_id").alias("id"), "value")
    order = (F.col("id") * 2654435761 + 7) % 4294967296
    return compare.sample_points(events, 500, order=order)


@query
def overlay_extract(spark, sf):
    low = compare.overlay_extract(_pairs(spark, sf))
    return rounded(low, 9, "sl2_ref", "sl2_pred", "rdg_pred")


# The inventory's names where a function of this module would shadow an import.
QUERIES["fragments"] = QUERIES.pop("fragment_labels")
QUERIES["assemble_vector"] = QUERIES.pop("assembled_vector")
QUERIES["density"] = QUERIES.pop("density_field")
QUERIES["resolve_paths"] = QUERIES.pop("resolved_paths")


# --- stored forms -----------------------------------------------------------------------------------


def _described(spark, sf):
    """Normalised records with their vectors, keyed by input path."""
    vectors = view(spark, sf, "vectors").select("mol_id", F.array(*[f"f{i}" for i in range(1, 10)]).alias("f"))
    path = F.concat(F.lit("in/"), F.col("mol_id").cast("string"), F.lit(".mol"))
    return _normed(spark, sf).join(vectors, "mol_id").withColumn("mol_id", path)


@query
def batch_sheet(spark, sf):
    rows = sinks.batch_table(_described(spark, sf))
    rows = rows.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("SNCI", "SNCI_Norm")})
    return rounded(rows, 8, "SNCI", "SCDI", "SCDI_variance", "SNCI_Norm", "SCDI_Norm")


@query
def record_texts(spark, sf):
    """Descriptor records written as JSON text and read back from it."""
    rows = _described(spark, sf).withColumns(
        {"solvent": F.lit("none"), "meta": F.struct(F.size("f").alias("n"), F.lit(None).cast("string").alias("note"))}
    )
    text = rows.select(sinks.record_json().alias("j"))
    get = lambda path, kind="double": F.get_json_object("j", path).cast(kind)
    return text.select(
        F.regexp_extract(get("$.mol_id", "string"), "in/([0-9]+)", 1).cast("long").alias("mol_id"),
        F.round(get("$.SCDI"), 8).alias("scdi"),
        get("$.vector[0]").alias("f1"), get("$.vector[8]").alias("f9"),
        get("$.metadata.n", "long").alias("n"),
        F.col("j").contains('"note":null').alias("note_kept"), get("$.solvent", "string").alias("solvent"),
    )


@query
def field_texts(spark, sf):
    """The text form of stored fields, with the molecule of every line."""
    return sinks.field_lines(view(spark, sf, "field"))
