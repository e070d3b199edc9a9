"""Folders of molecule files and solver outputs as descriptor inputs."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.operators.geometry import bonds_by_distance
from molframe.plans.descriptors import Inputs
from molframe.session import materialise
from molframe.sources import bondorders, corpus, grids, logs, molden, structures, surface
from molframe.sources.text import file_key, read_documents

# File names the external solver leaves in a molecule's result folder.
BOND_ORDERS, WAVEFUNCTION, LOG, SURFACE, TOPOLOGY = (
    "wbo", "molden.input", "xtb.log", "*.cosmo", "xtbtopo.mol",
)
PREFERRED_SURFACE = "xtb.cosmo"
GRID_TEXT = "nci_grid.txt"


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def read_outputs(spark: SparkSession, root: str, pattern: str, whole: bool, stems: list[str] | None = None) -> DataFrame:
    """``(stem, file, text)`` of one kind of output below ``root``; the parent folder names the molecule.

    With ``stems``, files of other molecules are left out by their path alone and never opened.
    """
    files = spark.read.format("text").option("wholetext", str(whole).lower())
    files = files.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    path = F.split(file_key(), "/")
    if stems is not None:
        files = files.filter(F.element_at(path, -2).isin(stems))
    return files.select(
        F.element_at(path, -2).alias("stem"), F.element_at(path, -1).alias("file"), F.col("value").alias("text")
    )


def _listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``(stem)`` of the molecules that have such an output, be it empty.

    A scan leaves out files of no length, so the names come from the file index that the driver builds for any scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    stems = {(unquote(path).rsplit("/", 2)[-2],) for path in files.inputFiles()}
    return spark.createDataFrame(sorted(stems), "stem string")


def list_structures(spark: SparkSession, directory: str) -> DataFrame:
    """``(mol_id, stem)`` of the molecule files of a folder; no content is read."""
    files = corpus.structure_files(corpus.list_files(spark, directory))
    return files.select(F.col("path").alias("mol_id"), stem_of(F.col("file")).alias("stem"))


def read_structures(spark: SparkSession, directory: str, paths: list[str]) -> DataFrame:
    """``(mol_id, text, modified)`` of these files alone: a filter on the path prunes the scan's list of files."""
    return read_documents(spark, directory).filter(F.col("mol_id").isin(paths))


def structure_tables(spark: SparkSession, directory: str, paths: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``atoms``, ``bonds`` and ``rejects`` of a folder; MOL and SDF carry bonds, XYZ bonds are inferred.

    Texts are parsed once and stored; every later use reads the parsed rows. Files that are no molecules, or not among
    ``paths``, are not opened. The list of paths is part of the file list that the driver of any scan holds.
    """
    if paths is None:
        paths = [row.mol_id for row in list_structures(spark, directory).select("mol_id").toLocalIterator()]
    files = corpus.structure_files(read_structures(spark, directory, paths), "mol_id")
    files = materialise(files.select("mol_id", "ext", "text"))
    blocks = materialise(structures.parse_mol(files.filter(F.col("ext").isin(".mol", ".sdf"))))
    plain = materialise(structures.parse_xyz(files.filter(F.col("ext") == ".xyz")))
    plain_atoms = structures.atoms_of(plain)
    other = files.filter(F.col("ext").isin(".pdb", ".mol2")).select(
        "mol_id", F.lit("structure").alias("source"), F.lit("format is listed only").alias("reason")
    )
    rejects = structures.rejects_of(blocks, "structure").unionByName(
        structures.rejects_of(plain, "structure")
    )
    return (
        structures.atoms_of(blocks).unionByName(plain_atoms),
        structures.bonds_of(blocks).unionByName(bonds_by_distance(plain_atoms)),
        rejects.unionByName(other),
    )


def folder_inputs(
    spark: SparkSession, directory: str, results: str, text_grids: bool = False, wanted: DataFrame | None = None
) -> Inputs:
    """All inputs of a batch: structures in ``directory``, solver outputs in ``results/<file stem>/``.

    ``wanted`` (``mol_id``, ``stem``, as of :func:`list_structures`) limits the batch to these molecules before any file
    is opened.
    """
    listed = materialise(list_structures(spark, directory) if wanted is None else wanted.select("mol_id", "stem"))
    paths, chosen = [], None if wanted is None else set()
    for row in listed.toLocalIterator():
        paths.append(row.mol_id)
        if chosen is not None:
            chosen.add(row.stem)
    names = None if chosen is None else sorted(chosen)
    atoms, bonds, rejects = structure_tables(spark, directory, paths)
    stems = listed

    def keyed(pattern: str, whole: bool = True) -> DataFrame:
        return read_outputs(spark, results, pattern, whole, names).join(stems, "stem").drop("stem")

    surfaces = (
        keyed(SURFACE)
        .groupBy("mol_id")
        .agg(F.min_by("text", F.struct(F.col("file") != PREFERRED_SURFACE, "file")).alias("text"))
    )
    topology = materialise(structures.parse_mol(keyed(TOPOLOGY)))
    field = None
    if text_grids:
        field = materialise(
            grids.parse_grid_rows(keyed(GRID_TEXT, whole=False).withColumnRenamed("text", "line"))
        )
    return Inputs(
        atoms=atoms,
        bonds=bonds,
        rejects=rejects,
        wbo=materialise(
            bondorders.parse_bond_orders(keyed(BOND_ORDERS, whole=False).withColumnRenamed("text", "line"))
        ),
        wbo_listed=_listed(spark, results, BOND_ORDERS).join(stems, "stem").select("mol_id"),
        logs=materialise(logs.scrape_logs(keyed(LOG))),
        field=field,
        wavefunctions=None if text_grids else materialise(molden.parse_wavefunction(keyed(WAVEFUNCTION))),
        segments=surface.parse_segments(surfaces),
        topology_atoms=structures.atoms_of(topology),
        topology_bonds=structures.bonds_of(topology),
    )
