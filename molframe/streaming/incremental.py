"""New molecule files as a stream: the batch plan, started again, sees only what has arrived since."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from molframe.operators.fragments import fragments
from molframe.operators.geometry import bonds_by_distance, shape_terms
from molframe.sources import structures
from molframe.sources.corpus import structure_files
from molframe.sources.text import file_key


def shape_records(files: DataFrame) -> DataFrame:
    """``(mol_id, fragments, f1, f2)`` of ``(mol_id, text)`` structure files."""
    files = structure_files(files, "mol_id")
    blocks = structures.parse_mol(files.filter(F.col("ext").isin(".mol", ".sdf")))
    plain = structures.atoms_of(structures.parse_xyz(files.filter(F.col("ext") == ".xyz")))
    atoms = structures.atoms_of(blocks).unionByName(plain)
    bonds = structures.bonds_of(blocks).unionByName(bonds_by_distance(plain))
    return shape_terms(atoms, bonds, fragments(atoms, bonds))


def start_shapes(spark: SparkSession, directory: str, out: str, checkpoint: str) -> StreamingQuery:
    """Describe files not seen by ``checkpoint`` yet, then stop.

    Every micro-batch owns the partition of its number, so a batch repeated after a failure replaces its
    own output.
    """

    def write(files: DataFrame, batch_id: int) -> None:
        shape_records(files).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    files = spark.readStream.format("text").option("wholetext", "true").load(directory)
    named = files.select(file_key().alias("mol_id"), F.col("value").alias("text"))
    return (
        named.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
