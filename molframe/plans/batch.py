"""A whole batch from a folder to its stored outputs."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.constants import BATCH_METRICS
from molframe.operators import batch, delta
from molframe.plans.descriptors import Inputs, Options, describe
from molframe.plans.folders import folder_inputs, list_structures
from molframe.session import materialise
from molframe.sources import sinks


@dataclass(frozen=True)
class Batch:
    """The tables of a finished batch."""

    records: DataFrame
    labelled: DataFrame
    tally: DataFrame
    head: DataFrame
    summary: DataFrame


def finish_batch(records: DataFrame, total_time: float | None = None) -> Batch:
    """Normalise, label and summarise descriptor records; failed ones keep their row."""
    normed = batch.normalise(records)
    medians = batch.norm_medians(normed)
    labelled = batch.quadrants(normed, medians)
    scores = labelled.select("mol_id", "snci_norm", "scdi_norm", "quadrant")
    summary = batch.batch_summary(records, total_time)
    return Batch(
        records=records.join(scores, "mol_id", "left"),
        labelled=labelled,
        tally=batch.quadrant_tally(labelled),
        head=batch.quadrant_head(normed, medians),
        summary=batch.throughput(summary),
    )


def store_batch(done: Batch, out: str, solvent: str) -> None:
    """All outputs of one variant below ``out``; the variant is part of the path, as a partition."""
    place = f"solvent={solvent}"
    sinks.write_batch_csv(done.records, f"{out}/batch_csv/{place}")
    sinks.write_batch_json(done.records, done.summary, f"{out}/batch_json/{place}")
    sinks.write_quadrants(done.labelled, done.tally, done.head, f"{out}/quadrants/{place}")


def batch_metrics(records: DataFrame) -> DataFrame:
    """Records as ``mol_id`` and one column per batch metric."""
    return records.select("mol_id", *delta.vector_metrics(BATCH_METRICS))


def run_folder(
    spark: SparkSession,
    directory: str,
    results: str,
    out: str,
    options: Options | None = None,
    force: bool = False,
    clean: bool = False,
    text_grids: bool = False,
) -> Batch:
    """Describe the molecules of a folder and store records, sheets and quadrants.

    Finished molecules of the same variant are kept and none of their files is opened; ``force`` describes them again and ``clean`` also drops
    stored molecules that left the folder. The batch is derived from the stored table.
    """
    options = options or Options()
    started = time.monotonic()
    listed = list_structures(spark, directory)
    store = f"{out}/descriptors"
    stored = None if clean else _stored(spark, store, options.solvent)
    if stored is not None and not force:
        listed = batch.pending_inputs(listed, stored)
    inputs = folder_inputs(spark, directory, results, text_grids, listed)
    fresh = materialise(describe(inputs, options).unionByName(unreadable(inputs, options), True))
    keep = fresh
    if stored is not None:
        # The stored variant is about to be replaced by itself plus the new records.
        old = stored.join(fresh.select("mol_id"), "mol_id", "left_anti")
        keep = materialise(old.unionByName(fresh, True))
    sinks.write_descriptors(keep, store, replace=True)
    records = spark.read.parquet(store).filter(F.col("solvent") == options.solvent)
    records = records.withColumn("elapsed_seconds", F.lit(None).cast("double"))
    done = finish_batch(records, time.monotonic() - started)
    store_batch(done, out, options.solvent)
    return done


def _stored(spark: SparkSession, store: str, solvent: str) -> DataFrame | None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    if not hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path):
        return None
    return spark.read.parquet(store).filter((F.col("solvent") == solvent) & (F.col("status") == "success"))


def unreadable(inputs: Inputs, options: Options) -> DataFrame:
    """Structures that could not be read, as failed records."""
    return inputs.rejects.select(
        "mol_id",
        F.lit(options.solvent).alias("solvent"),
        F.lit("failed").alias("status"),
        F.col("reason").alias("error"),
    )


def store_delta(reference: DataFrame, variant: DataFrame, out: str) -> DataFrame:
    """Differences of two stored batches of records, by molecule and metric."""
    rows = delta.compare_runs(batch_metrics(reference), batch_metrics(variant))
    sinks.write_delta(rows, f"{out}/delta")
    return rows
