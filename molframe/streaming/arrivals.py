"""Descriptor records as a stream: structures and solver outputs meet by name, in whatever order they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from molframe.plans.batch import unreadable
from molframe.plans.descriptors import Options, describe
from molframe.plans.folders import BOND_ORDERS, LOG, SURFACE, WAVEFUNCTION, folder_inputs, list_structures, stem_of
from molframe.sources.corpus import structure_files
from molframe.sources.text import file_key

STRUCTURE = "structure"
OUTPUTS = {"log": LOG, "bonds": BOND_ORDERS, "wavefunction": WAVEFUNCTION, "surface": SURFACE}
# What a record cannot do without; a surface that comes later makes the record anew.
NEEDED = ("log", "bonds", "wavefunction")
PATIENCE_SECONDS = 24 * 3600
FILES_PER_BATCH = 10_000
FILE_COLUMNS = "path string, modificationTime timestamp, length bigint, content binary"
READY = "stem string, complete boolean"
STATE = "seen string, settled boolean"


def _paths(spark: SparkSession, directory: str, pattern: str, deep: bool, per_batch: int) -> DataFrame:
    """Paths of new files; their contents are not read."""
    files = spark.readStream.format("binaryFile").schema(FILE_COLUMNS).option("pathGlobFilter", pattern)
    files = files.option("recursiveFileLookup", str(deep).lower()).option("maxFilesPerTrigger", per_batch)
    return files.load(directory).select(file_key().alias("path"))


def arrivals(spark: SparkSession, directory: str, results: str, per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """``(stem, kind, arrived)`` of every new file, of all kinds in one stream."""
    found = structure_files(_paths(spark, directory, "*", False, per_batch))
    streams = [found.select(stem_of(F.col("file")).alias("stem"), F.lit(STRUCTURE).alias("kind"))]
    for kind, pattern in OUTPUTS.items():
        path = F.split("path", "/")
        files = _paths(spark, results, pattern, True, per_batch)
        streams.append(files.select(F.element_at(path, -2).alias("stem"), F.lit(kind).alias("kind")))
    # The time of the micro-batch, which its log keeps: a file copied with an old date is not late.
    return reduce(DataFrame.unionAll, streams).withColumn("arrived", F.current_timestamp())


def ready_molecules(arrived: DataFrame, needed: tuple[str, ...] = NEEDED, patience: int = PATIENCE_SECONDS) -> DataFrame:
    """``(stem, complete)``, once a molecule has all it needs, again for each later arrival, or once patience ends.

    The state of a molecule is the names of the kinds seen. Patience runs from the last arrival and is measured by the
    arrivals of all molecules; outputs without a structure are forgotten when it ends, since the folder keeps them.
    """
    wanted = {STRUCTURE, *needed}

    def meet(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, settled = state.get if state.exists else ("", False)
        kinds = set(seen.split(",")) - {""}
        if state.hasTimedOut:
            # Given up once; the state stays for outputs that come later still.
            if STRUCTURE not in kinds:
                state.remove()
                return
            state.update((seen, True))
            yield pd.DataFrame({"stem": [key[0]], "complete": [False]})
            return
        latest = 0
        for rows in batches:
            kinds |= set(rows["kind"])
            latest = max(latest, int(rows["arrived_ms"].max()))
        complete = wanted <= kinds
        again = settled and STRUCTURE in kinds
        state.update((",".join(sorted(kinds)), complete or again))
        if complete or again:
            yield pd.DataFrame({"stem": [key[0]], "complete": [complete]})
        else:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1000 * patience)

    watched = arrived.withColumn("arrived_ms", F.unix_millis("arrived")).withWatermark("arrived", "0 seconds")
    return watched.groupBy("stem").applyInPandasWithState(meet, READY, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def start_records(
    spark: SparkSession,
    directory: str,
    results: str,
    out: str,
    checkpoint: str,
    options: Options | None = None,
    needed: tuple[str, ...] = NEEDED,
    patience: int = PATIENCE_SECONDS,
    per_batch: int = FILES_PER_BATCH,
) -> StreamingQuery:
    """Describe the molecules that have become ready since the last start, then stop.

    The stream decides when a molecule is described; the batch plan, limited to the files of the ready molecules, decides
    how, so its record is the batch record. One whose patience ended fails with the batch plan's reason. An empty output
    is no arrival, because a scan leaves such files out; the batch plan sees it when patience ends. A micro-batch, of at
    most ``per_batch`` files of each kind, owns the partition of its number and replaces it when it is repeated.
    """
    options = options or Options()

    def write(ready: DataFrame, batch_id: int) -> None:
        ready = ready.select("stem").distinct()
        wanted = list_structures(spark, directory).join(ready, "stem", "left_semi")
        inputs = folder_inputs(spark, directory, results, wanted=wanted)
        records = describe(inputs, options).unionByName(unreadable(inputs, options), True)
        records.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    ready = ready_molecules(arrivals(spark, directory, results, per_batch), needed, patience)
    return (
        ready.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_records(spark: SparkSession, out: str) -> DataFrame:
    """One record per molecule: that of the last micro-batch that described it."""
    rows = spark.read.parquet(out)
    record = F.struct(*[c for c in rows.columns if c not in ("mol_id", "batch")])
    return rows.groupBy("mol_id").agg(F.max_by(record, "batch").alias("_r")).select("mol_id", "_r.*")
