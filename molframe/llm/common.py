"""What several operators here share: table access, lineage cuts, and byte-level word hashing."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.session import ensure_checkpoint_dir

# Word classes over UTF-8 bytes. Both treat every byte of a multi-byte character as part of a word.
_BYTES = np.arange(256)
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
NOT_BLANK = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_ODD = 0x9E3779B97F4A7C15 | 1
_PERIOD = 1 << 12
_STEP = 1 << 21


def _powers(base: int, count: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(count - 1, base, np.uint64))])


_POWERS = _powers(_ODD, _PERIOD)


_KEPT: dict = {}


def kept(key, make):
    """What a worker process keeps between tasks: the tables of one operator at a time."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop what an earlier operator kept in this worker."""
    _KEPT.clear()
    release()


def release() -> None:
    """Give freed memory of a Python worker back, as workers live on between tasks and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage through a checkpoint in the folder that all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage through a Parquet table in the same shared folder: compressed, and read by column."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.written_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made, once nothing reads them any more."""
    for made in tables:
        remove_folder(made.sparkSession, made.written_path)


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def remainder(column: Column, modulus: int) -> Column:
    """crc32 of a value written as text, modulo ``modulus``; a missing value counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without copying, and where each row begins; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 22):
    """Cut a batch into runs of rows of about ``limit`` bytes of text, one row at least."""
    _, at = utf8(batch.column(batch.schema.get_field_index(column)))
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, side="right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes of ``kind`` within a row, and words per row."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    rows = np.searchsorted(starts, at)
    return starts, ends, np.diff(rows)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run, a fixed function of its bytes; long inputs go in steps."""
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint64)
    total = np.cumsum(lengths)
    low = 0
    while low < len(starts):
        before = total[low] - lengths[low]
        high = max(low + 1, int(np.searchsorted(total, before + _STEP, side="right")))
        size, begin = lengths[low:high], total[low:high] - lengths[low:high] - before
        place = np.arange(total[high - 1] - before) - np.repeat(begin, size)
        taken = data[place + np.repeat(starts[low:high], size)].astype(np.uint64) + np.uint64(1)
        sums = np.add.reduceat(taken * _POWERS[place % _PERIOD], begin) if len(taken) else out[low:high]
        out[low:high] = mix(sums + size.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        low = high
    return out


def probe(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in sorted ``keys``, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, place, -1)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of ``counts`` words each, joined by one blank."""
    last = np.zeros(len(starts), bool)
    last[(np.cumsum(counts) - 1)[counts > 0]] = True
    size = ends - starts + ~last
    total = np.concatenate([[0], np.cumsum(size)])
    out = np.full(total[-1], 0x20, np.uint8)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(total, total[low] + (_STEP >> 1), side="right")) - 1)
        length = (ends - starts)[low:high]
        before = np.cumsum(length) - length
        step = np.arange(length.sum())
        out[step + np.repeat(total[low:high] - before, length)] = data[step + np.repeat(starts[low:high] - before, length)]
        low = high
    offsets = total[np.concatenate([[0], np.cumsum(counts)])]
    return pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
