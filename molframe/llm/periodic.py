"""Operator 11: maximal periodic runs of words, found by recursive frequency splitting and a lag scan of what survives."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import NOT_BLANK, joined_words, mix, pieces, utf8, words

# A run holds at least this many words and at least this many periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PIECE = 1 << 21

Run = tuple[int, int, int]


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """A number per word, equal for equal words only, and how many there are."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    inside = np.ascontiguousarray(data[NOT_BLANK[data]])
    made = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(inside)]).dictionary_encode()
    return made.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(made.dictionary)


def looped(count: int, mark: int) -> np.ndarray | None:
    """Which original word stands at each place once the tail of a text of ``count`` words repeats, or None if it stays."""
    if mark % 10 or not count:
        return None
    g = mark // 10
    at = g % count
    period = 1 + (count - at) // (3 + g % 8)
    place = np.arange(count)
    place[at:] = at + (place[at:] - at) % period
    return place


def surviving(codes: np.ndarray, owner: np.ndarray, kinds: int, least_words: int, least_periods: int) -> list[np.ndarray]:
    """Stretches of consecutive places of one row that can hold runs, each with every run that touches it.

    A word of a run occurs once a period, so a word that its segment holds fewer than ``least_periods`` times is in none
    and splits it. Segments that lost a word are counted anew; one that loses none is stable.
    """
    place, segment, stable = np.arange(len(codes)), owner.astype(np.int64), []
    while len(place):
        _, inverse, counts = np.unique(segment * kinds + codes[place], return_inverse=True, return_counts=True)
        often = counts[inverse] >= least_periods
        lost = np.zeros(segment[-1] + 1, bool)
        lost[segment[~often]] = True
        whole = ~lost[segment]
        for one in np.split(place[whole], np.flatnonzero(np.diff(segment[whole])) + 1):
            if len(one) >= least_words:
                stable.append(one)
        left = often & ~whole
        place, segment = place[left], segment[left]
        new = np.ones(len(place), bool)
        new[1:] = (np.diff(place) > 1) | (np.diff(segment) > 0)
        segment = np.cumsum(new) - 1
        long = np.bincount(segment, minlength=1)[segment] >= least_words if len(place) else new
        place, segment = place[long], segment[long]
    return stable


def lag_scan(codes: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[Run]:
    """Every maximal run (start, length, smallest period) of a sequence.

    Words that equal those ``lag`` later form stretches; a stretch of at least two lags covers a whole block of ``lag``
    words that begins at a multiple of it and equals its neighbour, so lags without equal neighbouring blocks, told from
    hashes of prefixes, are passed over: all lags together look at n log n blocks. A lag whose equal blocks all lie in
    runs of smaller period has nothing new, as such a period divides the lag.
    """
    count = len(codes)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(count, _BASE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    found, reach = [], np.zeros(count, np.int64)
    for lag in range(1, count // least_periods + 1):
        need = max(least_words, least_periods * lag) - lag
        blocks = np.diff(sums[::lag])
        hits = np.flatnonzero(blocks[:-1] * power[lag] == blocks[1:])
        if not len(hits) or (reach[hits * lag] >= (hits + 2) * lag).all():
            continue
        same = np.zeros(count - lag + 2, np.int8)
        same[1:-1] = codes[lag:] == codes[:-lag]
        edge = np.diff(same)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for start, stop in zip(begin.tolist(), end.tolist(), strict=True):
            if stop - start >= need and reach[start] < stop + lag:
                found.append((start, stop + lag - start, lag))
                np.maximum(reach[start:], stop + lag, out=reach[start:])
    return found


def collapse(texts: pa.Array, marks: list[int] | None, least_words: int, least_periods: int) -> tuple[np.ndarray, list[list[Run]], pa.Array]:
    """Words per text, its runs by start and period, and the text without what repeats in them."""
    data, at = utf8(texts)
    starts, ends, counts = words(data, at, NOT_BLANK)
    first = np.cumsum(counts) - counts
    if marks is not None:
        source = np.arange(len(starts))
        for row, mark in enumerate(marks):
            if (moved := looped(int(counts[row]), mark)) is not None:
                source[first[row] : first[row] + counts[row]] = first[row] + moved
    codes, kinds = word_numbers(data, starts, ends)
    if marks is not None:
        codes, starts, ends = codes[source], starts[source], ends[source]
    owner = np.repeat(np.arange(len(counts)), counts)
    runs: list[list[Run]] = [[] for _ in counts]
    drop = np.zeros(len(starts), bool)
    for one in surviving(codes, owner, kinds, least_words, least_periods):
        row = owner[one[0]]
        for start, length, period in lag_scan(codes[one], least_words, least_periods):
            runs[row].append((int(one[0] - first[row]) + start, length, period))
            drop[one[0] + start + period : one[0] + start + length] = True
    for found in runs:
        found.sort(key=lambda r: (r[0], r[2]))
    kept = np.bincount(owner[~drop], minlength=len(counts)) if len(counts) else counts
    return counts, runs, joined_words(data, starts[~drop], ends[~drop], kept)


def collapse_runs(
    docs: DataFrame,
    keep: list[str],
    text_column: str = "text",
    least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS,
    mark: Column | None = None,
) -> DataFrame:
    """``keep`` columns, n_words, runs (start, length, period; by start, then period) and collapsed of every row.

    Words are blank-separated and compared byte for byte. A run is a stretch of words with smallest period q and at
    least max(``least_words``, ``least_periods`` * q) words that no neighbouring word extends; ``collapsed`` leaves out
    what follows a run's first q words. Each text is the work of one task, without any shuffle; its work is about
    n log n, plus n for each lag that shows a run of its own. ``mark`` (a number per row) makes the tails of some texts
    repeat first, as tests do. A null or empty text has no words, no runs and an empty ``collapsed``; equal rows are
    each their own row; an empty table gives an empty result.
    """
    source = docs.select(*keep, F.col(text_column).alias("_text"), *([] if mark is None else [mark.cast("long").alias("_mark")]))
    empty = F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(RUNS).alias("runs"), F.lit("").alias("collapsed")
    schema = source.select(*keep, *empty).schema
    loops = mark is not None
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text", _PIECE):
                marks = part.column(len(keep) + 1).to_pylist() if loops else None
                counts, runs, texts = collapse(part.column(len(keep)), marks, least_words, least_periods)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
                struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], fields=list(kinds.value_type))
                made = [pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), struct), texts.cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], schema.names)

    return source.mapInArrow(run, schema)


def _strongest(runs: str) -> Column:
    """The run of greatest length / period, compared by cross products; ``runs`` comes by start, then period."""
    nothing = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, nothing, lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))


def run_report(docs: DataFrame) -> DataFrame:
    """Runs of every text after the tail of one in ten, chosen by the checksum of doc_id, was made to repeat."""
    mark = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    found = collapse_runs(docs.select("doc_id", "text"), ["doc_id"], mark=mark).withColumn("best", _strongest("runs"))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
