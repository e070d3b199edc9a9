"""Operator 13: passages that an earlier document already has, found by FM-indexes over shards of shared passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import NOT_BLANK, hashes, mix, pieces, utf8, words, written
from molframe.llm.fmindex import FMIndex
from molframe.llm.periodic import word_numbers

WINDOW = 50
# An anchor is the least run of this many words within a window, by a hash.
GRAM = 8
# Windows that a segment holds at most; an anchor that repeats could otherwise make one without end.
SEGMENT = 256
# Rows from which the frequent grams are told, and how many are known. They come last in the order of grams; which
# windows are found does not depend on it.
SAMPLE_ROWS = 4000
COMMON = 1 << 16
# Segments of one index; those of an anchor with more are spread over several indexes.
SHARD = 4096
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(GRAM)], np.uint64)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_PIECE = 1 << 21


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


@dataclass
class Segments:
    """Stretches of windows with one anchor: the row, the first word, how many windows, the anchor and a 128-bit name."""

    row: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    name: np.ndarray


@dataclass
class Texts:
    """The words of a piece of text: the bytes, where words start and end, words per row, and the first word of each."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, array: pa.Array) -> Texts:
        data, at = utf8(array)
        starts, ends, counts = words(data, at, NOT_BLANK)
        return cls(data, starts, ends, counts, np.cumsum(counts) - counts)

    def hashed(self) -> np.ndarray:
        return hashes(self.data, self.starts, self.ends)

    def joined(self, low: int, high: int, dropped: np.ndarray | None = None) -> bytes:
        """Words ``low`` to ``high``, without the dropped ones, joined by one blank."""
        raw, at = self.data, range(low, high) if dropped is None else (low + np.flatnonzero(~dropped[low:high])).tolist()
        begin, end = self.starts, self.ends
        return b" ".join(raw[begin[i] : end[i]].tobytes() for i in at)


def _names(hashed: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 128-bit name of each stretch of words, as two signed columns: shifted differences of two prefix sums."""
    out = np.empty((len(start), 2), np.int64)
    for i, base in enumerate(_BASES):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashed), base)]))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashed), _inverse(base))]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashed + np.uint64(i)) * powers[:-1])])
        out[:, i] = mix((sums[start + length] - sums[start]) * back[start] + mix(length.astype(np.uint64))).view(np.int64)
    return out


def _grams(hashed: np.ndarray) -> np.ndarray:
    """A hash of the GRAM words that begin at each word; the last ones run into zeros."""
    padded = np.concatenate([hashed, np.zeros(GRAM, np.uint64)])
    return mix(sum((padded[k : k + len(hashed)] * _WEIGHTS[k] for k in range(GRAM)), np.zeros(len(hashed), np.uint64)))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :])


def segments(texts: Texts, hashed: np.ndarray, common: np.ndarray, window: int) -> Segments:
    """All windows of all rows, consecutive ones of the same anchor as one segment.

    The anchor of a window is the least of its grams, frequent ones last, so equal windows have equal anchors.
    """
    none = np.zeros(0, np.int64)
    if len(hashed) < window:
        return Segments(none, none, none, none, np.zeros((0, 2), np.int64))
    grams = _grams(hashed)
    order = grams >> np.uint64(1)
    if len(common):
        spot = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        order |= (common[spot] == grams).astype(np.uint64) << np.uint64(63)
    least = _least(order[: len(order) - GRAM + 1], window - GRAM + 1)
    owner = np.repeat(np.arange(len(texts.counts)), texts.counts)
    inside = owner[: len(least)] == owner[window - 1 :]
    place = np.flatnonzero(inside)
    anchor, row = least[place], owner[place]
    new = np.ones(len(place), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    step = np.arange(len(place)) - np.repeat(begin, np.diff(np.append(begin, len(place))))
    begin = np.flatnonzero(step % SEGMENT == 0)
    count = np.diff(np.append(begin, len(place)))
    start = place[begin]
    return Segments(row[begin], start, count, anchor[begin].view(np.int64), _names(hashed, start, count + window - 1))


def _marked(docs: DataFrame, common: np.ndarray, window: int, text_column: str) -> DataFrame:
    """doc_id, n_words, a 128-bit name (d1, d2) and the digest of all words, and (anchor, s1, s2) of each segment."""
    held = docs.sparkSession.sparkContext.broadcast(common)
    schema = "doc_id bigint, n_words bigint, d1 bigint, d2 bigint, digest string, segments array<struct<a: bigint, s1: bigint, s2: bigint>>"
    names = ["doc_id", "n_words", "d1", "d2", "digest", "segments"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text", _PIECE):
                texts = Texts.of(part.column(1))
                hashed = texts.hashed()
                found = segments(texts, hashed, held.value, window)
                named = _names(hashed, texts.first, texts.counts)
                digests = [hashlib.sha256(texts.joined(a, a + n)).hexdigest() for a, n in zip(texts.first.tolist(), texts.counts.tolist(), strict=True)]
                offsets = np.searchsorted(found.row, np.arange(part.num_rows + 1)).astype(np.int32)
                each = [found.anchor, *(np.ascontiguousarray(found.name[:, i]) for i in (0, 1))]
                struct = pa.StructArray.from_arrays([pa.array(c) for c in each], ["a", "s1", "s2"])
                columns = [part.column(0), *map(pa.array, (texts.counts.astype(np.int64), *(np.ascontiguousarray(named[:, i]) for i in (0, 1)))), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), struct)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_column).alias("_text")).mapInArrow(run, schema)


def common_grams(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Grams that several rows of a bounded sample hold, sorted."""
    part = max(1, docs.count() // SAMPLE_ROWS)
    drawn = docs.select(F.col(text_column).alias("_text")).filter(F.pmod(F.xxhash64("_text"), F.lit(part)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text", _PIECE):
                texts = Texts.of(piece.column(0))
                grams = _grams(texts.hashed())
                owner = np.repeat(np.arange(len(texts.counts)), texts.counts)
                order = np.lexsort([grams, owner])
                grams, owner = grams[order], owner[order]
                once = np.ones(len(grams), bool)
                once[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(grams[once].view(np.int64))], ["gram"])

    counts = drawn.mapInArrow(run, "gram bigint").groupBy("gram").count().filter("count > 4")
    found = counts.orderBy(F.desc("count"), "gram").limit(COMMON).select("gram").toArrow()["gram"].to_numpy()
    return np.sort(found.view(np.uint64))


def _passages(touched: DataFrame, common: np.ndarray, window: int) -> DataFrame:
    """The words of every shared segment once, from the first document that has it."""
    held = touched.sparkSession.sparkContext.broadcast(common)
    schema = "s1 bigint, s2 bigint, a bigint, last bigint, parts bigint, first bigint, words string"
    names = ["s1", "s2", "a", "last", "parts", "first", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _PIECE):
                texts = Texts.of(part.column(1))
                found = segments(texts, texts.hashed(), held.value, window)
                at = np.searchsorted(found.row, np.arange(part.num_rows + 1))
                rows = []
                for k, (doc_id, needs) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    wanted = {(x["s1"], x["s2"]): x for x in needs if x["first"] == doc_id}
                    for i in range(at[k], at[k + 1]):
                        if x := wanted.pop(tuple(found.name[i].tolist()), None):
                            low = int(found.start[i])
                            rows.append((x["s1"], x["s2"], x["a"], x["last"], x["parts"], doc_id, texts.joined(low, low + int(found.windows[i]) + window - 1)))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary()).cast(pa.string())], names)

    return touched.select("doc_id", "text", "needs").mapInArrow(run, schema)


def _searched(group: pa.Table, window: int) -> pa.Table:
    """Index a shard's passages, stream them all through the index, and name the first document of every window."""
    group = group.combine_chunks()
    texts = Texts.of(group["words"])
    numbers, kinds = word_numbers(texts.data, texts.starts, texts.ends)
    numbers += 1
    held = group["held"].to_numpy(zero_copy_only=False).astype(bool)
    first, last = group["first"].to_numpy(), group["last"].to_numpy()
    index = FMIndex(numbers[np.repeat(held, texts.counts)], texts.counts[held], first[held], kinds, window)
    least = index.least_values(numbers, texts.first, texts.counts)
    names = np.stack([group["s1"].to_numpy(), group["s2"].to_numpy()], 1)
    rows = []
    for i in range(group.num_rows):
        docs = least[texts.first[i] : texts.first[i] + texts.counts[i] - window + 1]
        if docs.min() >= last[i]:
            continue
        begin = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        runs = [{"at": a, "windows": n, "first": d} for a, n, d in zip(begin.tolist(), np.diff(np.append(begin, len(docs))).tolist(), docs[begin].tolist(), strict=True) if d < last[i]]
        rows.append({"s1": int(names[i, 0]), "s2": int(names[i, 1]), "runs": runs})
    runs_type = pa.list_(pa.struct([("at", pa.int64()), ("windows", pa.int64()), ("first", pa.int64())]))
    return pa.Table.from_pylist(rows, pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("runs", runs_type)]))


def _kept(touched: DataFrame, common: np.ndarray, window: int) -> DataFrame:
    """doc_id, d1, d2, the removed spans (first word, words) and the kept text of every document with hits."""
    held = touched.sparkSession.sparkContext.broadcast(common)
    schema = "doc_id bigint, d1 bigint, d2 bigint, spans array<struct<start: bigint, words: bigint>>, kept string"
    names = ["doc_id", "d1", "d2", "spans", "kept"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _PIECE):
                texts = Texts.of(part.column(1))
                hashed = texts.hashed()
                found = segments(texts, hashed, held.value, window)
                at = np.searchsorted(found.row, np.arange(part.num_rows + 1))
                # Counts how many removed windows begin less those that ended, so sums tell the covered words.
                change = np.zeros(len(hashed) + 1, np.int64)
                for k, (doc_id, hits) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    runs: dict[tuple[int, int], list[dict]] = {}
                    for x in hits:
                        runs.setdefault((x["s1"], x["s2"]), []).extend(r for r in x["runs"] if r["first"] < doc_id)
                    for i in range(at[k], at[k + 1]):
                        for r in runs.get(tuple(found.name[i].tolist()), ()):
                            low = int(found.start[i]) + r["at"]
                            change[low] += 1
                            change[low + r["windows"] + window - 1] -= 1
                dropped = np.cumsum(change[:-1]) > 0
                named = _names(hashed, texts.first, texts.counts)
                spans, kept = [], []
                for low, count in zip(texts.first.tolist(), texts.counts.tolist(), strict=True):
                    edge = np.diff(np.concatenate([[0], dropped[low : low + count].astype(np.int8), [0]]))
                    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    spans.append([{"start": a, "words": b - a} for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
                    kept.append(texts.joined(low, low + count, dropped))
                columns = [part.column(0), pa.array(np.ascontiguousarray(named[:, 0])), pa.array(np.ascontiguousarray(named[:, 1]))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], names)

    return touched.select("doc_id", "text", "hits").mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, window: int = WINDOW, text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, spans (start, words), kept and kept_sha256.

    A word is removed if a window of ``window`` words over it also begins in a document of smaller doc_id. ``kept`` is the
    text of the kept words joined by one blank, and null where nothing is removed; ``kept_sha256`` is always there.

    Windows are grouped by anchors, their least gram, into segments. Only hashes of anchors and segments travel for the
    whole corpus; anchors that two documents have name the passages to look at. Their words go to shards by anchor,
    once each; every shard builds an FM-index and streams its passages through it, which names the first document of
    every window. Passages of an anchor too many for one index are spread over several, each of which sees all of the
    anchor's passages. A text that an earlier document has word for word is settled by its 128-bit name alone.

    A null or empty text has no words. Rows without doc_id lose nothing and are nobody's first document. Rows with one
    doc_id are no copies of each other, but all lose what a smaller one has. An empty table gives an empty result.
    """
    common = common_grams(docs, text_column)
    marks = written(_marked(docs, common, window, text_column))
    least = written(marks.groupBy("d1", "d2").agg(F.min("doc_id").alias("least")))
    rows = written(marks.select("doc_id", "n_words", "d1", "d2", "digest").join(least, ["d1", "d2"]))
    origins = rows.filter((F.col("doc_id") == F.col("least")) & (F.col("n_words") >= window)).select("doc_id").distinct()
    every = marks.filter("doc_id IS NOT NULL").select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.a", "s.s1", "s.s2")
    anchors = every.groupBy("a").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("a")
    shared = written(every.join(anchors, "a", "left_semi").join(origins, "doc_id", "left_semi").distinct())
    passages = shared.groupBy("a", "s1", "s2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    crowds = passages.groupBy("a").agg(F.min("first").alias("low"), F.max("last").alias("high"), F.ceil(F.count("*") / SHARD).alias("parts")).filter("low < high")
    passages = written(passages.join(crowds.select("a", "parts"), "a"))
    shards = max(1, -(-passages.count() // SHARD))
    needs = shared.join(passages, ["a", "s1", "s2"]).groupBy("doc_id").agg(F.collect_list(F.struct("s1", "s2", "a", "first", "last", "parts")).alias("needs"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    touched = written(texts.join(needs, "doc_id"))
    # One shard per anchor, or, for an anchor with several parts, per part: it holds a part and is asked for all.
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    spread = _passages(touched, common, window).select("*", part)
    place = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("a"), F.lit(shards))).otherwise(F.xxhash64("a", "part"))
    sent = spread.select(place.alias("shard"), "s1", "s2", "first", "last", (F.pmod("s2", "parts") == F.col("part")).alias("held"), "words")
    sent = sent.repartition("shard").groupBy("shard")
    found = written(sent.applyInArrow(lambda group: _searched(group, window), "s1 bigint, s2 bigint, runs array<struct<at: bigint, windows: bigint, first: bigint>>"))
    hits = shared.join(found, ["s1", "s2"]).filter("exists(runs, r -> r.first < doc_id)")
    hits = hits.groupBy("doc_id").agg(F.collect_list(F.struct("s1", "s2", "runs")).alias("hits"))
    cut = _kept(touched.select("doc_id", "text").join(hits, "doc_id"), common, window).dropDuplicates(["doc_id", "d1", "d2"])
    copy = (F.col("doc_id") > F.col("least")) & (F.col("n_words") >= window)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("words")))
    spans = F.when(copy, whole).otherwise(F.coalesce("spans", F.filter(whole, lambda _: F.lit(False))))
    kept = F.when(copy, F.lit("")).otherwise(F.col("kept"))
    joined = rows.join(cut, ["doc_id", "d1", "d2"], "left").select("doc_id", "n_words", "digest", spans.alias("spans"), kept.alias("kept"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["words"])
    digest = F.when(F.col("kept").isNull(), F.col("digest")).otherwise(F.sha2(F.col("kept").cast("binary"), 256))
    return joined.select("doc_id", "n_words", removed.alias("n_removed"), "spans", "kept", digest.alias("kept_sha256"))


def repeat_report(docs: DataFrame) -> DataFrame:
    return repeated_passages(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")
