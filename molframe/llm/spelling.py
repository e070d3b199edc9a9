"""Operator 12: spelling variants of a corpus's words, found by PartEnum signatures of their letter multisets."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import LOWER, hashes, mix, pieces, utf8, written

LEAST_LETTERS = 6
LEAST_COUNT = 5
# A form must be this many times as frequent as the word that it replaces.
FORM_FACTOR = 5
# Letter multisets of words one edit apart differ in at most two places of their binary vectors.
DISTANCE = 2
# Partitions of the vector's places; a signature is the vector without ``DISTANCE`` of them.
PARTITIONS = 6
_MISSPELT = 199

_BYTES = np.arange(256)
_LETTER = ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES == 0xC3)
_TRAIL = (_BYTES >= 0x80) & (_BYTES <= 0xBF)


def letter_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and code points of every maximal run of letters A-Z, a-z and U+00C0 to U+00FF.

    In UTF-8 the latter are the byte C3 and one trailing byte, so a byte belongs to a run if it is a letter byte or
    follows C3.
    """
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    padded = np.concatenate([[False], inside, [False]])
    starts = np.flatnonzero(padded[1:] & (~padded[:-1] | edge))
    ends = np.flatnonzero(padded[:-1] & (~padded[1:] | edge))
    points = np.concatenate([[0], np.cumsum(~_TRAIL[data])])
    return starts, ends, np.searchsorted(at, starts, side="right") - 1, points[ends] - points[starts]


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number per byte run and the distinct runs."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    flat = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)
    made = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[flat])]).dictionary_encode()
    return made.indices.to_numpy(zero_copy_only=False).astype(np.int64), made.dictionary


def _misspelt(word: bytes, mark: int) -> bytes:
    """The run without one code point that its checksum names."""
    letters = word.decode("utf-8", "replace")
    gone = mark % len(letters)
    return (letters[:gone] + letters[gone + 1 :]).encode("utf-8", "replace")


def word_counts(docs: DataFrame, text_column: str = "text", names: Column | None = None, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n): how often each run of at least ``least_letters`` letters occurs in all texts, lower-cased in A-Z.

    ``names`` (a text per row) makes one run in 199 of a row lose a letter, chosen by the checksum of both, as tests do.
    Counts are summed per piece of text and by Spark's partial aggregation before the shuffle.
    """
    marked = names is not None
    name = F.lit("") if names is None else F.coalesce(names.cast("string"), F.lit(""))
    source = docs.select(F.col(text_column).alias("_text"), name.alias("_name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                data, at = utf8(part.column(0))
                data = LOWER[data]
                starts, ends, rows, points = letter_runs(data, at)
                long = points >= least_letters
                codes, kinds = _distinct(data, starts[long], ends[long])
                counts, more = np.bincount(codes, minlength=len(kinds)), Counter()
                if marked:
                    spelt = kinds.to_pylist()
                    begun = [zlib.crc32(f"{x}:".encode()) for x in part.column(1).to_pylist()]
                    pairs, times = np.unique(rows[long] * max(1, len(kinds)) + codes, return_counts=True)
                    row, code = np.divmod(pairs, max(1, len(kinds)))
                    marks = np.fromiter((zlib.crc32(spelt[c], begun[r]) for r, c in zip(row.tolist(), code.tolist(), strict=True)), np.int64, len(pairs))
                    for i in np.flatnonzero(marks % _MISSPELT == 0).tolist():
                        counts[code[i]] -= times[i]
                        wrong = _misspelt(spelt[code[i]], int(marks[i]))
                        if len(wrong.decode()) >= least_letters:
                            more[wrong] += int(times[i])
                some = counts > 0
                yield pa.RecordBatch.from_arrays([kinds.filter(pa.array(some)).cast(pa.binary()), pa.array(counts[some])], ["word", "n"])
                if more:
                    yield pa.RecordBatch.from_arrays([pa.array(list(more), pa.binary()), pa.array(list(more.values()), pa.int64())], ["word", "n"])

    found = source.mapInArrow(run, "word binary, n bigint")
    return found.select(F.col("word").cast("string").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))


def signatures(words: pa.Array, ends: int, partitions: int = PARTITIONS, distance: int = DISTANCE) -> np.ndarray:
    """Two 64-bit signatures per word and choice of ``partitions - distance`` partitions.

    The binary vector of a word has a place for each (letter, how many of this letter came before). Places are dealt to
    partitions by a hash; a signature names the chosen partitions and all set places in them. Vectors that differ in at
    most ``distance`` places differ in at most as many partitions, so they agree in some choice of the others. One edit
    also leaves the first or the last ``ends`` letters of words twice as long as they are; each signature names one of them.
    """
    data, at = utf8(words)
    lead = np.flatnonzero(~_TRAIL[data])
    wide = np.concatenate([data, np.zeros(1, np.uint8)])
    letters = np.where(_TRAIL[wide[lead + 1]], wide[lead].astype(np.int64) << 8 | wide[lead + 1], wide[lead])
    owner = np.searchsorted(at, lead, side="right") - 1
    order = np.argsort(owner << 16 | letters, kind="stable")
    ranked = (owner << 16 | letters)[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    begin = np.flatnonzero(new)
    copy = np.arange(len(ranked)) - np.repeat(begin, np.diff(np.append(begin, len(ranked))))
    place = mix((ranked & 0xFFFF).astype(np.uint64) << np.uint64(32) | copy.astype(np.uint64) + np.uint64(1))
    cells = np.zeros((len(words), partitions), np.uint64)
    np.add.at(cells, (ranked >> 16, (place >> np.uint64(40)) % np.uint64(partitions)), mix(place + np.uint64(partitions)))
    first = np.searchsorted(owner, np.arange(len(words) + 1))
    edge = np.append(lead, len(data))
    sides = [hashes(data, at[:-1], edge[first[:-1] + ends]), hashes(data, edge[first[1:] - ends], at[1:])]
    chosen = list(combinations(range(partitions), partitions - distance))
    salt = mix(np.arange(1, partitions + 1, dtype=np.uint64))
    out = np.empty((len(words), 2 * len(chosen)), np.uint64)
    for i, some in enumerate(chosen):
        held = mix(cells[:, some] + salt[list(some)]).sum(1, dtype=np.uint64)
        for k, side in enumerate(sides):
            out[:, 2 * i + k] = mix(mix(held + np.uint64(2 * i + k)) + side)
    return out.view(np.int64)


def with_signatures(words: DataFrame, ends: int) -> DataFrame:
    """(sig, word): every signature of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1 << 14):
                part = batch.column(0).slice(low, 1 << 14)
                made = signatures(part, ends)
                rows = pa.array(np.repeat(np.arange(len(part)), made.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(made.ravel()), pc.take(part, rows)], ["sig", "word"])

    return words.select("word").mapInArrow(run, "sig bigint, word string")


def near_words(words: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(a, b), a < b: every pair of words that differ by one inserted, deleted or replaced code point.

    All words have ``least_letters`` code points or more. Words meet on equal signatures; those that share one only by
    chance are dropped by their edit distance. Signatures that many words share are split by Spark's skew join, so no
    group must fit a task. Spark sizes the signatures like the stored words, thirty times too low, so both sides are merged
    and none is sent to the driver.
    """
    left = with_signatures(words, least_letters // 2)
    right = left.select("sig", F.col("word").alias("other"))
    pairs = left.join(right.hint("merge"), "sig").filter("word < other AND abs(length(word) - length(other)) <= 1 AND levenshtein(word, other, 1) = 1")
    return pairs.select(F.col("word").alias("a"), F.col("other").alias("b")).distinct()


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: forms are followed to the last, twice as far in each round.

    A form is at least FORM_FACTOR times as frequent as its word, so there is no circle and few rounds. Stored tables are
    merged, here and below: Spark sizes them by their compressed files, which would bring too much to the driver.
    """
    steps = written(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = written(steps.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        steps = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return steps


def variant_groups(counts: DataFrame, least_count: int = LEAST_COUNT, factor: int = FORM_FACTOR, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``counts`` (word, n) with at least ``least_count`` occurrences and
    ``least_letters`` code points.

    ``form`` is the near word of largest n (ties: the smallest) if that is at least ``factor`` times the word's own,
    ``root`` where following forms ends. Words without a near word have no form and are their own root; an empty table
    gives an empty result.
    """
    known = written(counts.filter((F.col("n") >= least_count) & (F.length("word") >= least_letters)))
    pairs = written(near_words(known, least_letters))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    ranked = both.join(known.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), "near")
    best = ranked.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    matched = known.join(best.hint("merge"), "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= factor * F.col("n"), -F.col("best.less")))
    named = written(matched.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "form_n"))
    roots = _rooted(named.filter("form IS NOT NULL"))
    return named.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_report(docs: DataFrame) -> DataFrame:
    """Variant groups of the words of all texts, some of which lost a letter by the checksum of doc_id and word.

    Null and empty texts have no words; a missing doc_id counts as empty text; equal rows count each.
    """
    return variant_groups(word_counts(docs, names=F.col("doc_id")))
