"""Operator 3: context-tree weighting over bytes, learned from a corpus and applied to whole texts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import LOWER, NOT_BLANK, discard, hashes, joined_words, pieces, probe, release, remainder, utf8, words, written

DEPTH = 5
# Contexts are dealt to tasks by their last two bytes; the levels above those have at most 256 * 255 nodes.
SPLIT = 2
BLANK, END = 0x20, 0x0A
# Bytes of text that share one table of prices, and grams of one task that builds the tree.
BLOCK = 40 << 20
GRAMS = 1 << 18
_PIECE = 1 << 19
_TOKEN = np.uint64(1 << 63)
_LN_HALF = math.log(0.5)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x >= 1/2, by a shift of seven and the asymptotic series."""
    z = x + 7
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    shift = x.copy()
    for k in range(1, 7):
        shift *= x + k
    return series - np.log(shift)


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The Krichevsky-Trofimov probability (ln) of a block of zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


@dataclass
class Level:
    """Nodes of one depth: code (context, then the bits of the byte so far behind a leading one), counts, and ln weighted.

    ``share`` is the weight that a node's own estimate has against its longer contexts.
    """

    code: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray
    share: np.ndarray

    def chance(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1.0)


def _nodes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight nodes on the way to each key's byte, and the bit taken at each."""
    byte, context = keys & np.uint64(255), keys >> np.uint64(8) << np.uint64(8)
    steps = range(8)
    code = np.stack([context | np.uint64(1 << k) | byte >> np.uint64(8 - k) for k in steps], 1)
    return code, np.stack([byte >> np.uint64(7 - k) & np.uint64(1) for k in steps], 1).astype(bool)


def _shorter(code: np.ndarray, depth: int) -> np.ndarray:
    """The node of the last ``depth`` bytes of context."""
    return code & np.uint64((1 << (8 * depth + 8)) - 1)


def deepest(keys: np.ndarray, counts: np.ndarray) -> Level:
    """The nodes of the full contexts of all grams that were learned."""
    learned = counts > 0
    code, bit = _nodes(keys[learned])
    code, inverse = np.unique(code.ravel(), return_inverse=True)
    times = np.repeat(counts[learned].astype(np.float64), 8)
    ones = np.bincount(inverse, times * bit.ravel(), len(code))
    zeros = np.bincount(inverse, times, len(code)) - ones
    return Level(code, zeros, ones, _estimate(zeros, ones), np.ones(len(code)))


def shortened(below: Level, depth: int) -> Level:
    """The nodes of contexts of ``depth`` bytes from those one byte longer.

    A node's weighted probability is half its own estimate and half the product over its longer contexts.
    """
    code, inverse = np.unique(_shorter(below.code, depth), return_inverse=True)
    zeros, ones, longer = (np.bincount(inverse, x, len(code)) for x in (below.zeros, below.ones, below.weighted))
    own = _estimate(zeros, ones)
    gap = longer - own
    mixed = _LN_HALF + np.maximum(longer, own) + np.log1p(np.exp(-np.abs(gap)))
    return Level(code, zeros, ones, mixed, 1 / (1 + np.exp(np.minimum(gap, 700.0))))


@dataclass
class Path:
    """For the nodes of a level: probability gained in shorter contexts, weight left for this and longer ones, and the
    chance of a one if the way ends here."""

    code: np.ndarray
    gained: np.ndarray
    left: np.ndarray
    final: np.ndarray
    next_gained: np.ndarray
    next_left: np.ndarray


def lengthened(level: Level, depth: int, above: Path | None) -> Path:
    """The same for the nodes of ``level`` from those one byte shorter."""
    gained, left = np.zeros(len(level.code)), np.ones(len(level.code))
    if above is not None:
        place = np.searchsorted(above.code, _shorter(level.code, depth - 1))
        gained, left = above.next_gained[place], above.next_left[place]
    chance = level.chance()
    return Path(level.code, gained, left, gained + left * chance, gained + left * level.share * chance, left * (1 - level.share))


def log_chances(keys: np.ndarray, paths: list[tuple[int, Path]]) -> np.ndarray:
    """log10 probability of each gram: every bit is told by the deepest node on its way that was learned, or by a half."""
    code, bit = _nodes(keys)
    one = np.full(code.shape, 0.5)
    open_ = np.ones(code.shape, bool)
    for depth, path in sorted(paths, key=lambda x: -x[0]):
        if not len(path.code):
            continue
        place = probe(path.code, _shorter(code[open_], depth))
        found = open_.copy()
        found[open_] = place >= 0
        one[found] = path.final[place[place >= 0]]
        open_ &= ~found
    return np.log10(np.where(bit, one, 1 - one)).sum(1)


def tree_prices(keys: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """log10 probability of each gram (``depth`` bytes of context and a byte) under the tree of all grams."""
    levels = [deepest(keys, counts)]
    for d in range(depth - 1, -1, -1):
        levels.insert(0, shortened(levels[0], d))
    paths, above = [], None
    for d, level in enumerate(levels):
        above = lengthened(level, d, above)
        paths.append((d, above))
    return log_chances(keys, paths)


def _streams(docs: DataFrame, keep: list[str], learned: Column, text_column: str) -> DataFrame:
    """info (the ``keep`` columns), learned, block, size and body: the lower-cased words joined by one blank, compressed."""
    blocks = max(1, -(-(docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0) // BLOCK))
    place = F.pmod(F.xxhash64(*keep, text_column), F.lit(blocks))
    source = docs.select(F.struct(*keep).alias("info"), F.coalesce(learned, F.lit(False)).alias("learned"), place.alias("block"), F.col(text_column).alias("_text"))
    schema = source.drop("_text").withColumns({"size": F.lit(0), "body": F.lit(b"")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for part in pieces(batch, "_text", _PIECE):
                data, at = utf8(part.column(3))
                data = LOWER[data]
                text = joined_words(data, *words(data, at, NOT_BLANK)).cast(pa.large_binary())
                sizes = np.diff(utf8(text)[1]).astype(np.int32)
                body = pa.array([codec.compress(x.as_buffer(), asbytes=True) if n else b"" for x, n in zip(text, sizes.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sizes), body], schema.names)
        release()

    return source.mapInArrow(run, schema)


@dataclass
class Uses:
    """Every use of a token or gram in some rows of a block: its row and key, tokens first, whose highest bit is set."""

    rows: slice
    tokens: int
    owner: np.ndarray
    key: np.ndarray
    bytes: np.ndarray


def _uses(group: pa.Table, depth: int) -> Iterator[Uses]:
    """The keys of the rows of a block, about _PIECE bytes at a time.

    A text is coded as its bytes and one END after ``depth`` END bytes of context; the end is one more token.
    """
    codec = pa.Codec("zstd")
    sizes = group["size"].to_numpy().astype(np.int64)
    bodies = group["body"].combine_chunks()
    total, low = np.concatenate([[0], np.cumsum(sizes)]), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(total, total[low] + _PIECE, side="right")) - 1)
        size, lead = sizes[low:high], bytes([END]) * depth
        parts = []
        for i in range(low, high):
            parts += [lead, codec.decompress(bodies[i].as_buffer(), int(sizes[i]), asbytes=True) if sizes[i] else b"", bytes([END])]
        data = np.frombuffer(b"".join(parts), np.uint8)
        row = np.repeat(np.arange(high - low), size + depth + 1)
        step = np.arange(len(data)) - np.repeat(np.cumsum(size + depth + 1) - (size + depth + 1), size + depth + 1)
        coded = np.flatnonzero(step >= depth)
        grams = np.zeros(len(coded), np.uint64)
        for back in range(depth + 1):
            grams |= data[coded - back].astype(np.uint64) << np.uint64(8 * back)
        at = np.append(np.flatnonzero(step == 0), len(data))
        starts, ends, counts = words(data, at, NOT_BLANK)
        tokens = np.maximum(hashes(data, starts, ends) >> np.uint64(1), np.uint64(1)) | _TOKEN
        rows = np.arange(high - low)
        yield Uses(slice(low, high), len(tokens) + high - low, np.concatenate([np.repeat(rows, counts), rows, row[coded]]), np.concatenate([tokens, np.full(high - low, _TOKEN), grams]), size + 1)
        low = high


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _needed(group: pa.Table, depth: int) -> pa.Table:
    """(block, key, n): the tokens and grams of a block and how often its learned rows use them."""
    learned = group["learned"].to_numpy(zero_copy_only=False).astype(bool)
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for some in _uses(group, depth):
        teaches = learned[some.rows][some.owner]
        taught, times = _counted(some.key[teaches])
        other = _counted(some.key[~teaches])[0]
        held += [(taught, times), (other, np.zeros(len(other), np.int64))]
        waiting += len(taught) + len(other)
        if waiting > max(1 << 20, len(keys)):
            keys, counts = _merged(*(np.concatenate(x) for x in zip((keys, counts), *held, strict=True)))
            held, waiting = [], 0
    keys, counts = _merged(*(np.concatenate(x) for x in zip((keys, counts), *held, strict=True)))
    block = pa.array(np.full(len(keys), group["block"][0].as_py(), np.int64))
    del held
    release()
    return pa.table([block, pa.array(keys.view(np.int64)), pa.array(counts)], names=["block", "key", "n"])


class Prices:
    """Values by key in slots of a table twice as large; a key lies in the first free slot from its own on."""

    EMPTY = np.uint64((1 << 64) - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, self.EMPTY)
        self.values = np.zeros(1 << self.bits)
        slot, rest = self._first(keys), np.arange(len(keys))
        while len(rest):
            free = self.keys[slot] == self.EMPTY
            self.keys[slot[free]] = keys[rest[free]]
            placed = self.keys[slot] == keys[rest]
            self.values[slot[placed]] = values[rest[placed]]
            slot, rest = self._next(slot[~placed]), rest[~placed]

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return slot + 1 & (1 << self.bits) - 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key lies; all of them are there."""
        out = self._first(keys)
        rest = np.flatnonzero(self.keys[out] != keys)
        while len(rest):
            out[rest] = self._next(out[rest])
            rest = rest[self.keys[out[rest]] != keys[rest]]
        return out


def _levels(group: pa.Table, depth: int, split: int) -> tuple[np.ndarray, list[Level]]:
    keys = group["key"].to_numpy().view(np.uint64)
    levels = [deepest(keys, group["n"].to_numpy())]
    for d in range(depth - 1, split - 1, -1):
        levels.insert(0, shortened(levels[0], d))
    return keys, levels


_NODE = "code bigint, zeros double, ones double, weighted double"


def _as_table(level: Level) -> pa.Table:
    return pa.table([pa.array(level.code.view(np.int64)), *(pa.array(x.astype(np.float64)) for x in (level.zeros, level.ones, level.weighted))], names=["code", "zeros", "ones", "weighted"])


def _as_level(table: pa.Table) -> Level:
    code, *rest = (table[c].to_numpy() for c in ("code", "zeros", "ones", "weighted"))
    order = np.argsort(code)
    return Level(code[order].view(np.uint64), *(x[order] for x in rest), np.ones(len(code)))


def _shortener(depth: int) -> Callable[[pa.Table], pa.Table]:
    return lambda group: _as_table(shortened(_as_level(group), depth))


def gram_prices(grams: DataFrame, depth: int) -> DataFrame:
    """(key, price): log10 probability of every gram's byte after its context under the tree of all learned grams.

    Every node of a byte's eight decisions has a tree of contexts of its own. Grams are dealt by the last SPLIT bytes of
    context, so a task has whole subtrees: it mixes them from the longest contexts to that depth. The levels above have
    at most 256 * 255 nodes, mixed per last byte and then at the root. From there the shares multiply along the way back
    to the longest contexts. Where learned rows lack a longer context, the way ends at the shorter one; a decision that
    they never met costs one bit.
    """
    split = min(SPLIT, depth)
    buckets = max(1, -(-grams.count() // GRAMS))
    context = F.shiftright("key", 8).bitwiseAND((1 << (8 * split)) - 1)
    dealt = grams.withColumn("bucket", F.pmod(F.xxhash64(context), F.lit(buckets)))
    top = dealt.groupBy("bucket").applyInArrow(lambda group: _as_table(_levels(group, depth, split)[1][0]), _NODE)
    for d in range(split - 1, 0, -1):
        part = F.shiftright("code", 8).bitwiseAND((1 << (8 * d)) - 1)
        top = top.groupBy(part.alias("part")).applyInArrow(_shortener(d), _NODE)
    short = [_as_level(top.toArrow())]
    if split:
        short.insert(0, shortened(short[0], 0))
        if split > 1:
            # The shares of these nodes come from their own estimate and their weighted value.
            own = _LN_HALF + _estimate(short[1].zeros, short[1].ones)
            short[1].share = np.exp(np.minimum(own - short[1].weighted, 0.0))
        else:
            short.pop()
    paths: list[tuple[int, Path]] = []
    for d, level in enumerate(short):
        paths.append((d, lengthened(level, d, paths[-1][1] if paths else None)))
    held = grams.sparkSession.sparkContext.broadcast(paths)

    def run(group: pa.Table) -> pa.Table:
        known = [x for x in held.value if x[0] < split]
        keys, levels = _levels(group, depth, split)
        more, above = [], known[-1][1] if known else None
        for d, level in enumerate(levels, split):
            above = lengthened(level, d, above)
            more.append((d, above))
        made = pa.table([pa.array(keys.view(np.int64)), pa.array(log_chances(keys, [*known, *more]))], names=["key", "price"])
        del levels, more, above
        release()
        return made

    return dealt.groupBy("bucket").applyInArrow(run, "key bigint, price double")


def _scored(docs: pa.Table, prices: pa.Table, depth: int, unknown: float, names: list[str]) -> pa.Table:
    """The rows of a block with the sums of their prices; tokens above the price ``unknown`` were learned."""
    table = Prices(prices["key"].to_numpy().view(np.uint64), prices["price"].to_numpy())
    del prices
    sums: list[list[np.ndarray]] = [[] for _ in range(5)]
    for some in _uses(docs, depth):
        slot, count = table.slots(some.key), len(some.bytes)
        tokens = some.tokens
        price = table.values[slot]
        known = price[:tokens] > unknown
        for out, owner, weight in ((0, some.owner[:tokens], None), (1, some.owner[:tokens], known), (2, some.owner[:tokens], price[:tokens]), (3, some.owner[tokens:], price[tokens:])):
            sums[out].append(np.bincount(owner, weight, count))
        sums[4].append(some.bytes)
    n_tokens, n_known, base, score, size = (np.concatenate(x) for x in sums)
    made = [n_tokens.astype(np.int64), np.rint(n_known).astype(np.int64), base.astype(np.float64), score.astype(np.float64), size.astype(np.int64)]
    del table
    release()
    return pa.table([*docs["info"].combine_chunks().flatten(), *map(pa.array, made)], names=names)


def score_documents(docs: DataFrame, learned: Column, keep: list[str], depth: int = DEPTH, text_column: str = "text") -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row.

    Texts are lower-cased in A-Z and read as blank-separated tokens and one end. The model codes the bytes of the tokens,
    joined by one blank, and an end, by context-tree weighting over the ``depth`` bytes before each, whatever token they
    belong to. The base score is the add-0.1 unigram of the learned tokens.

    Documents are dealt to blocks of about BLOCK bytes. A block names each of its tokens and grams once, with the count
    in its learned rows; these counts are summed over all blocks, priced once each, and sent back to the blocks that
    need them, where the prices are summed per row. So what travels is texts and the distinct grams of each block.

    A null or empty text costs one end. Texts of any length are read in whole. Equal rows are scored each; an empty table
    gives an empty result, and without learned rows every decision costs one bit.
    """
    streams = _streams(docs, keep, learned, text_column)
    needs = written(streams.select("block", "learned", "size", "body").groupBy("block").applyInArrow(lambda group: _needed(group, depth), "block bigint, key bigint, n bigint"))
    counted = written(needs.groupBy("key").agg(F.sum("n").alias("n")))
    of_tokens = counted.filter("key < 0")
    totals = of_tokens.agg(F.sum("n").alias("tokens"), F.count(F.when(F.col("n") > 0, 1)).alias("kinds")).first()
    tokens, kinds = int(totals["tokens"] or 0), int(totals["kinds"])
    base = F.log10((F.col("n") + 0.1) / (tokens + 0.1 * (kinds + 1)))
    priced = written(of_tokens.select("key", base.alias("price")).unionByName(gram_prices(counted.filter("key >= 0"), depth)))
    discard(counted)
    # Half way between a token that learned rows lack and one that they have once.
    unknown = math.log10(0.5 / (tokens + 0.1 * (kinds + 1)))
    kept = docs.select(*keep).schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"), ("_bytes", "long")):
        kept = kept.add(name, kind)
    names = kept.names
    sent = needs.select("block", "key").join(priced, "key")
    found = streams.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(lambda left, right: _scored(left, right, depth, unknown, names), kept)
    bits = -F.col("score") / math.log10(2) / F.col("_bytes")
    return found.select(*keep, "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def held_out_report(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Scores of all documents by what nine in ten of them, chosen by the checksum of doc_id, teach."""
    rows = docs.select("doc_id", "text", (remainder(F.col("doc_id"), 10) == 0).alias("held_out"))
    return score_documents(rows, ~F.col("held_out"), ["doc_id", "held_out"], depth)
