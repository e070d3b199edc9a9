"""The near-copy stage: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, found exactly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import LOWER, NOT_BLANK, discard, hashes, mix, pieces, probe, release, utf8, words, written
from molframe.llm.components import components
from molframe.llm.simhash import near_links

SHINGLE = 5
# Similarity as a fraction, so that no pair at the very limit depends on rounding.
PART, WHOLE = 4, 5
# Rows that the order of shingles is estimated on, and the frequent shingles it knows. Neither changes which pairs are found.
SAMPLE_ROWS = 4000
COMMON = 1 << 16
# A set of n shingles lists n / EVIDENCE more of them than one shared shingle takes, and has to share as many more.
EVIDENCE = 10
# Orders by which a crowded cell chooses the document that all others are compared with first.
CENTRES = 8
# Nodes of a cell that one task compares; larger cells are compared part by part.
CELL = 2048
# Links that each root of a cell may propose in the first round, and how much more in each later one.
FIRST_LINKS, MORE_LINKS = 1, 32
# Pairs held at once while the best of a cell are sought, and hashes whose bits are counted at once.
HELD_PAIRS = 1 << 18
BITS_STEP = 1 << 16
# Bits that tell where sets are made which of them are needed.
BITMAP = 1 << 25
# Bytes of text whose sets are made at once: they bound a worker's memory only.
PIECE = 1 << 20
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)


def shingle_sets(array: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text; a text of fewer words is one shingle, no words are none."""
    data, at = utf8(array)
    data = LOWER[data]
    starts, ends, counts = words(data, at, NOT_BLANK)
    hashed = np.concatenate([hashes(data, starts, ends), np.zeros(SHINGLE, np.uint64)])
    first = np.cumsum(counts) - counts
    width = np.minimum(counts, SHINGLE)
    sizes = np.where(counts > 0, counts - width + 1, 0)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) + np.repeat(first - begin, sizes)
    wide = np.repeat(width, sizes)
    total = wide.astype(np.uint64)
    for k in range(SHINGLE):
        total = total + np.where(k < wide, hashed[place + k] * _WEIGHTS[k], np.uint64(0))
    total = mix(total)
    return [np.unique(total[a : a + n]) for a, n in zip(begin.tolist(), sizes.tolist(), strict=True)]


def _node(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).astype(np.int64))


def _mapped(docs: DataFrame, keep: list[str], text_column: str, schema: str, columns) -> DataFrame:
    """``keep`` columns and what ``columns`` makes of the shingle sets of each row."""
    source = docs.select(*keep, F.col(text_column).alias("_text"))
    full = source.drop("_text").schema
    for field in docs.sparkSession.createDataFrame([], schema).schema:
        full = full.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text", PIECE):
                made = columns(shingle_sets(part.column(len(keep))))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], full.names)
        release()

    return source.mapInArrow(run, full)


def _nested(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _nodes(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([_node(s) for s in sets], pa.int64())


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sampled rows hold, sorted, and how many rows hold each."""
    rows = docs.count()
    part = max(1, rows // SAMPLE_ROWS)
    drawn = docs.select("text").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(part)) == 0)
    sets = _mapped(drawn, [], "text", "tokens array<bigint>", lambda sets: [_nested(sets)])
    counts = sets.select(F.explode("tokens").alias("t")).groupBy("t").count().filter("count > 2")
    found = counts.orderBy(F.desc("count"), "t").limit(COMMON).toArrow()
    keys, times = found["t"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(keys)
    return keys[order], times[order]


def parity(shingles: np.ndarray) -> bytes:
    """A bit for about each shingle, set if an odd number of shingles falls on it."""
    if not len(shingles):
        return b""
    width = 1 << max(3, (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def most_shared(size_a: int, odd_a: bytes, size_b: int, odd_b: bytes) -> int:
    """A bound on the shingles that two sets share: every bit that differs stands for one that they do not."""
    x, y = np.frombuffer(odd_a, np.uint8), np.frombuffer(odd_b, np.uint8)
    if not len(x) or not len(y):
        return 0
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    elif len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return (size_a + size_b - int(np.bitwise_count(x ^ y).sum())) // 2


def set_fingerprint(shingles: np.ndarray) -> int:
    """The SimHash fingerprint of a set, signed: a bit is 1 if set in over half the hashes."""
    total = np.zeros(64, np.int64)
    for low in range(0, len(shingles), BITS_STEP):
        part = shingles[low : low + BITS_STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(shingles), bitorder="little").view("<i8")[0])


def with_outlines(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, node, size, parity bits and fingerprint of the shingle set of each row."""

    def columns(sets: list[np.ndarray]) -> list[pa.Array]:
        prints = pa.array([set_fingerprint(s) for s in sets], pa.int64())
        return [_nodes(sets), pa.array([len(s) for s in sets], pa.int32()), pa.array([parity(s) for s in sets], pa.binary()), prints]

    return _mapped(docs, [*keep], "text", "node bigint, size int, odd binary, fp bigint", columns)


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that operator 2 joins: equal fingerprints, each to one node, and links of these by their bits.

    They are as many as the nodes at most, whatever the size of a group; the whole sets decide afterwards.
    """
    held = nodes.filter("size > 0").select("node", "fp")
    ends = held.groupBy("fp").agg(F.min("node").alias("end"))
    equal = held.join(ends, "fp").filter("node <> end").select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b"))
    near = near_links(ends.select("fp"))
    near = near.join(ends.select(F.col("fp").alias("a"), F.col("end").alias("x")), "a").join(ends.select(F.col("fp").alias("b"), F.col("end").alias("y")), "b")
    return equal.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def early_shingles(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(place, node, t): the first shingles of each set, rare ones first; of equal sets in one task, one.

    Two sets of similarity PART/WHOLE share at least ceil(PART/WHOLE size) shingles of either, so under any one order of all
    shingles they share k within the first size - ceil(PART/WHOLE size) + k of each; k is 1 + size // EVIDENCE, the lesser of both
    sets' counting. ``place`` is the shingle, or, for
    one known as frequent, a hash of it and the node, and only then is ``t`` the shingle: those are spread over all tasks.
    """
    held = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = held.value
        done: set[int] = set()
        for batch in batches:
            for part in pieces(batch, "_text", PIECE):
                first, nodes, counts = [np.zeros(0, np.uint64)], [], []
                for s in shingle_sets(part.column(0)):
                    if (node := _node(s)) in done:
                        continue
                    done.add(node)
                    if len(keys):
                        spot = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                        s = s[np.argsort(np.where(keys[spot] == s, times[spot], 0), kind="stable")]
                    first.append(s[: len(s) - -(-PART * len(s) // WHOLE) + 1 + len(s) // EVIDENCE])
                    nodes.append(node)
                    counts.append(len(first[-1]))
                t, node = np.concatenate(first), np.repeat(np.array(nodes, np.int64), counts)
                known = probe(keys, t) >= 0
                place = np.where(known, mix(t + mix(node.view(np.uint64))), t).view(np.int64)
                for low in range(0, len(t), 1 << 16):
                    some = slice(low, low + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(place[some]), pa.array(node[some]), pa.array(t[some].view(np.int64), mask=~known[some])], ["place", "node", "t"])
        release()

    return docs.select(F.col("text").alias("_text")).mapInArrow(run, "place bigint, node bigint, t bigint")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (place, node, t) sorted by place and node: (t, node, times) of cells, shingles that several nodes hold, each node once.

    A cell is named after its nodes, so that two texts that share a thousand shingles meet in one cell and not in a thousand,
    and a task hands on a name once, with the number of its shingles. Cells that got one name by chance are one, which loses no
    pair. A shingle known as frequent, whose nodes are in many tasks, keeps its own name.
    """
    times: dict[int, int] = {}
    cells: list[tuple[np.ndarray, np.ndarray]] = []

    def cut(place: np.ndarray, node: np.ndarray, t: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        once = np.ones(len(place), bool)
        once[1:] = (place[1:] != place[:-1]) | (node[1:] != node[:-1])
        place, node, t, known = place[once], node[once], t[once], known[once]
        same = place[1:] == place[:-1]
        several = ~known & (np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        alone = pa.array(t[known]), pa.array(node[known]), pa.array(np.ones(int(known.sum()), np.int64))
        place, node = place[several], node[several]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(place)])
        sizes = np.diff(np.append(first, len(place)))
        names = np.add.reduceat(mix(node.view(np.uint64)), first).view(np.int64) if len(first) else first
        new = np.zeros(len(first), bool)
        for i, name in enumerate(names.tolist()):
            new[i] = name not in times
            times[name] = times.get(name, 0) + 1
        wide = np.repeat(new, sizes)
        cells.append((np.repeat(names, sizes)[wide], node[wide]))
        return pa.RecordBatch.from_arrays(list(alone), ["t", "node", "times"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        place, node = (batch.column(i).to_numpy() for i in (0, 1))
        known = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        columns = place, node, np.where(known, batch.column(2).fill_null(0).to_numpy(), place), known
        last = int(np.searchsorted(place, place[-1], side="left"))
        if last or (held and held[-1][0][-1] != place[0]):
            yield cut(*(np.concatenate(x) for x in zip(*held, [c[:last] for c in columns], strict=True)))
            held = []
        held.append(tuple(c[last:] for c in columns))
    if held:
        yield cut(*(np.concatenate(x) for x in zip(*held, strict=True)))
    for names, node in cells:
        count = np.array([times[name] for name in names.tolist()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(node), pa.array(count)], ["t", "node", "times"])
    del times, cells
    release()


def shared_cells(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(t, node) of the cells, of the nodes that can be similar to another.

    Such a node shares at least 1 + m // EVIDENCE of its early shingles, m being the size of the smallest set it can be similar to.
    Most nodes share a few by chance, or a passage: they are as many as pairs of documents, and are not handed on.
    """
    early = early_shingles(docs, common_shingles(docs))
    shared = early.repartition("place").sortWithinPartitions("place", "node").mapInArrow(_shared, "t bigint, node bigint, times bigint")
    shared = written(shared.groupBy("t", "node").agg(F.sum("times").alias("times")))
    least = F.expr(f"1 + ((size * {PART} + {WHOLE - 1}) div {WHOLE}) div {EVIDENCE}")
    counts = shared.groupBy("node").agg(F.sum("times").alias("times")).join(nodes.select("node", "size"), "node")
    made = written(shared.join(counts.filter(F.col("times") >= least), "node", "left_semi").select("t", "node"))
    discard(shared)
    return made


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, their sizes and parity bits): the pairs that can be of similarity PART/WHOLE or more."""
    for batch in batches:
        keep = []
        for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
            keep.append((PART + WHOLE) * most_shared(n, x, m, y) >= PART * (n + m))
        chosen = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(chosen), batch.column(1).filter(chosen)], ["a", "b"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, their sets): the pairs of similarity PART/WHOLE or more."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.asarray(x.values.to_numpy()), np.asarray(y.values.to_numpy())
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(WHOLE * both >= PART * (len(x) + len(y) - both))
        chosen = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(chosen), batch.column(1).filter(chosen)], ["a", "b"])


def _best(pairs: np.ndarray, likeness: np.ndarray, roots: np.ndarray, limit: int) -> np.ndarray:
    """Which of the ``pairs`` (two rows of places) are among the ``limit`` likeliest of one of their roots."""
    root = roots[pairs].ravel()
    order = np.lexsort((-np.concatenate([likeness, likeness]), root))
    first = np.flatnonzero(np.concatenate([[True], root[order][1:] != root[order][:-1]]))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    kept = np.zeros(len(order), bool)
    kept[order[rank < limit]] = True
    return kept[: len(likeness)] | kept[len(likeness) :]


def _close(nodes: np.ndarray, roots: np.ndarray, parts: np.ndarray, sizes: np.ndarray, odd: list[bytes], limit: int) -> tuple[np.ndarray, bool]:
    """Pairs of a cell that can be similar enough, of unequal roots and, in a cell of two parts, of unequal parts.

    Each root proposes its ``limit`` likeliest pairs, so they are as many as roots and not as pairs of them; the second result
    tells whether others were left out. By size, a node is compared with those of up to WHOLE/PART its size. Their parity bits are as many or twice as many;
    the latter are folded once.
    """
    order = np.argsort(sizes, kind="stable")
    nodes, roots, parts, sizes = nodes[order], roots[order], parts[order], sizes[order]
    widths = np.array([len(odd[i]) for i in order])
    bits = {w: np.frombuffer(b"".join(odd[i] for i in order if len(odd[i]) == w), np.uint8).reshape(-1, w) for w in np.unique(widths).tolist()}
    begin = {w: int(np.searchsorted(widths, w)) for w in bits}
    mixed = len(np.unique(parts)) > 1
    held, count, left_out = [(np.zeros((2, 0), np.int64), np.zeros(0))], 0, False

    def settle() -> None:
        nonlocal held, count, left_out
        pairs, likeness = np.concatenate([p for p, _ in held], axis=1), np.concatenate([x for _, x in held])
        kept = _best(pairs, likeness, roots, limit) if len(likeness) else np.zeros(0, bool)
        left_out |= not kept.all()
        held, count = [(pairs[:, kept], likeness[kept])], 0

    for i in range(len(nodes) - 1):
        end = int(np.searchsorted(sizes, sizes[i] * WHOLE // PART, side="right"))
        fit = (roots[i + 1 : end] != roots[i]) & (not mixed or parts[i + 1 : end] != parts[i])
        others = i + 1 + np.flatnonzero(fit)
        if not len(others):
            continue
        w = int(widths[i])
        own = bits[w][i - begin[w]]
        same = others[widths[others] == w]
        differing = [np.bitwise_count(bits[w][same - begin[w]] ^ own).sum(1, dtype=np.int64)]
        for wide in np.unique(widths[others]).tolist():
            if wide > w:
                folded = np.bitwise_xor.reduce(bits[wide][others[widths[others] == wide] - begin[wide]].reshape(-1, wide // w, w), axis=1)
                differing.append(np.bitwise_count(folded ^ own).sum(1, dtype=np.int64))
        total = sizes[others] + sizes[i]
        most = (total - np.concatenate(differing)) // 2
        fit = (PART + WHOLE) * most >= PART * total
        if fit.any():
            # The widths were taken in turn, and nodes of one width stand together.
            held.append((np.stack([np.full(int(fit.sum()), i), others[fit]]), most[fit] / (total[fit] - most[fit])))
            count += len(held[-1][1])
            if count > HELD_PAIRS:
                settle()
    settle()
    return np.sort(nodes[held[0][0]], axis=0).T, left_out


def _close_pairs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Of rows (t, low, high, part, node, root, size, odd) sorted by the first three: close pairs (a, b) of the cells.

    Rows without a pair name the cells that have more of them.
    """

    def cut(rows: pa.Table) -> pa.RecordBatch:
        keys = np.stack([rows[c].to_numpy() for c in ("t", "low", "high")])
        edge = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
        columns = [rows[c].to_numpy() for c in ("node", "root", "part", "size")]
        odd, found, more = rows["odd"].to_pylist(), [np.zeros((0, 2), np.int64)], []
        for a, b in zip(edge.tolist(), np.append(edge[1:], rows.num_rows).tolist(), strict=True):
            if (columns[1][a:b] != columns[1][a]).any():
                pairs, left_out = _close(*(c[a:b] for c in columns), odd[a:b], limit)
                found.append(pairs)
                more += [a] if left_out else []
        pairs = np.unique(np.concatenate(found), axis=0)
        made = [pa.concat_arrays([pa.array(np.ascontiguousarray(pairs[:, k])), pa.nulls(len(more), pa.int64())]) for k in (0, 1)]
        made += [pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(keys[k][more], pa.int64())]) for k in range(3)]
        return pa.RecordBatch.from_arrays(made, ["a", "b", "t", "low", "high"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
        last = int(np.flatnonzero((keys != keys[:, -1:]).any(0))[-1]) + 1 if (keys != keys[:, -1:]).any() else 0
        if last:
            yield cut(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        elif held and any(held[-1].column(k)[-1].as_py() != keys[k, 0] for k in range(3)):
            yield cut(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(last))
    if held:
        yield cut(pa.Table.from_batches(held))


def sets_of(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, tokens) of the nodes ``needed``.

    A bitmap of bounded size holds back most other sets where they are made, so that neither texts nor all sets are
    shuffled; what it lets through, the join drops.
    """
    byte = F.shiftright(F.pmod("node", F.lit(BITMAP)), 3).alias("byte")
    bit = F.call_function("shiftleft", F.lit(1), F.pmod("node", F.lit(8)).cast("int"))
    found = needed.groupBy(byte).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(BITMAP >> 3, np.uint8)
    bits[found["byte"].to_numpy()] = found["bits"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def columns(sets: list[np.ndarray]) -> list[pa.Array]:
        nodes = [_node(s) for s in sets]
        wanted = [held.value[n % BITMAP >> 3] >> (n % BITMAP & 7) & 1 for n in nodes]
        return [pa.array(nodes, pa.int64()), _nested([s if w else s[:0] for s, w in zip(sets, wanted, strict=True)]), pa.array([bool(w) for w in wanted])]

    made = _mapped(docs, [], "text", "node bigint, tokens array<bigint>, wanted boolean", columns).filter("wanted").drop("wanted")
    return written(made.join(needed, "node", "left_semi").dropDuplicates(["node"]))


def _verified(likely: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of similarity PART/WHOLE or more, told from the whole sets."""
    likely = written(likely.distinct())
    sets = sets_of(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct(), docs)
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    made = written(likely.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_similar, "a bigint, b bigint"))
    discard(likely, sets)
    return made


def similar_roots(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) of the nodes that pairs of similarity PART/WHOLE or more join to others: the smallest of each component.

    Operator 2 proposes links of fingerprints. Nodes that share an early shingle form a cell, one for all shingles with the same nodes, and each is compared with its
    cell's centre; both settle crowds of copies in linear work. Then those of a cell that are in different components are
    compared with each other, by size and parity bits. In rounds, each component of a cell proposes its likeliest links and
    is joined by those that hold; cells with more to propose go on, with more each time, until none is left out.
    Every link is verified on the whole sets. A round's links are joined to the roots so far, not to all links again.
    """
    shared = shared_cells(docs, nodes)
    centres = shared.groupBy("t").agg(F.min_by("node", F.xxhash64("node", F.pmod("t", F.lit(CENTRES)))).alias("centre"))
    near = shared.join(written(centres), "t").filter(F.col("centre") != F.col("node"))
    near = near.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
    ends = [nodes.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("odd").alias(f"odd_{n}")) for n in ("a", "b")]
    fit = F.least("size_a", "size_b") * WHOLE >= F.greatest("size_a", "size_b") * PART
    outlined = near.join(ends[0], "a").join(ends[1], "b").filter(fit).select("a", "b", "size_a", "size_b", "odd_a", "odd_b")
    likely = outlined.mapInArrow(_possible, "a bigint, b bigint")
    links = _verified(likely.unionByName(fingerprint_links(nodes)), docs)
    roots = written(components(links))
    placed = written(shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    discard(shared)
    cells = placed.groupBy("t").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.ceil(F.count("*") / CELL).alias("parts"))
    open_cells = written(cells.filter("least <> most").select("t", "parts"))
    rows = placed.join(open_cells, "t").withColumn("part", F.pmod("node", "parts"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    rows = rows.select("t", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "root")
    limit, tried, more = FIRST_LINKS, [], None
    while True:
        if more is not None:
            rest = rows.drop("root").join(more, ["t", "low", "high"], "left_semi")
            rest = rest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        dealt = (rows if more is None else rest).join(nodes.filter("size > 0").drop("fp"), "node")
        dealt = dealt.select("t", "low", "high", "part", "node", "root", "size", "odd")
        dealt = dealt.repartition("t", "low", "high").sortWithinPartitions("t", "low", "high")
        found = written(dealt.mapInArrow(partial(_close_pairs, limit=limit), "a bigint, b bigint, t bigint, low bigint, high bigint"))
        proposed = found.filter("a IS NOT NULL").select("a", "b").distinct()
        for earlier in tried:
            proposed = proposed.join(earlier.select("a", "b"), ["a", "b"], "left_anti")
        if not proposed.isEmpty():
            links = _verified(proposed, docs)
            last, roots = roots, written(components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))))
            discard(last)
        tried.append(found)
        more = found.filter("a IS NULL").select("t", "low", "high")
        if more.isEmpty():
            break
        limit *= MORE_LINKS
    discard(placed, open_cells, *tried)
    return roots


def group(docs: DataFrame) -> DataFrame:
    """(doc_id, print, node, root) of every row: rows have one root if links of similarity PART/WHOLE or more join them.

    Words are blank-separated and lower-cased in A-Z. Texts of equal shingle sets are joined first, so copies cost one row
    each; texts without words are one group. ``print`` is Spark's hash of the text.
    """
    rows = written(with_outlines(docs.select("doc_id", F.xxhash64("text").alias("print"), "text"), ("doc_id", "print")))
    nodes = written(rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("size", "odd", "fp"))))
    roots = similar_roots(docs, nodes)
    discard(nodes)
    named = rows.select("doc_id", "print", "node").join(roots, "node", "left")
    return named.select("doc_id", "print", "node", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each group, with all its columns; of equal ids and texts, any one.

    A row is told by its id and the hash of its text, so that whole rows are not sent through Python, and are shuffled once.
    """
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "node", "print")
    chosen = group(docs).groupBy("root").agg(F.min(order).alias("k")).select("k.doc_id", "k.print")
    doc = [F.col("doc_id").isNull().alias("_missing"), F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("_doc")]
    packed = docs.select(F.struct(*docs.columns).alias("_kept"), *doc, F.xxhash64("text").alias("_print"))
    key = ["_missing", "_doc", "_print"]
    kept = packed.join(chosen.select(*doc, F.col("print").alias("_print")), key, "left_semi")
    return kept.dropDuplicates(key).select("_kept.*")
