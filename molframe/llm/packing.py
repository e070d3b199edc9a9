"""Operator 10: token ids packed into rows of one length by best fit decreasing over a segment tree."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import pieces

CAPACITY = 2048
# Tokens that one task gathers before it packs them; also what bounds its memory.
WINDOW_TOKENS = 2 << 20
ROWS_AT_ONCE = 256

PACKED = "bin_id bigint, ids binary, n_tokens int, cu_seqlens array<int>, position_ids binary, doc_ids array<bigint>, parts array<int>, rows array<bigint>"


class Capacities:
    """How many open bins have each remaining capacity, as a segment tree that finds the least one at or above a need."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, (capacity).bit_length())
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        node = self.size + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room that holds ``need``; of equals, the one opened or filled last."""
        node = self.size + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: items by falling length, each into the fullest bin that still holds it."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    rooms, bins = Capacities(capacity), []
    for item in order:
        need = lengths[item]
        found = rooms.take(need)
        if found is None:
            bins.append([])
            found = (capacity, len(bins) - 1)
        room, number = found
        bins[number].append(item)
        if room > need:
            rooms.put(room - need, number)
    return bins


# Fixed value: how the published byte-level vocabulary splits text before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_encoding(ranks: bytes, pattern: str = SPLIT):
    """A byte-level encoding from the lines of a rank file; special strings in a text are ordinary text."""
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


_ENCODINGS: dict[int, object] = {}
_LONG = 1 << 16


def _encode(encoding, text: str) -> np.ndarray:
    """Ids of one text; a long text goes in cuts before single blanks that separate letters, where no token can cross."""
    if len(text) <= _LONG:
        return np.array(encoding.encode_ordinary(text), np.uint32)
    out, low = [], 0
    while low < len(text):
        high = min(len(text), low + _LONG)
        while high < len(text):
            high = text.rfind(" ", low + 1, high)
            if high < 0:
                high = len(text)
            elif text[high - 1].isalpha() and text[high + 1 : high + 2].isalpha():
                break
        out += encoding.encode_ordinary(text[low:high])
        low = high
    return np.array(out, np.uint32)


def _packed(held: list[tuple[int, int | None, np.ndarray]], capacity: int, first: int) -> Iterator[pa.RecordBatch]:
    """Bins of one window: overlong texts are cut into whole rows and a rest, and all pieces go by best fit."""
    items = []
    for row, doc_id, ids in held:
        items += [(row, doc_id, k, ids[low : low + capacity]) for k, low in enumerate(range(0, len(ids), capacity))]
    bins = best_fit_decreasing([len(i[3]) for i in items], capacity)
    for low in range(0, len(bins), ROWS_AT_ONCE):
        columns: list[list] = [[] for _ in range(8)]
        for number, members in enumerate(bins[low : low + ROWS_AT_ONCE], first + low):
            inside = [items[m] for m in members]
            sizes = [len(i[3]) for i in inside]
            used = sum(sizes)
            ids = np.zeros(capacity, "<u4")
            ids[:used] = np.concatenate([i[3] for i in inside])
            places = np.zeros(capacity, "<i4")
            places[:used] = np.concatenate([np.arange(n) for n in sizes])
            made = (number, ids.tobytes(), used, np.cumsum([0, *sizes]).tolist(), places.tobytes(), [i[1] for i in inside], [i[2] for i in inside], [i[0] for i in inside])
            for column, value in zip(columns, made, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = ["bin_id", "ids", "n_tokens", "cu_seqlens", "position_ids", "doc_ids", "parts", "rows"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def pack_documents(
    docs: DataFrame,
    ranks_file: str,
    pattern: str = SPLIT,
    capacity: int = CAPACITY,
    end_token: int = 50256,
    id_column: str = "doc_id",
    text_column: str = "text",
    window_tokens: int = WINDOW_TOKENS,
) -> DataFrame:
    """One row per packed row of ``capacity`` tokens.

    Every text is encoded and closed by ``end_token``, cut without loss into pieces of at most ``capacity``, and packed
    with its neighbours: a task gathers ``window_tokens`` tokens (or one text, if longer) and packs them best fit
    decreasing. ``ids`` is the padded row of little-endian 32-bit ids, ``position_ids`` restarts at every segment,
    ``cu_seqlens`` are the cumulative segment lengths, ``n_tokens`` what is not padding; ``doc_ids``, ``parts`` and ``rows``
    (a number per input row, for repeated or missing ids) tell where each segment came from. Null and empty texts are one
    end token. No shuffle: packing is local to a task, so more tasks leave at most one underfilled row each per window.
    """
    with open(ranks_file, "rb") as file:
        held_ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((held_ranks.value, pattern))
        if key not in _ENCODINGS:
            _ENCODINGS[key] = load_encoding(held_ranks.value, pattern)
        encoding = _ENCODINGS[key]
        held, tokens = [], 0
        base = TaskContext.get().partitionId() << 33
        row, bins = base, base
        for batch in batches:
            for part in pieces(batch, "_text"):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(_encode(encoding, text or ""), np.uint32(end_token))
                    held.append((row, doc_id, ids))
                    row, tokens = row + 1, tokens + len(ids)
                    if tokens >= window_tokens:
                        for made in _packed(held, capacity, bins):
                            bins += made.num_rows
                            yield made
                        held, tokens = [], 0
        yield from _packed(held, capacity, bins)

    return source.mapInArrow(run, PACKED)


def segments(packed: DataFrame) -> DataFrame:
    """(row, doc_id, part, ids) of every segment, cut out of the packed rows again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for record in batch.to_pylist():
                ids, cuts = np.frombuffer(record["ids"], "<u4"), record["cu_seqlens"]
                members = zip(record["rows"], record["doc_ids"], record["parts"], cuts[:-1], cuts[1:], strict=True)
                rows += [(r, d, p, ids[a:b].tolist()) for r, d, p, a, b in members]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["row", "doc_id", "part", "ids"])

    return packed.mapInArrow(run, "row bigint, doc_id bigint, part int, ids array<int>")
