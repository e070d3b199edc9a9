"""Operator 1: word windows of a benchmark, found in documents by a broadcast hash set and verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import ALNUM, LOWER, hashes, mix, pieces, probe, stored, utf8, words

WINDOW = 10
# Benchmark text in one broadcast slice, which takes some five times this in memory; a larger benchmark is scanned in
# several slices of about this size.
SLICE_BYTES = 16 << 20
_ORDER = np.uint64(0x9E3779B97F4A7C15 | 1)

SPANS = "array<struct<begin:int,finish:int>>"
ADDED = f"n_words bigint, spans {SPANS}, items array<bigint>"


def _folded(hashed: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive word hashes."""
    out = np.zeros(max(0, len(hashed) - size + 1), np.uint64)
    for k in range(size):
        out = out * _ORDER + hashed[k : k + len(out)]
    return mix(out)


class Grams:
    """Windows of one benchmark slice: per length the sorted distinct hashes, and for each the places where it stands.

    A place is a stretch of the slice's words, joined by blanks, and the item it belongs to; so a window costs some twenty
    bytes whatever its length. A window that an item repeats has one place.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.owners = [item_id for item_id, _ in items]
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        joined, length = [], 0
        for number, (_, text) in enumerate(items):
            data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
            if not len(starts):
                continue
            size, raw = min(window, len(starts)), data.tobytes()
            hashed = _folded(hashes(data, starts, ends), size)
            until = np.cumsum(ends - starts + 1) - 1 + length
            begin = (until - (ends - starts))[: len(hashed)]
            found.setdefault(size, []).append((hashed, np.full(len(hashed), number, np.int32), begin, until[size - 1 :]))
            joined.append(b" ".join(raw[a:b] for a, b in zip(starts, ends, strict=True)))
            length += len(joined[-1]) + 1
        self.words = b" ".join(joined)
        self.keys, self.first, self.places = {}, {}, {}
        for size, parts in found.items():
            hashed, number, begin, until = (np.concatenate(column) for column in zip(*parts, strict=True))
            order = np.lexsort((number, hashed))
            order = order[self._new(hashed[order], number[order], begin[order], until[order])]
            self.keys[size], first = np.unique(hashed[order], return_index=True)
            self.first[size] = np.append(first, len(order))
            self.places[size] = np.stack([number[order], begin[order], until[order]]).astype(np.int32)

    def _new(self, hashed: np.ndarray, number: np.ndarray, begin: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Which places are no repetition of a text that the same item has already."""
        new, last, texts = np.ones(len(hashed), bool), -1, set()
        for i in (np.flatnonzero((hashed[1:] == hashed[:-1]) & (number[1:] == number[:-1])) + 1).tolist():
            if i != last + 1 or not texts:
                texts = {self.words[begin[i - 1] : until[i - 1]]}
            text, last = self.words[begin[i] : until[i]], i
            new[i] = text not in texts
            texts.add(text)
        return new

    def items_with(self, size: int, key: int, text: bytes) -> list[int | None]:
        """Items that hold this very text, of the places under one hash."""
        low, high = self.first[size][key], self.first[size][key + 1]
        return [self.owners[n] for n, a, b in self.places[size][:, low:high].T.tolist() if self.words[a:b] == text]


def _scan(batch: pa.RecordBatch, grams: Grams, column: str) -> tuple[list[int], list[list], list[list[int]]]:
    """Words, hit runs of words, and items of each row; every hash match is compared word by word."""
    data, at = utf8(batch.column(batch.schema.get_field_index(column)))
    data = LOWER[data]
    starts, ends, counts = words(data, at, ALNUM)
    hashed = hashes(data, starts, ends)
    first = np.concatenate([[0], np.cumsum(counts)])
    raw = None
    hits: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[int]] = {}
    for size, keys in grams.keys.items():
        windows = _folded(hashed, size)
        found = probe(keys, windows)
        candidates = np.flatnonzero(found >= 0)
        if not len(candidates):
            continue
        rows = np.searchsorted(first, candidates, side="right") - 1
        inside = candidates + size <= first[rows + 1]
        raw = raw if raw is not None else data.tobytes()
        for i, row in zip(candidates[inside].tolist(), rows[inside].tolist(), strict=True):
            text = b" ".join(raw[a:b] for a, b in zip(starts[i : i + size], ends[i : i + size], strict=True))
            owners = grams.items_with(size, int(found[i]), text)
            if owners:
                low = i - int(first[row])
                hits.setdefault(row, []).append((low, low + size))
                items.setdefault(row, set()).update(o for o in owners if o is not None)
    runs = [_union(hits.get(row, [])) for row in range(len(counts))]
    return counts.tolist(), runs, [sorted(items.get(row, ())) for row in range(len(counts))]


def _union(runs: list) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for low, high in sorted(runs):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _slices(benchmark: DataFrame, id_column: str, text_column: str, slice_bytes: int) -> Iterator[list]:
    items = benchmark.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t")).filter("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = -(-size // slice_bytes) or 1
    for k in range(count):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k)
        yield [(r.i, r.t) for r in part.toLocalIterator()]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (hit runs of word numbers, end exclusive) and ``items`` (sorted ids).

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lowered. Windows of ``window``
    words of the benchmark, or all words of a shorter item, form a hash set that is broadcast in slices of about
    ``slice_bytes`` of benchmark text, cut by item; documents pass over one slice after the other and nothing is shuffled.
    Null text has no words. Repeated or equal items count by their ids; an item without id marks words but is not listed.
    Columns of ``docs`` named like the added ones are replaced.
    """
    context = docs.sparkSession.sparkContext
    names = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    docs = docs.select(*names).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast(SPANS), "items": F.array().cast("array<bigint>")})
    schema = docs.schema
    step = 0
    for part in _slices(benchmark, item_column, item_text, slice_bytes):
        held = context.broadcast(Grams(part, window))
        docs = (stored(docs) if step else docs).mapInArrow(_scanner(held, text_column), schema)
        step += 1
    return docs


def _scanner(held, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, column):
                counts, runs, items = _scan(part, held.value, column)
                old = part.select(["spans", "items"]).to_pylist() if part.num_rows else []
                runs = [_union(new + [(s["begin"], s["finish"]) for s in o["spans"]]) for new, o in zip(runs, old, strict=True)]
                items = [sorted({*new, *o["items"]}) for new, o in zip(items, old, strict=True)]
                spans = [[{"begin": a, "finish": b} for a, b in r] for r in runs]
                made = {"n_words": counts, "spans": spans, "items": items}
                columns = [
                    pa.array(made[f.name], f.type) if f.name in made else part.column(i) for i, f in enumerate(part.schema)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return run


def _packed(docs: DataFrame, text_column: str) -> DataFrame:
    """All columns as one, so that none can clash with what is added, and the text."""
    return docs.select(F.struct(*docs.columns).alias("_kept"), F.col(text_column).alias("_text"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` without any hit, with their own columns."""
    found = find_contamination(_packed(docs, text_column), benchmark, text_column="_text", **options)
    return found.filter(F.size("spans") == 0).select("_kept.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """``docs`` with the text of every hit run, and what stands between its words, cut out."""
    found = find_contamination(_packed(docs, text_column), benchmark, text_column="_text", **options)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "_text"):
                data, at = utf8(part.column(part.schema.get_field_index("_text")))
                starts, ends, counts = words(LOWER[data], at, ALNUM)
                first = np.concatenate([[0], np.cumsum(counts)])
                raw, out = data.tobytes(), []
                for row, spans in enumerate(part.column("spans").to_pylist()):
                    kept, low = [], int(at[row])
                    for span in spans:
                        kept.append(raw[low : starts[first[row] + span["begin"]]])
                        low = int(ends[first[row] + span["finish"] - 1])
                    out.append(b"".join([*kept, raw[low : at[row + 1]]]).decode())
                missing = part.column(part.schema.get_field_index("_text")).is_null().to_pylist()
                texts = pa.array([None if gone else text for gone, text in zip(missing, out, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("_kept")), texts], ["_kept", "_cut"])

    kept = found.schema["_kept"].dataType.simpleString()
    cut = found.select("_kept", "_text", "spans").mapInArrow(run, f"_kept {kept}, _cut string")
    return cut.select(*(F.col("_cut").alias(c) if c == text_column else F.col(f"_kept.{c}") for c in docs.columns))


def items_digest(items):
    """sha256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ",").cast("binary"), 256)


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    found = find_contamination(docs.select("doc_id", "text"), benchmark, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + (s["finish"] - s["begin"]))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        items_digest(F.col("items")).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )

