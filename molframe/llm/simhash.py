"""Operator 2: 64-bit SimHash fingerprints, linked by multi-index hashing and joined into components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import stored
from molframe.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
# Two halves: at three differing bits or fewer, one half differs in one bit at most.
HALF_BITS = 32
CELL = 1024
_STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit value; no words give zero."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = list(accumulate((len(p) + 1 for p in parts), initial=0))
    width = min(shingle, len(parts))
    count, total = len(parts) - width + 1, np.zeros(64, np.int64)
    for low in range(0, count, _STEP):
        high = min(count, low + _STEP)
        spans = zip(ends[low:high], ends[low + width : high + width], strict=True)
        hashed = np.array([xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in spans], "<u8")
        total += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > count, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, text_column: str = "text", name: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) of ``docs`` and the fingerprint as a long, in one pass over the texts."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != name]
    source = docs.select(*keep, F.col(text_column).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(t.as_py()) for t in batch.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], made], [*keep, name])

    return source.mapInArrow(run, source.drop("_text").withColumn(name, F.lit(0).cast("long")).schema)


def _half(column: str, half: int):
    bits = F.col(column) if half == 0 else F.shiftright(column, HALF_BITS)
    return bits.bitwiseAND((1 << HALF_BITS) - 1)


def _cells(points: DataFrame) -> DataFrame:
    """The index: per half and its value the fingerprints, in cells of about ``CELL`` so that crowds are spread."""
    rows = points.select("fp", F.explode(F.array(*(F.struct(F.lit(h).alias("half"), _half("fp", h).alias("value")) for h in (0, 1)))).alias("k"))
    rows = rows.select("k.half", "k.value", "fp")
    crowds = rows.groupBy("half", "value").count().filter(F.col("count") > CELL)
    crowds = crowds.select("half", "value", F.ceil(F.col("count") / CELL).alias("parts"))
    rows = rows.join(crowds, ["half", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cell = F.pmod(F.xxhash64("fp"), "parts").cast("int").alias("cell")
    return rows.groupBy("half", "value", cell).agg(F.collect_list("fp").alias("fps"))


def _linked(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Links that join the fingerprints of two cells as all close pairs would: each to the least of its group."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    if not near.any():
        return np.zeros((0, 2), np.int64)
    left, right = a.view(np.int64).copy(), b.view(np.int64).copy()
    top = np.iinfo(np.int64).max
    while True:
        new_right = np.minimum(right, np.where(near, left[:, None], top).min(0))
        new_left = np.minimum(left, np.where(near, new_right[None, :], top).min(1))
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    pairs = np.concatenate([np.stack([a.view(np.int64), left], 1), np.stack([b.view(np.int64), right], 1)])
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _verify(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.zeros((0, 2), np.int64)]
        for a, b in zip(batch.column(0), batch.column(1), strict=True):
            found.append(_linked(*(np.asarray(x.values.to_numpy(), np.int64).view(np.uint64) for x in (a, b)), radius))
        links = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])


def near_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` at ``radius`` bits or fewer.

    The index holds each fingerprint under both of its 32-bit halves. Every half value present probes the ball of radius
    one around it: itself, and each value with one more bit set (the other direction is the same pair). Probes are
    values, not fingerprints, and meet the list of present values first, so only matching cells travel. Cells of crowded
    values hold about ``CELL`` fingerprints each and meet in pairs of cells; a pair reports a spanning set of its links.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two halves and a ball of one bit reach radius 3")
    cells = stored(_cells(points))
    values = cells.select("half", "value").distinct()
    ball = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(HALF_BITS - 1)), lambda i: F.col("value").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))),
        lambda v: v != F.col("value"),
    )
    probes = values.select("half", "value", F.explode(ball).alias("other"))
    matched = probes.join(values.select("half", F.col("value").alias("other")), ["half", "other"], "left_semi")
    left = cells.select("half", "value", F.col("cell").alias("cell_a"), F.col("fps").alias("a"))
    right = cells.select("half", F.col("value").alias("other"), F.col("cell").alias("cell_b"), F.col("fps").alias("b"))
    near = matched.join(left, ["half", "value"]).join(right, ["half", "other"]).select("a", "b")
    same = (
        left.join(right.withColumnRenamed("other", "value"), ["half", "value"])
        .filter("cell_a < cell_b OR (cell_a = cell_b AND size(a) > 1)")
        .select("a", "b")
    )
    return same.unionByName(near).mapInArrow(lambda batches: _verify(batches, radius), "a bigint, b bigint")


def group(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``rows`` (doc_id, fp) with ``component_id``, the smallest doc_id that links of ``radius`` bits reach.

    Equal fingerprints are joined first, so copies cost one row each. A null doc_id takes part and never becomes a
    component id unless no other row of its component has one. An empty table gives an empty result.
    """
    points = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(points, radius))
    rooted = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id", "root")
    return rows.join(named, "fp")


def fingerprint_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    rows = stored(with_fingerprints(docs.select("doc_id", "text"), keep=["doc_id"]))
    return group(rows, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The row with the smallest doc_id of each group, with all its columns; of equal ids and prints, any one.

    Rows of the same group that share the smallest doc_id but not the fingerprint are settled by the fingerprint.
    """
    rows = stored(with_fingerprints(docs.select("doc_id", "text"), keep=["doc_id"]))
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "fp")
    chosen = group(rows, radius).groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.fp").alias("_print"))
    packed = docs.select(F.struct(*docs.columns).alias("_kept"), F.col("doc_id").alias("_doc"), "text")
    marked = with_fingerprints(packed, name="_fp", keep=["_kept", "_doc"])
    kept = marked.join(chosen, F.col("_fp").eqNullSafe(F.col("_print")) & F.col("_doc").eqNullSafe(F.col("_id")))
    return kept.dropDuplicates(["_doc", "_fp"]).select("_kept.*")
