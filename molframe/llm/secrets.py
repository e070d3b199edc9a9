"""Operator 5: credential candidates, told apart by how many repositories and owners carry them."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import stored

KINDS = ("assign", "access", "hex", "owned")
HEX_KIND = 2
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
# Every ASSIGN match holds one of these, in either case; a text without them is not searched.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

# A value seen with this many owners, or in this many repositories, is a copied example.
WIDE = 5
# A live-looking value has at least this many bits per character; a hex run also holds a digit.
MIN_ENTROPY = 2.0
MASK = "<secret>"

SPAN = "struct<kind:int,begin:int,finish:int,value_begin:int,value_hash:bigint,live_looking:boolean>"


def candidates(text: str | None) -> list[tuple[int, int, int, int, str]]:
    """(kind, begin, end, begin of the value, value) in code points, by begin, then kind."""
    if not text:
        return []
    found = []
    folded = text.lower()
    if any(hint in folded for hint in ASSIGN_HINTS):
        found += [(0, m.start(), m.end(), m.start(1), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m.start(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    # A run is maximal either way, so asking for the length at once finds the same runs.
    found += [(2, m.start(), m.end(), m.start(), m[0]) for m in LONG_HEX.finditer(text)]
    return sorted(found, key=lambda c: (c[1], c[0]))


def live_looking(kind: int, value: str) -> bool:
    """Whether a value looks drawn at random: by its entropy, for hex runs by a digit too. Passwords and access keys need none."""
    counts = Counter(value).values()
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts)
    return bits >= MIN_ENTROPY and (kind != HEX_KIND or any(c.isdigit() for c in value))


def _hash(value: str) -> int:
    unsigned = xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass"))
    return unsigned - (1 << 64) if unsigned >> 63 else unsigned


def scan(docs: DataFrame, text_column: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, a row number that names the row, and its candidates; one pass, no shuffle."""
    source = docs.select(*keep, F.col(text_column).alias("_text"))
    schema = source.drop("_text").withColumns({"row": F.lit(0).cast("long"), "found": F.array().cast(f"array<{SPAN}>")}).schema
    names = ["kind", "begin", "finish", "value_begin", "value_hash", "live_looking"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, kinds = TaskContext.get().partitionId() << 33, None
        kinds = pa.list_(pa.struct([(n, t) for n, t in zip(names, [pa.int32()] * 4 + [pa.int64(), pa.bool_()], strict=True)]))
        for batch in batches:
            found = [
                [dict(zip(names, (k, a, b, v, _hash(s), live_looking(k, s)), strict=True)) for k, a, b, v, s in candidates(t.as_py())]
                for t in batch.column(len(keep))
            ]
            rows = pa.array(range(row, row + len(found)), pa.int64())
            row += len(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], rows, pa.array(found, kinds)], [*keep, "row", "found"])

    return source.mapInArrow(run, schema)


def find_secrets(
    docs: DataFrame,
    keep: list[str],
    text_column: str = "text",
    repository: str = "source",
    owner: str = "source",
    wide: int = WIDE,
) -> DataFrame:
    """``keep`` columns and ``found`` (candidates in order), ``owned`` (spans of values that look live and are owner-specific).

    Values are hashed and counted over the whole corpus by distinct repositories and distinct owners, first per (value,
    repository, owner), so one value in a third of all rows is summed before it travels. From ``wide`` of either on, a
    value is a copied example; below, and with the look of a live credential, it is owned. Only candidates are shuffled,
    never texts. Null text has no candidates; rows without repository or owner count as one unnamed repository or owner.
    """
    named = docs.withColumns({"_repository": F.coalesce(F.col(repository).cast("string"), F.lit("")), "_owner": F.coalesce(F.col(owner).cast("string"), F.lit(""))})
    scanned = stored(scan(named, text_column, [*keep, "_repository", "_owner"]))
    each = scanned.select("row", "_repository", "_owner", F.explode("found").alias("c"))
    each = each.select("row", "_repository", "_owner", F.col("c.value_hash").alias("value_hash"))
    places = each.groupBy("value_hash", "_repository", "_owner").agg(F.lit(1).alias("one"))
    repositories = places.groupBy("value_hash", "_repository").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count("*").alias("repositories"))
    owners = places.groupBy("value_hash", "_owner").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count("*").alias("owners"))
    narrow = repositories.join(owners, "value_hash").filter((F.col("repositories") < wide) & (F.col("owners") < wide)).select("value_hash")
    own = each.select("row", "value_hash").join(narrow, "value_hash").groupBy("row").agg(F.collect_set("value_hash").alias("narrow"))
    joined = scanned.drop("_repository", "_owner").join(own, "row", "left")
    owned = F.filter("found", lambda c: c["live_looking"] & F.array_contains(F.coalesce("narrow", F.array().cast("array<bigint>")), c["value_hash"]))
    spans = F.array_distinct(F.transform(owned, lambda c: F.struct(c["value_begin"].alias("begin"), c["finish"].alias("finish"))))
    return joined.withColumn("owned", spans).select(*keep, "row", "found", "owned")


def _listed(spans, kind):
    return F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["begin"], s["finish"]))


def secret_report(docs: DataFrame, **options) -> DataFrame:
    found = find_secrets(docs.select("doc_id", "text", "source"), ["doc_id"], **options)
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    every = F.concat(
        F.transform("found", lambda c: F.struct(c["begin"].alias("begin"), c["kind"].alias("kind"), c["finish"].alias("finish"))),
        F.transform("owned", lambda c: F.struct(c["begin"].alias("begin"), F.lit(3).alias("kind"), c["finish"].alias("finish"))),
    )
    count = lambda k: F.size(F.filter("found", lambda c: c["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.array_join(_listed(F.col("found"), kind), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(_listed(F.array_sort(every), kind), ",").alias("spans"),
        F.size("owned").cast("long").alias("n_owned"),
    )


def redact(docs: DataFrame, mask: str = MASK, **options) -> DataFrame:
    """``docs`` with every owned value replaced by ``mask``; examples and all other text stay as they are."""
    packed = docs.withColumn("_kept", F.struct(*docs.columns))
    found = find_secrets(packed, ["_kept"], **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                if spans:
                    kept, low = [], 0
                    for a, b in sorted((s["begin"], s["finish"]) for s in spans):
                        if b > low:
                            kept += [text[low : max(a, low)], mask]
                            low = b
                    text = "".join([*kept, text[low:]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_kept", "_masked"])

    kept = found.schema["_kept"].dataType.simpleString()
    text = options.get("text_column", "text")
    masked = found.select("_kept", F.col(f"_kept.{text}"), "owned").mapInArrow(run, f"_kept {kept}, _masked string")
    return masked.select(*(F.col("_masked").alias(c) if c == text else F.col(f"_kept.{c}") for c in docs.columns))
