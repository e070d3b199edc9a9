"""Operator 6: jump consistent hashing, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import stored

# Fixed value: the multiplier of the published generator, in four 16-bit limbs from the lowest.
JUMP_MULTIPLIER = 2862933555777941757
LIMBS = [(JUMP_MULTIPLIER >> (16 * i)) & 0xFFFF for i in range(4)]
LOW16, LOW32 = 0xFFFF, 0xFFFFFFFF
CHUNKS_PER_PARTITION = 4
# Repeated rows are laid out again in runs of this many.
RUN = 1 << 16


def _advance(high: Column, low: Column) -> tuple[Column, Column]:
    """key * multiplier + 1 modulo 2**64 on 32-bit halves; no step leaves 53 bits, so nothing overflows."""
    k0, k1, k2, k3 = LIMBS
    mid = low * k1
    bottom = low * k0 + F.shiftleft(mid.bitwiseAND(LOW16), 16) + 1
    top = (
        F.shiftright(bottom, 32)
        + F.shiftright(mid, 16)
        + low * k2
        + F.shiftleft((low * k3).bitwiseAND(LOW16), 16)
        + high * k0
        + F.shiftleft((high * k1).bitwiseAND(LOW16), 16)
    )
    return top.bitwiseAND(LOW32), bottom.bitwiseAND(LOW32)


def jump_shards(key: Column, *counts: int) -> list[Column]:
    """The shard of a 64-bit key for each of ``counts`` shard counts.

    A key visits one rising sequence of shards whatever the count; its shard is the last one below the count.
    So all counts share one walk of at most ``max(counts)`` steps. A null key is walked as zero.
    """
    for count in counts:
        if count < 1:
            raise ValueError("a shard count must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.shiftright(key, 32).bitwiseAND(LOW32).alias("high"),
        key.bitwiseAND(LOW32).alias("low"),
        zero.alias("at"),
        *(zero.alias(f"s{i}") for i in range(len(counts))),
    )

    def step(state: Column, _: Column) -> Column:
        high, low = _advance(state["high"], state["low"])
        span = F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1)
        over = state["at"] >= max(counts)
        moved = F.when(over, state["at"]).otherwise(F.floor((state["at"] + 1) * span).cast("long"))
        return F.struct(
            high.alias("high"),
            low.alias("low"),
            moved.alias("at"),
            *(F.when(moved < n, moved).otherwise(state[f"s{i}"]).alias(f"s{i}") for i, n in enumerate(counts)),
        )

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(max(counts))), start, step)
    return [walked[f"s{i}"].cast("int") for i in range(len(counts))]


def shard_documents(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row with its shard, a gapless place in the shard, and its shard once one more is appended.

    Only the id and the shard count decide (law ``key``): no table is looked up and a further shard takes rows only into
    itself. Places follow the order (chunk, id, checksum, size), where a chunk is a hash range of those three; a prefix
    sum over the counts per (shard, chunk) makes them gapless without one task ever holding a shard. Rows equal in all
    three are counted first and travel as one row; at the end they are laid out in runs of bounded length. Null text: size 1 and
    the checksum of nothing; null id: the shard of key 0. An empty table gives an empty result.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(1, parts * CHUNKS_PER_PARTITION // shards)
    body = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    now, grown = jump_shards(F.col("doc_id"), shards, shards + 1)
    keys = ("doc_id", "size", "text_crc32")
    counted = (
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"),
            (F.octet_length(body).cast("long") + 1).alias("size"),
            F.crc32(body).alias("text_crc32"),
        )
        .groupBy(*keys)
        .agg(F.count("*").alias("copies"))
        .select(*keys, "copies", now.alias("shard"), grown.alias("grown_shard"))
        .withColumn("chunk", F.pmod(F.xxhash64(*keys), F.lit(chunks)).cast("int"))
    )
    counted = stored(counted)
    # One row per (shard, chunk): a few per shuffle partition, whatever the size of the table.
    sizes = counted.groupBy("shard", "chunk").agg(F.sum("copies").alias("rows"))
    before = F.expr("sum(rows) OVER (PARTITION BY shard ORDER BY chunk) - rows")
    offsets = sizes.select("shard", "chunk", before.alias("base"))
    within = F.expr(
        "sum(copies) OVER (PARTITION BY shard, chunk ORDER BY doc_id, text_crc32, size) - copies"
    )
    placed = counted.withColumn("first", within).join(offsets, ["shard", "chunk"])
    runs = placed.select(
        *keys,
        "shard",
        "grown_shard",
        (F.col("base") + F.col("first") + F.col("copies")).alias("end"),
        F.explode(F.expr(f"sequence(base + first, base + first + copies - 1, {RUN}L)")).alias("low"),
    )
    return runs.select(
        *keys,
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.expr(f"sequence(low, least(low + {RUN}, end) - 1)")).alias("slot"),
        "grown_shard",
    )
