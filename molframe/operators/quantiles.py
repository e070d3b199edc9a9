"""Exact order statistics of a whole table, without ever sorting it or listing its values."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Doubles become 64-bit keys of the same order; each pass counts one digit of them.
DIGIT_BITS = 16
KEY_BITS = 64
SIGN = np.uint64(1 << 63)
HISTOGRAM = "slot int, digit bigint, n bigint, low double, high double"


def order_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit keys in the order of the doubles; both zeros have one key."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & SIGN, ~bits, bits | SIGN)


def key_values(keys: np.ndarray) -> np.ndarray:
    """The doubles of :func:`order_keys`."""
    return np.where(keys & SIGN, keys ^ SIGN, ~keys).view(np.float64)


@dataclass(frozen=True)
class Slot:
    """A wanted rank of one column among the values whose key starts with ``prefix``.

    With no more values than a digit has counts, ``whole`` counts their keys instead.
    """

    name: str
    prefix: int
    place: Callable[[Column], Column]
    whole: bool = False


def _histograms(slots: list[Slot], done_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Count the next digit of all slots in one pass over a task's rows, with the smallest and largest key of each digit."""
    shift = np.uint64(KEY_BITS - done_bits - DIGIT_BITS)
    size = 1 << DIGIT_BITS
    # Slots of one column and prefix share their counts.
    groups: dict[tuple[str, int], list[int]] = {}
    for i, slot in enumerate(slots):
        groups.setdefault((slot.name, slot.prefix), []).append(i)
    small = {(slot.name, slot.prefix) for slot in slots if slot.whole}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, int], list[np.ndarray]] = {g: [] for g in small}
        tables = {
            g: (np.zeros(size, np.int64), np.full(size, ~np.uint64(0)), np.zeros(size, np.uint64)) for g in groups if g not in small
        }
        for batch in batches:
            for name in {name for name, _ in groups}:
                column = batch.column(batch.schema.get_field_index(name)).drop_null()
                values = column.to_numpy(zero_copy_only=False)
                keys = np.sort(order_keys(values[~np.isnan(values)]))
                for group in groups:
                    owner, prefix = group
                    if owner != name:
                        continue
                    inside = keys
                    if done_bits:
                        first = np.uint64(prefix << (KEY_BITS - done_bits))
                        last = np.uint64(((prefix + 1) << (KEY_BITS - done_bits)) - 1)
                        inside = keys[np.searchsorted(keys, first) : np.searchsorted(keys, last, "right")]
                    if not len(inside):
                        continue
                    if group in small:
                        kept[group].append(inside)
                        continue
                    n, low, high = tables[group]
                    digits = ((inside >> shift) & np.uint64(size - 1)).astype(np.int64)
                    starts = np.flatnonzero(np.r_[True, digits[1:] != digits[:-1]])
                    ends = np.r_[starts[1:], len(inside)]
                    at = digits[starts]
                    n[at] += ends - starts
                    low[at] = np.minimum(low[at], inside[starts])
                    high[at] = np.maximum(high[at], inside[ends - 1])
        for group, members in groups.items():
            if group in small:
                low, n = np.unique(np.concatenate(kept[group] or [np.zeros(0, np.uint64)]), return_counts=True)
                digit, high = (low ^ SIGN).view(np.int64), low
            else:
                n, low, high = tables[group]
                digit = np.flatnonzero(n)
                n, low, high = n[digit], low[digit], high[digit]
            for slot in members:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(digit), slot, np.int32)), pa.array(digit.astype(np.int64)), pa.array(n.astype(np.int64)),
                        pa.array(key_values(low)), pa.array(key_values(high)),
                    ],
                    names=["slot", "digit", "n", "low", "high"],
                )

    return count


def _digits_at(df: DataFrame, slots: list[Slot], done_bits: int) -> DataFrame:
    """``(slot, digit, n, before, total, low, high)`` of the digits that hold the wanted place or its neighbours.

    A slot has at most 2^16 digits, however many rows there are, so the running sum over them is bounded.
    """
    found = df.mapInArrow(_histograms(slots, done_bits), HISTOGRAM)
    counts = found.groupBy("slot", "digit").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    whole = Window.partitionBy("slot")
    running = whole.orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.select(
        "*", (F.sum("n").over(running) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("total")
    )
    place = F.get(F.array(*[s.place(F.col("total")).cast("double") for s in slots]), F.col("slot"))
    return counts.filter((F.col("before") <= F.ceil(place)) & (F.floor(place) < F.col("before") + F.col("n")))


def _fixed(rank: int) -> Callable[[Column], Column]:
    return lambda total: F.lit(rank)


def order_statistics(
    df: DataFrame, wanted: dict[str, tuple[Column, Callable[[Column], Column], Callable[[int], float]]]
) -> dict[str, float | None]:
    """Values at given places, NULL and NaN left out; between two ranks by linear interpolation.

    ``wanted`` maps a name to a column, its 0-based place as an expression of the row count, and the same place as a
    function of the counted number. Radix selection: a pass counts the values by the next 16 bits of their
    order-preserving key, for all columns and places in one aggregation, and goes on inside the digit that holds the
    rank. Four passes reach all 64 bits. An earlier one is the last where the rank is the smallest or largest value of its
    digit, and a digit of at most 2^16 values is settled by the next pass, which counts its values instead. The driver sees at most two digits of each rank.
    """
    columns = list(wanted)
    values = df.select(*[wanted[n][0].cast("double").alias(f"v{i}") for i, n in enumerate(columns)])
    slots = [Slot(f"v{i}", 0, wanted[n][1]) for i, n in enumerate(columns)]
    goals: list[list[tuple[str, int]]] = []  # per slot: (name, rank inside the slot's prefix)
    places: dict[str, float] = {}
    found: dict[tuple[str, int], float] = {}  # (name, rank in the whole column)
    offsets: list[int] = []
    for done_bits in range(0, KEY_BITS, DIGIT_BITS):
        rows: dict[int, list] = {}
        for row in _digits_at(values, slots, done_bits).collect():
            rows.setdefault(row.slot, []).append(row)
        if done_bits == 0:
            goals, offsets = [[] for _ in slots], [0] * len(slots)
            for i, held in rows.items():
                places[columns[i]] = place = wanted[columns[i]][2](held[0].total)
                goals[i] = [(columns[i], r) for r in sorted({math.floor(place), math.ceil(place)})]
        next_slots, next_goals, next_offsets = [], [], []
        for i, held in rows.items():
            for name, rank in goals[i]:
                local = rank - offsets[i]
                digit = next((r for r in held if r.before <= local < r.before + r.n), None)
                if digit is None:
                    continue
                if digit.low == digit.high or local == digit.before:
                    found[name, rank] = digit.low
                elif local == digit.before + digit.n - 1:
                    found[name, rank] = digit.high
                else:
                    prefix = (slots[i].prefix << DIGIT_BITS) | digit.digit
                    next_slots.append(Slot(slots[i].name, prefix, _fixed(local - digit.before), digit.n <= 1 << DIGIT_BITS))
                    next_goals.append([(name, rank)])
                    next_offsets.append(offsets[i] + digit.before)
        slots, goals, offsets = next_slots, next_goals, next_offsets
        if not slots:
            break
    result: dict[str, float | None] = {}
    for name in columns:
        low = found.get((name, math.floor(places[name]))) if name in places else None
        high = found.get((name, math.ceil(places[name]))) if name in places else None
        result[name] = None if low is None or high is None else low + (high - low) * (places[name] % 1) if high != low else low
    return result


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> dict[str, float | None]:
    """Quantiles with linear interpolation between neighbours, NULL and NaN left out; NULL where nothing is left."""

    def at(q: float) -> tuple[Callable[[Column], Column], Callable[[int], float]]:
        return (lambda total: F.lit(float(q)) * (total - 1), lambda total: float(q) * (total - 1))

    return order_statistics(df, {name: (c, *at(q)) for name, (c, q) in wanted.items()})


def smallest_rows(df: DataFrame, order: Column, tie: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest ``order`` value, ties by ``tie``; all rows where ``n`` is not positive.

    Rows without an ``order`` value come last. The bound is selected exactly first, so the final ordered limit sees little
    more than ``n`` rows.
    """
    if n <= 0:
        return df
    keyed = df.withColumn("_k", order.cast("double"))
    bound = order_statistics(keyed, {"k": (F.col("_k"), lambda total: F.lit(n - 1), lambda total: float(n - 1))})["k"]
    if bound is not None:
        keyed = keyed.filter(F.col("_k") <= bound)
    return keyed.orderBy(F.col("_k").asc_nulls_last(), tie).limit(n).drop("_k")
