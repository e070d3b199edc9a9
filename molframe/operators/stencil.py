"""Finite differences on grids, and the interaction field built from them.

A grid is cut into bricks that carry one plane of their neighbours. One shuffle brings a brick together,
a brick never holds more than ``(BRICK + 2) ** 3`` points.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.constants import RHO_CEILING, RHO_FLOOR
from molframe.operators.grid import BRICK, brick_count, brick_start
from molframe.sources.text import fix_columns

DERIVATIVES = ("gx", "gy", "gz", "hxx", "hyy", "hzz", "hxy", "hxz", "hyz")
FIELDS = ("rdg", "sl2rho")
# A middle eigenvalue of less than this share of the others has its sign from rounding.
SIGN_LIMIT = 1e-7
RDG_SCALE = 1.0 / (2.0 * (3.0 * math.pi**2) ** (1.0 / 3.0))


def _along(axis: int, part: slice) -> tuple:
    return tuple(part if a == axis else slice(None) for a in range(3))


def _first(u: np.ndarray, h: float, axis: int) -> np.ndarray:
    """Central inside, one-sided at both ends."""
    at = lambda low, high=None: u[_along(axis, slice(low, high))]
    out = np.empty_like(u)
    out[_along(axis, slice(1, -1))] = (at(2) - at(None, -2)) / (2.0 * h)
    out[_along(axis, slice(None, 1))] = (at(1, 2) - at(None, 1)) / h
    out[_along(axis, slice(-1, None))] = (at(-1) - at(-2, -1)) / h
    return out


def _second(u: np.ndarray, h: float, axis: int) -> np.ndarray:
    """Central inside; an end repeats its neighbour; all zero below three planes."""
    if u.shape[axis] < 3:
        return np.zeros_like(u)
    left, middle, right = (u[_along(axis, part)] for part in (slice(None, -2), slice(1, -1), slice(2, None)))
    out = np.empty_like(u)
    inner = out[_along(axis, slice(1, -1))]
    np.divide(right - 2 * middle + left, h * h, out=inner)
    out[_along(axis, slice(None, 1))] = inner[_along(axis, slice(None, 1))]
    out[_along(axis, slice(-1, None))] = inner[_along(axis, slice(-1, None))]
    return out


def _mixed(u: np.ndarray, h: float, axes: tuple[int, int]) -> np.ndarray:
    """Four corners inside, zero wherever either axis ends."""
    out = np.zeros_like(u)
    if min(u.shape[a] for a in axes) < 3:
        return out
    wide = u
    for a in axes:
        wide = wide[_along(a, slice(2, None))] - wide[_along(a, slice(None, -2))]
    inner = tuple(slice(1, -1) if a in axes else slice(None) for a in range(3))
    out[inner] = wide / (4.0 * h * h)
    return out


def difference_arrays(u: np.ndarray, h: float) -> list[np.ndarray]:
    """The nine derivatives of a block in the order of ``DERIVATIVES``; cut planes are for the caller to drop."""
    return (
        [_first(u, h, a) for a in range(3)]
        + [_second(u, h, a) for a in range(3)]
        + [_mixed(u, h, p) for p in ((0, 1), (0, 2), (1, 2))]
    )


def tidy_density(rho: Column) -> Column:
    """NaN and minus infinity to 0, plus infinity to the ceiling, never negative."""
    return (
        F.when(F.isnan(rho), 0.0)
        .when(rho == float("inf"), RHO_CEILING)
        .otherwise(F.greatest(rho, F.lit(0.0)))
    )


def with_shape(points: DataFrame) -> DataFrame:
    """Add ``nx, ny, nz`` from the largest index of each molecule, for tables that lack them."""
    sizes = points.groupBy("mol_id").agg(
        *[(F.max(f"i{c}") + 1).cast("int").alias(f"n{c}") for c in "xyz"]
    )
    return points.join(sizes, "mol_id")


def _brick_of(axis: str, brick: int) -> Column:
    """The bricks that need a plane: its owner, and the neighbour it borders on."""
    i, n, count = F.col(f"i{axis}"), F.col(f"n{axis}"), brick_count(f"n{axis}", brick)
    own = F.floor(((i + 1) * count - 1) / n).cast("int")
    below = F.when((own > 0) & (i == brick_start(own, n, count)), own - 1)
    above = F.when((own < count - 1) & (i + 1 == brick_start(own + 1, n, count)), own + 1)
    return F.array_compact(F.array(own, below, above))


def _brick_table(key: tuple, table: pa.Table, brick: int, measure) -> list[pa.Array]:
    """Lay a brick out as an array, apply ``measure(rho, h)`` and keep the brick's own points."""
    at = [table.column(f"i{c}").to_numpy() for c in "xyz"]
    low = [a.min() for a in at]
    block = np.full([a.max() - b + 1 for a, b in zip(at, low)], np.nan)
    local = tuple(a - b for a, b in zip(at, low))
    block[local] = table.column("rho").to_numpy()
    own = np.ones(table.num_rows, dtype=bool)
    for axis, place, index in zip("xyz", key[1:], at):
        n = table.column(f"n{axis}")[0].as_py()
        own &= ((index + 1) * -(-n // brick) - 1) // n == place.as_py()
    keep = tuple(a[own] for a in local)
    columns = [table.column("mol_id").filter(pa.array(own))]
    columns += [pa.array(a[own], pa.int32()) for a in at] + [pa.array(block[keep])]
    columns += [pa.array(a[keep]) for a in measure(block, table.column("h")[0].as_py())]
    return columns


def _by_brick(points: DataFrame, brick: int, names: tuple[str, ...], measure) -> DataFrame:
    if brick < 4:
        raise ValueError("a brick needs four planes, or edge differences would see too few")
    key_type = points.schema["mol_id"].dataType.simpleString()
    schema = f"mol_id {key_type}, ix int, iy int, iz int, rho double, " + ", ".join(
        f"{d} double" for d in names
    )
    spread = points.filter((F.col("nx") > 1) & (F.col("ny") > 1) & (F.col("nz") > 1)).select(
        "mol_id",
        *[F.col(c).cast("int").alias(c) for c in ("ix", "iy", "iz", "nx", "ny", "nz")],
        tidy_density(F.col("rho")).alias("rho"),
        F.col("h").cast("double").alias("h"),
    )
    for axis in "xyz":
        spread = spread.withColumn(f"b{axis}", F.explode(_brick_of(axis, brick)))

    def one_brick(key: tuple, table: pa.Table) -> pa.Table:
        columns = _brick_table(key, table, brick, measure)
        return pa.table(columns, names=["mol_id", "ix", "iy", "iz", "rho", *names])

    return spread.groupBy("mol_id", "bx", "by", "bz").applyInArrow(one_brick, schema)


def derivatives(points: DataFrame, brick: int = BRICK) -> DataFrame:
    """Differences of ``rho`` on complete grids.

    ``points`` holds ``(mol_id, ix, iy, iz, rho, h, nx, ny, nz)``; the result adds ``DERIVATIVES``.
    Axes need at least two points (see :func:`too_thin`).
    """
    return _by_brick(points, brick, DERIVATIVES, difference_arrays)


def interaction_field(points: DataFrame, rho_floor: float = RHO_FLOOR, brick: int = BRICK) -> DataFrame:
    """As :func:`derivatives`, but adds only ``rdg`` and ``sl2rho``."""
    return _by_brick(points, brick, FIELDS, lambda rho, h: field_arrays(rho, h, rho_floor))


def too_thin(points: DataFrame) -> DataFrame:
    """Rejects: grids with an axis of a single point have no differences."""
    thin = (F.col("nx") < 2) | (F.col("ny") < 2) | (F.col("nz") < 2)
    return (
        points.filter(thin)
        .select("mol_id", F.lit("grid").alias("source"), F.lit("axis of one point").alias("reason"))
        .distinct()
    )


def with_middle_eigenvalue(df: DataFrame, name: str = "lambda2") -> DataFrame:
    """Second eigenvalue of the symmetric Hessian in columns ``hxx .. hyz``, in closed form."""
    c = F.col
    df = fix_columns(df, _t=(c("hxx") + c("hyy") + c("hzz")) / 3)
    df = fix_columns(df, **{f"_d{a}": c(f"h{a}{a}") - c("_t") for a in "xyz"})
    off = c("hxy") * c("hxy") + c("hxz") * c("hxz") + c("hyz") * c("hyz")
    spread = c("_dx") * c("_dx") + c("_dy") * c("_dy") + c("_dz") * c("_dz") + 2 * off
    det = (
        c("_dx") * (c("_dy") * c("_dz") - c("hyz") * c("hyz"))
        - c("hxy") * (c("hxy") * c("_dz") - c("hyz") * c("hxz"))
        + c("hxz") * (c("hxy") * c("hyz") - c("_dy") * c("hxz"))
    )
    df = fix_columns(df, _p=F.sqrt(spread / 6), _det=det)
    cube = F.when(c("_p") > 0, 2 * c("_p") * c("_p") * c("_p"))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c("_det") / cube))
    df = fix_columns(df, _turn=F.acos(cosine) / 3)
    middle = c("_t") - 2 * c("_p") * (F.cos("_turn") + F.cos(c("_turn") + 2 * math.pi / 3))
    helpers = ("_t", "_dx", "_dy", "_dz", "_p", "_det", "_turn")
    return df.withColumn(name, F.when(c("_p") > 0, middle).otherwise(c("_t"))).drop(*helpers)


def middle_eigenvalues(hessian: list[np.ndarray]) -> np.ndarray:
    """The same closed form for arrays ``hxx, hyy, hzz, hxy, hxz, hyz``.

    Near zero only rounding gives a sign. There the last steps are taken one value at a time, as the trace less the two
    outer eigenvalues and with the C library's functions, which do not depend on the width of vector instructions.
    """
    xx, yy, zz, xy, xz, yz = hessian
    third = (xx + yy + zz) / 3
    dx, dy, dz = xx - third, yy - third, zz - third
    p = np.sqrt((dx * dx + dy * dy + dz * dz + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    det = dx * (dy * dz - yz * yz) - xy * (xy * dz - yz * xz) + xz * (xy * yz - dy * xz)
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = np.arccos(np.clip(det / (2 * p * p * p), -1.0, 1.0)) / 3
    middle = third - 2 * p * (np.cos(turn) + np.cos(turn + 2 * math.pi / 3))
    middle = np.where(p > 0, middle, third)
    for i in zip(*np.nonzero((p > 0) & (np.abs(middle) <= SIGN_LIMIT * (np.abs(third) + p)))):
        t, q = float(third[i]), float(p[i])
        cube = 2 * q * q * q
        angle = math.acos(max(-1.0, min(1.0, float(det[i]) / cube))) / 3 if cube > 0 else 0.0
        middle[i] = 3 * t - (t + 2 * q * math.cos(angle)) - (t + 2 * q * math.cos(angle + 2 * math.pi / 3))
    return middle


def field_arrays(rho: np.ndarray, h: float, rho_floor: float = RHO_FLOOR) -> list[np.ndarray]:
    """Reduced gradient, 0 below the density floor, and density signed by the middle eigenvalue."""
    gx, gy, gz, *hessian = difference_arrays(rho, h)
    scaled = RDG_SCALE * np.sqrt(gx * gx + gy * gy + gz * gz)
    rdg = np.where(rho < rho_floor, 0.0, scaled / np.maximum(rho, rho_floor) ** (4.0 / 3.0))
    return [rdg, np.sign(middle_eigenvalues(hessian)) * rho]
