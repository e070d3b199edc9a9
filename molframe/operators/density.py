"""Electron density on grids, from wavefunction rows straight to the interaction field.

A molecule's row becomes one row per brick of its grid; bricks spread evenly over the cluster whatever
their molecule's size. Each brick evaluates its own points plus one plane of its neighbours, so the
differences need no shuffle of points at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.constants import CARTESIAN_POWERS, GRID_PADDING, GRID_SPACING, RHO_CEILING, RHO_FLOOR
from molframe.operators.basis import usable
from molframe.operators.grid import BRICK, explode_bricks, extents_of_arrays, grid_specs
from molframe.operators.stencil import FIELDS, field_arrays

VALUES_PER_CHUNK = 4_000_000
# Rows unpacked at once, and points sent back at once.
BYTES_PER_RUN = 1 << 18
POINTS_PER_BATCH = 1 << 15


def _double_factorial(n: int) -> float:
    return float(np.prod(np.arange(n, 0, -2))) if n > 0 else 1.0


def _shell_functions(shell: dict, axes: list[np.ndarray], normalise: bool) -> Iterator[np.ndarray]:
    """Values of a shell's Cartesian functions on the product grid of ``axes``.

    A Gaussian of r squared is a product over the axes, so exponentials are taken per axis point and the
    grid is filled by one small matrix product.
    """
    alpha, coef = shell["exp"], shell["coef"]
    gauss = [np.exp(-alpha[:, None] * d[None, :] ** 2) for d in axes]
    plane = (gauss[0][:, :, None] * gauss[1][:, None, :]).reshape(len(alpha), -1)
    shape = [len(d) for d in axes]
    radial = None
    for power in CARTESIAN_POWERS[shell["l"]]:
        if radial is None or normalise:
            scale = coef
            if normalise:
                below = np.sqrt(np.prod([_double_factorial(2 * p - 1) for p in power]))
                scale = coef * (2 * alpha / np.pi) ** 0.75 * (4 * alpha) ** (0.5 * sum(power)) / below
            radial = ((plane * scale[:, None]).T @ gauss[2]).reshape(shape)
        value = radial
        for axis, p in enumerate(power):
            if p:
                value = value * (axes[axis] ** p).reshape([-1 if a == axis else 1 for a in range(3)])
        yield value


def _block_density(wave: dict, axes: list[np.ndarray], normalise: bool) -> np.ndarray:
    """Density on the product grid, a few x planes at a time so that memory stays bounded."""
    n_basis = wave["coef"].shape[1]
    step = max(1, VALUES_PER_CHUNK // (n_basis * len(axes[1]) * len(axes[2])))
    out = np.empty([len(a) for a in axes])
    for at in range(0, len(axes[0]), step):
        part = [axes[0][at : at + step], axes[1], axes[2]]
        basis = np.empty((n_basis, len(part[0]) * len(axes[1]) * len(axes[2])))
        row = 0
        for shell in wave["shells"]:
            moved = [p - c for p, c in zip(part, shell["at"])]
            for value in _shell_functions(shell, moved, normalise):
                basis[row] = value.ravel()
                row += 1
        psi = wave["coef"] @ basis
        np.multiply(psi, psi, out=psi)
        out[at : at + step] = (wave["occ"] @ psi).reshape(out[at : at + step].shape)
    return np.maximum(np.nan_to_num(out, nan=0.0, posinf=RHO_CEILING, neginf=0.0), 0.0)


def _wave(row: dict) -> dict:
    centres = [(a["x"], a["y"], a["z"]) for a in row["atoms"]]
    shells = [
        {
            "at": centres[s["center"]],
            "l": s["l"],
            "exp": np.array([p["exp"] for p in s["prims"]]),
            "coef": np.array([p["coef"] for p in s["prims"]]),
        }
        for s in row["shells"]
    ]
    orbitals = row["orbitals"]
    n_basis = sum(len(CARTESIAN_POWERS[s["l"]]) for s in shells)
    coef = np.array([o["coef"] for o in orbitals], dtype=float).reshape(len(orbitals), n_basis)
    return {"shells": shells, "coef": coef, "occ": np.array([o["occ"] for o in orbitals], dtype=float)}


def _brick_batch(row: dict, wave: dict, measure, normalise: bool) -> list[np.ndarray]:
    """Index and value columns of one brick; ``measure`` sees one more plane where a neighbour follows."""
    own = [(row[f"{lo}lo"], row[f"{lo}hi"]) for lo in "ijk"]
    halo = 1 if measure else 0
    wide = [(max(a - halo, 0), min(b + halo, row[f"n{c}"])) for (a, b), c in zip(own, "xyz")]
    step = {c: row.get(f"h{c}", row["h"]) for c in "xyz"}
    axes = [row[f"{c}0"] + np.arange(*r) * step[c] for c, r in zip("xyz", wide)]
    rho = _block_density(wave, axes, normalise)
    inner = tuple(slice(a - w, b - w) for (a, b), (w, _) in zip(own, wide))
    index = np.meshgrid(*[np.arange(a, b, dtype=np.int32) for a, b in own], indexing="ij")
    place = [row[f"{c}0"] + i * step[c] for c, i in zip("xyz", index)]
    values = [rho, *measure(rho, row["h"])] if measure else [rho]
    return [a.ravel() for a in (*index, *place, *[v[inner] for v in values])]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``BYTES_PER_RUN``, one row at least, so that many small molecules are unpacked together."""
    for batch in batches:
        step = max(1, BYTES_PER_RUN * batch.num_rows // max(1, batch.nbytes))
        for low in range(0, batch.num_rows, step):
            yield batch.slice(low, step)


def _joined(bricks: list[tuple], key_type: pa.DataType, columns: list[str]) -> pa.RecordBatch:
    """The points of several bricks as one batch."""
    counts = [len(arrays[0]) for _, arrays in bricks]
    keys = pa.array([key for key, _ in bricks], key_type).take(pa.array(np.repeat(np.arange(len(bricks)), counts)))
    arrays = [pa.array(np.concatenate(parts)) for parts in zip(*(arrays for _, arrays in bricks), strict=True)]
    return pa.RecordBatch.from_arrays([keys, *arrays], names=["mol_id", "ix", "iy", "iz", *columns])


def _evaluate(wf, spacing, padding, brick, normalise, names, measure, specs=None) -> DataFrame:
    key_type = wf.schema["mol_id"].dataType.simpleString()
    columns = ["x", "y", "z", "rho", *names]
    schema = f"mol_id {key_type}, ix int, iy int, iz int, " + ", ".join(f"{v} double" for v in columns)
    rows = usable(wf).select(
        "mol_id",
        "atoms",
        F.transform("shells", lambda s: F.struct(s["center"], s["l"], s["prims"])).alias("shells"),
        # Empty orbitals add nothing to the density.
        F.filter("orbitals", lambda o: o["occ"] != 0).alias("orbitals"),
        *([] if specs is not None else extents_of_arrays()),
    )
    gridded = grid_specs(rows, spacing, padding) if specs is None else rows.join(specs, "mol_id")
    bricks = explode_bricks(gridded, brick)
    if measure:
        bricks = bricks.filter((F.col("nx") > 1) & (F.col("ny") > 1) & (F.col("nz") > 1))

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, wave, held, points = None, None, [], 0
        for rows in _runs(batches):
            keys = rows.column("mol_id")
            ids = keys.to_pylist()
            fresh = [i for i, k in enumerate(ids) if k != (ids[i - 1] if i else seen)]
            told = rows.select(["atoms", "shells", "orbitals"]).take(pa.array(fresh, pa.int64())).to_pylist()
            waves = dict(zip(fresh, told, strict=True))
            for i, scalars in enumerate(rows.drop_columns(["mol_id", "atoms", "shells", "orbitals"]).to_pylist()):
                if i in waves:
                    wave = _wave(waves[i])
                held.append((ids[i], _brick_batch(scalars, wave, measure, normalise)))
                points += len(held[-1][1][0])
                if points >= POINTS_PER_BATCH:
                    yield _joined(held, keys.type, columns)
                    held, points = [], 0
            seen = ids[-1]
        if held:
            yield _joined(held, keys.type, columns)

    return bricks.sortWithinPartitions("mol_id").mapInArrow(evaluate, schema)


def density(
    wf: DataFrame,
    spacing: float = GRID_SPACING,
    padding: float = GRID_PADDING,
    brick: int = BRICK,
    normalise: bool = False,
) -> DataFrame:
    """``(mol_id, ix, iy, iz, x, y, z, rho)`` on each molecule's grid."""
    return _evaluate(wf, spacing, padding, brick, normalise, (), None)


def field(
    wf: DataFrame,
    spacing: float = GRID_SPACING,
    padding: float = GRID_PADDING,
    brick: int = BRICK,
    normalise: bool = False,
    rho_floor: float = RHO_FLOOR,
    specs: DataFrame | None = None,
) -> DataFrame:
    """``(mol_id, ix, iy, iz, x, y, z, rho, rdg, sl2rho)`` on each molecule's grid.

    ``specs`` gives the grids instead: ``(mol_id, x0, y0, z0, h, nx, ny, nz)`` in bohr, with ``hx, hy, hz``
    where the steps differ between the axes.
    """
    measure = lambda rho, h: field_arrays(rho, h, rho_floor)
    return _evaluate(wf, spacing, padding, brick, normalise, FIELDS, measure, specs)
