"""Regular grids around molecules, split into bricks of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.constants import ANGSTROM_TO_BOHR, GRID_PADDING, GRID_SPACING

BRICK = 40


def grid_specs(
    extents: DataFrame, spacing: float = GRID_SPACING, padding: float = GRID_PADDING
) -> DataFrame:
    """Add ``x0, y0, z0, h, nx, ny, nz`` from the bohr columns ``xmin .. zmax``; options are in angstrom.

    An axis runs from min - padding in steps of h and stops before max + padding + h / 2.
    """
    if spacing <= 0:
        raise ValueError("grid spacing must be positive")
    if padding < 0:
        raise ValueError("grid padding must not be negative")
    h, pad = spacing * ANGSTROM_TO_BOHR, padding * ANGSTROM_TO_BOHR
    start = {c: (F.col(f"{c}min") - F.lit(pad)) for c in "xyz"}
    stop = {c: (F.col(f"{c}max") + F.lit(pad)) + F.lit(0.5 * h) for c in "xyz"}
    return extents.select(
        "*",
        *[start[c].alias(f"{c}0") for c in "xyz"],
        F.lit(h).alias("h"),
        *[F.ceil((stop[c] - start[c]) / h).cast("int").alias(f"n{c}") for c in "xyz"],
    ).drop(*[f"{c}{end}" for c in "xyz" for end in ("min", "max")])


def extents_of(atoms: DataFrame) -> DataFrame:
    """``(mol_id, xmin .. zmax)`` from atom rows."""
    ends = [f(c).alias(f"{c}{name}") for c in "xyz" for name, f in (("min", F.min), ("max", F.max))]
    return atoms.groupBy("mol_id").agg(*ends)


def extents_of_arrays(atoms: str = "atoms") -> list[Column]:
    """The same extents from an atom array in the molecule's own row."""
    side = lambda c: F.transform(atoms, lambda a: a[c])
    ends = (("min", F.array_min), ("max", F.array_max))
    return [f(side(c)).alias(f"{c}{name}") for c in "xyz" for name, f in ends]


def brick_count(n: Column | str, brick: int = BRICK) -> Column:
    """Number of near-equal bricks of at most ``brick`` planes along an axis of ``n`` planes."""
    return F.ceil((F.col(n) if isinstance(n, str) else n) / brick).cast("int")


def brick_start(b: Column, n: Column, count: Column) -> Column:
    """First plane of brick ``b``; plane ``i`` belongs to brick ``((i + 1) * count - 1) div n``."""
    return F.floor(b * n / count).cast("int")


def brick_tasks(df: DataFrame) -> int:
    """A fixed task count: a brick row is small but its work is not, so sizes must not merge tasks."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def explode_bricks(specs: DataFrame, brick: int = BRICK) -> DataFrame:
    """One row per brick, with its half-open index ranges ``ilo, ihi, jlo, jhi, klo, khi``; evenly spread."""
    for axis, lo in zip("xyz", "ijk"):
        n, count = F.col(f"n{axis}"), brick_count(f"n{axis}", brick)
        specs = (
            specs.withColumn("_b", F.explode(F.sequence(F.lit(0), count - 1)))
            .withColumn(f"{lo}lo", brick_start(F.col("_b"), n, count))
            .withColumn(f"{lo}hi", brick_start(F.col("_b") + 1, n, count))
        )
    return specs.drop("_b").repartition(brick_tasks(specs), "mol_id", "ilo", "jlo", "klo")


def grid_points(specs: DataFrame, brick: int = BRICK) -> DataFrame:
    """``(mol_id, ix, iy, iz, x, y, z)``; bricks are spread first, so one huge grid feeds many tasks."""
    points = explode_bricks(specs, brick)
    for axis, lo in zip("xyz", "ijk"):
        points = points.withColumn(
            f"i{axis}", F.explode(F.sequence(F.col(f"{lo}lo"), F.col(f"{lo}hi") - 1))
        )
    place = lambda c: (F.col(f"{c}0") + F.col(f"i{c}") * F.col("h")).alias(c)
    return points.select("mol_id", "ix", "iy", "iz", *[place(c) for c in "xyz"])


def axis_values(points: DataFrame, key: str = "mol_id") -> DataFrame:
    """Distinct coordinates ``(key, axis, v)``; duplicates disappear before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("v")) for c in "xyz"])
    return points.select(key, F.inline(pairs)).distinct()


def volume_elements(points: DataFrame) -> DataFrame:
    """``(mol_id, dv)``: product over the axes of the gap between the two smallest coordinates, or 1."""
    values = axis_values(points)
    lowest = values.groupBy("mol_id", "axis").agg(F.min("v").alias("lo"))
    second = (
        values.join(lowest, ["mol_id", "axis"])
        .groupBy("mol_id", "axis")
        .agg(F.min("lo").alias("lo"), F.min(F.when(F.col("v") > F.col("lo"), F.col("v"))).alias("next"))
    )
    step = F.coalesce(F.col("next") - F.col("lo"), F.lit(1.0))
    gap = lambda c: F.max(F.when(F.col("axis") == c, step))
    return second.groupBy("mol_id").agg((gap("x") * gap("y") * gap("z")).alias("dv"))


def axis_index(values: DataFrame, key: str = "mol_id") -> DataFrame:
    """Add ``i``, the 0-based position of every distinct coordinate on its axis."""
    return values.withColumn("i", F.row_number().over(Window.partitionBy(key, "axis").orderBy("v")) - 1)


def completeness(points: DataFrame) -> DataFrame:
    """``(mol_id, nx, ny, nz, points, complete, spacing)``; spacing is the median step along x."""
    steps = F.col("v") - F.lag("v").over(Window.partitionBy("mol_id", "axis").orderBy("v"))
    on = lambda c: F.count_if(F.col("axis") == c).cast("int").alias(f"n{c}")
    axes = (
        axis_values(points)
        .withColumn("_step", steps)
        .groupBy("mol_id")
        .agg(
            *[on(c) for c in "xyz"],
            F.coalesce(F.median(F.when(F.col("axis") == "x", F.col("_step"))), F.lit(1.0)).alias("spacing"),
        )
    )
    rows = points.groupBy("mol_id").agg(F.count("*").alias("points"))
    full = F.col("nx").cast("long") * F.col("ny") * F.col("nz") == F.col("points")
    return axes.join(rows, "mol_id").select(
        "mol_id", "nx", "ny", "nz", "points", full.alias("complete"), "spacing"
    )
