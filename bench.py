"""Headline queries on local cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

import numpy as np

from molframe.bindings.queries import QUERIES
from molframe.constants import ANGSTROM_TO_BOHR, GRID_PADDING, GRID_SPACING
from molframe.operators import density, moments
from molframe.session import local_session
from molframe.sources import molden

HEADLINE = (
    "quadrants", "scdi_var", "surface_scores", "nci_stats", "snci", "fragments", "com", "f1_f2", "hb_angle", "f3_wbo",
    "bonds_by_distance", "log_scrape", "molden_mo", "density", "nci_field", "run_status", "delta_long",
    "subset_metrics", "spearman", "grid_align",
)
# The published field stage: 31 atoms, 46 shells of 79 functions, 41 occupied orbitals, 158 x 97 x 115 points.
FIELD_POINTS = 1_762_490
FIELD_EXTENT = (158, 97, 115)
SHELLS = "s" * 31 + "p" * 14 + "d"
ORBITALS, FUNCTIONS, WARM_RUNS = 41, 79, 5


def published_wavefunction() -> str:
    """A wavefunction text of the published size; positions, exponents and coefficients are drawn with a fixed seed."""
    rng = np.random.default_rng(7)
    h, pad = GRID_SPACING * ANGSTROM_TO_BOHR, GRID_PADDING * ANGSTROM_TO_BOHR
    box = np.array([(n - 1.2) * h - 2 * pad for n in FIELD_EXTENT])
    places = np.vstack([np.zeros(3), box, rng.uniform(0, box, (29, 3))])
    lines = ["[Molden Format]", "[Atoms] AU"]
    lines += [f"C {i + 1} 6 {x:.8f} {y:.8f} {z:.8f}" for i, (x, y, z) in enumerate(places)]
    lines.append("[GTO]")
    for atom in range(31):
        lines.append(f"{atom + 1} 0")
        for kind in SHELLS[atom::31]:
            lines += [f"{kind} 3 1.0", *(f"{e:.6f} {c:.6f}" for e, c in zip((6.0, 1.5, 0.3), rng.uniform(0.1, 1, 3), strict=True))]
        lines.append("")
    lines.append("[MO]")
    for _ in range(ORBITALS):
        lines += ["Sym= A", "Ene= 0.0", "Spin= Alpha", "Occup= 2.0"]
        lines += [f"{k + 1} {c:.8f}" for k, c in enumerate(rng.normal(0, 0.1, FUNCTIONS))]
    return "\n".join(lines) + "\n"


def field_stage(spark) -> tuple[float, int]:
    """Density, differences and moments of one wavefunction of the published size; warm mean of five."""
    docs = spark.createDataFrame([("published", published_wavefunction())], "mol_id string, text string")
    wave = molden.parse_wavefunction(docs).persist()
    assert wave.first().reason is None
    points = density.density(wave, GRID_SPACING, GRID_PADDING).count()
    seconds = []
    for _ in range(1 + WARM_RUNS):
        start = time.perf_counter()
        assert moments.field_moments(density.field(wave, GRID_SPACING, GRID_PADDING)).collect()
        seconds.append(time.perf_counter() - start)
    wave.unpersist()
    return sum(seconds[1:]) / WARM_RUNS, points


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("molframe-bench", cpus=cpus, partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["quadrants"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    stage, points = field_stage(spark)
    seconds["field_stage"] = round(stage, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "field_points": points,
                "field_points_published": FIELD_POINTS,
                "field_points_per_second": round(points / stage),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
