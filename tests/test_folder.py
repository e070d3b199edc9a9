import math
import time

import pytest
from pyspark.sql import functions as F

from molframe.operators import density, moments
from molframe.plans.batch import finish_batch, run_folder, store_delta
from molframe.plans.descriptors import Options
from molframe.session import materialise
from molframe.plans.folders import list_structures, read_outputs, read_structures
from molframe.sources import molden, sinks
from molframe.streaming.arrivals import latest_records, start_records
from molframe.streaming.incremental import start_shapes
from tests.test_grid import wave_text
from tests.test_sources import mol_line

LOG = "molecular dipole:\n  full: 1 2 3 {dipole}\nMol. alpha /au  :  9.5\n"
SEGMENTS = "$segment_information\n1 1 0 0 0 {q} 2.0 0.1\n2 1 0 0 0 -0.1 3.0 0.1\n"


def dimer(gap):
    atoms = [(0, 0, 0, "O"), (1, 0, 0, "H"), (-0.3, 0.9, 0, "H"), (1 + gap, 0, 0, "O"), (1.3 + gap, 0.9, 0, "H"), (1.3 + gap, -0.9, 0, "H")]
    bonds = [(1, 2), (1, 3), (4, 5), (4, 6)]
    lines = ["dimer", "", "", f"{len(atoms):3d}{len(bonds):3d}  0  0 V2000", *[mol_line(*a) for a in atoms]]
    return "\n".join([*lines, *[f"{a:3d}{b:3d}  1  0" for a, b in bonds], "M  END", ""])


def outputs(root, stem, dipole, q, surface=True, log=True):
    d = root / stem
    d.mkdir(parents=True)
    (d / "wbo").write_text("1 4 0.05\n2 4 0.125\n1 2 0.9\n")
    (d / "molden.input").write_text(wave_text())
    if log:
        (d / "xtb.log").write_text(LOG.format(dipole=dipole))
    if surface:
        (d / "xtb.cosmo").write_text(SEGMENTS.format(q=q))
        (d / "a.cosmo").write_text(SEGMENTS.format(q=99))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("batch")
    (root / "in").mkdir()
    for name, gap in (("one", 2.0), ("two", 2.5), ("dry", 3.0)):
        (root / "in" / f"{name}.mol").write_text(dimer(gap))
    (root / "in" / "broken.mol").write_text("x\n")
    (root / "in" / "note.txt").write_text("not a molecule")
    outputs(root / "res", "one", 1.5, 0.1)
    outputs(root / "res", "two", 2.5, 0.3, surface=False)
    outputs(root / "res", "dry", 3.5, 0.1, log=False)
    return root


OPTIONS = Options(spacing=0.8, padding=0.6)


def by_name(df):
    return {r.mol_id.rsplit("/", 1)[1]: r for r in df.collect()}


def test_folder_to_outputs(spark, folder):
    out = str(folder / "out")
    done = run_folder(spark, str(folder / "in"), str(folder / "res"), out, OPTIONS)
    rows = by_name(done.records)
    assert {n: (r.status, r.error) for n, r in rows.items()} == {
        "one.mol": ("success", None), "two.mol": ("success", None),
        "dry.mol": ("failed", "log not found"), "broken.mol": ("failed", "unreadable counts line"),
    }
    one = rows["one.mol"]
    com = (15.999 * 0 + 1.008 * (1 - 0.3)) / 18.015, 1.008 * 0.9 / 18.015
    far = (15.999 * 3 + 1.008 * (3.3 + 3.3)) / 18.015, 0.0
    assert one.f[:5] == pytest.approx([math.dist(com, far), 180.0, 0.125, 1.5, 9.5])
    wf = molden.parse_wavefunction(spark.createDataFrame([("w", wave_text())], "mol_id string, text string"))
    points = density.field(wf, 0.8, 0.6)
    want = moments.field_terms(points).first()
    assert [one.snci, *one.f[5:]] == pytest.approx([want.snci, want.f6, want.f7, want.f8, want.f9], rel=1e-6)
    assert one.scdi_variance == pytest.approx(0.0096) and one.meta.status == "success"
    assert (rows["two.mol"].scdi_variance, rows["two.mol"].meta.status) == (0.0, "no surface")
    assert done.summary.first().failed_files == 2
    sheet = spark.read.csv(f"{out}/batch_csv/solvent=default", header=True)
    assert sheet.columns == ["File", *[f"f{i}" for i in range(1, 10)], "SNCI", "SCDI", "SCDI_variance", "SNCI_Norm", "SCDI_Norm"]
    assert [r.File for r in sheet.collect()] == ["broken.mol", "dry.mol", "one.mol", "two.mol"]
    listed = spark.read.json(f"{out}/quadrants/solvent=default/files")
    counted = spark.read.json(f"{out}/quadrants/solvent=default/counts")
    assert listed.count() == 2 == counted.agg(F.sum("count")).first()[0] and counted.count() == 4


def test_second_run_does_only_what_is_missing(spark, folder):
    out = str(folder / "out")
    (folder / "res" / "dry" / "xtb.log").write_text(LOG.format(dipole=3.5))
    (folder / "res" / "one" / "xtb.log").write_text(LOG.format(dipole=9.0))
    run = lambda **k: by_name(run_folder(spark, str(folder / "in"), str(folder / "res"), out, OPTIONS, **k).records)
    rows = run()
    assert rows["dry.mol"].status == "success" and rows["one.mol"].f[3] == 1.5 and len(rows) == 4


def test_unusable_inputs_fail_their_own_record(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for stem in ("a b", "a+b", "lone", "nowave", "short"):
        (tmp_path / "in" / f"{stem}.mol").write_text(dimer(2.0))
        outputs(tmp_path / "res", stem, 1.5, 0.1)
    (tmp_path / "res" / "lone" / "wbo").write_text("")
    (tmp_path / "res" / "nowave" / "molden.input").unlink()
    (tmp_path / "res" / "short" / "molden.input").write_text("[Atoms] AU\nH 1 1 0 0 0\n")
    rows = by_name(run_folder(spark, str(tmp_path / "in"), str(tmp_path / "res"), str(tmp_path / "out"), OPTIONS).records)
    assert {n: r.error for n, r in rows.items()} == {
        "a b.mol": None, "a+b.mol": None, "lone.mol": None,
        "nowave.mol": "wavefunction not found", "short.mol": "missing section",
    }
    assert rows["lone.mol"].f[2] == 0.0 and rows["a b.mol"].f[2] == 0.125


def test_variant_and_delta(spark, folder):
    out = str(folder / "out")
    args = (spark, str(folder / "in"), str(folder / "res"), out)
    stored = spark.read.parquet(f"{out}/descriptors").filter("solvent = 'default'")
    base = finish_batch(materialise(stored.withColumn("elapsed_seconds", F.lit(1.0))))
    water = run_folder(*args, Options(spacing=0.8, padding=0.6, solvent="water", variance_min=0.0, variance_max=0.01))
    assert {r.solvent for r in spark.read.parquet(f"{out}/descriptors").select("solvent").collect()} == {"default", "water"}
    rows = {(r.mol_id.rsplit("/", 1)[1], r.metric): r for r in store_delta(base.records, water.records, out).collect()}
    assert len(rows) == 4 * 14
    assert rows["one.mol", "SCDI"].reference is None and rows["one.mol", "SCDI"].variant == pytest.approx(0.04)
    assert rows["one.mol", "f1"].delta == 0.0
    sinks.write_record_json(base.records, f"{out}/json")
    assert spark.read.json(f"{out}/json").filter("SNCI is not null").count() == 3


def test_stream_sees_new_files_only(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for name, gap in (("a", 2.0), ("b", 3.0)):
        (tmp_path / "in" / f"{name}.mol").write_text(dimer(gap))
        start_shapes(spark, source, out, state).awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert sorted((r.mol_id.rsplit("/", 1)[1], r.fragments, r.batch) for r in rows) == [("a.mol", 2, 0), ("b.mol", 2, 1)]


def opened(df):
    """Files that the scan of a plan opens."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_finished_files_are_not_opened(spark, folder):
    source, results = str(folder / "in"), str(folder / "res")
    paths = {r.stem: r.mol_id for r in list_structures(spark, source).collect()}
    assert set(paths) == {"one", "two", "dry", "broken"}
    assert opened(read_structures(spark, source, [paths["two"]])) == 1
    assert opened(read_outputs(spark, results, "wbo", False, ["two", "none"])) == 1
    assert opened(read_outputs(spark, results, "wbo", False)) == 3
    assert opened(read_outputs(spark, results, "*.cosmo", True, ["one"])) == 2


def test_stream_waits_for_late_outputs(spark, tmp_path):
    source, results, out, state = (str(tmp_path / n) for n in ("in", "res", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "res").mkdir()
    outputs(tmp_path / "kept", "a b", 1.5, 0.1)

    def arrive(stem, *names):
        (tmp_path / "res" / stem).mkdir(exist_ok=True)
        for name in names:
            (tmp_path / "res" / stem / name).write_bytes((tmp_path / "kept" / "a b" / name).read_bytes())

    def start():
        args = (source, results, out, state, OPTIONS)
        assert start_records(spark, *args, patience=1).awaitTermination(240)
        return by_name(latest_records(spark, out))

    arrive("a b", "wbo")
    arrive("early", "wbo", "xtb.log", "molden.input", "xtb.cosmo")
    (tmp_path / "in" / "early.mol").write_text(dimer(2.5))
    rows = start()
    assert set(rows) == {"early.mol"} and rows["early.mol"].status == "success"
    (tmp_path / "in" / "a b.mol").write_text(dimer(2.0))
    arrive("a b", "xtb.log")
    (tmp_path / "in" / "alone.mol").write_text(dimer(3.0))
    assert set(start()) == {"early.mol"}
    time.sleep(1.5)
    arrive("a b", "molden.input")
    rows = start()
    assert set(rows) == {"early.mol", "a b.mol", "alone.mol"}
    assert (rows["alone.mol"].status, rows["alone.mol"].error) == ("failed", "log not found")
    assert rows["a b.mol"].meta.status == "no surface"
    arrive("a b", "xtb.cosmo", "a.cosmo")
    arrive("alone", "wbo", "xtb.log", "molden.input")
    rows = start()
    batch = by_name(run_folder(spark, source, results, str(tmp_path / "whole"), OPTIONS).records)
    assert {n: r.status for n, r in rows.items()} == {"early.mol": "success", "a b.mol": "success", "alone.mol": "success"}
    for name, row in rows.items():
        assert row.asDict(True) == {k: v for k, v in batch[name].asDict(True).items() if k in row.asDict()}
