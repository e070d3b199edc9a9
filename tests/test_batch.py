import json
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from molframe.constants import BATCH_METRICS, SINGLE_METRICS
from molframe.operators import batch, compare, delta, quantiles, ranks, surface
from molframe.sources import results

RECORDS = "mol_id string, status string, snci double, scdi double, scdi_variance double"


def test_weighted_variance_and_bounds(spark):
    rng = np.random.default_rng(1)
    rows = [("m", float(a), float(q)) for a, q in zip(rng.uniform(0.1, 2, 300), rng.normal(0, 0.01, 300))]
    rows += [("m", 0.0, 9.0), ("m", float("nan"), 1.0), ("m", 1.0, float("inf")), ("none", -1.0, 2.0)]
    df = spark.createDataFrame(rows, "mol_id string, area double, charge double")
    a, q = np.array([r[1:] for r in rows[:300]]).T
    mu = np.average(q, weights=a)
    want = np.average((q - mu) ** 2, weights=a)
    got = {r.mol_id: r.variance for r in surface.weighted_variance(df).collect()}
    assert got == {"m": pytest.approx(want, rel=1e-10), "none": 0.0}
    close = spark.createDataFrame([("m", 1.0, 1e8), ("m", 1.0, 1e8 + 1)], df.schema)
    assert surface.weighted_variance(close).first().variance == pytest.approx(0.25)
    rows = [("m", [0.0] * 5 + [q, 2.0, -1e12]) for q in (-1e8, -1e8 - 1)]
    assert surface.surface_terms(spark.createDataFrame(rows, "mol_id string, v array<double>")).first().scdi_variance == pytest.approx(0.25)
    score = lambda lo, hi: spark.range(1).select(surface.bounded_score(F.lit(0.25), lo, hi)).first()[0]
    assert (score(0.0, 1.0), score(0.5, 1.0), score(0.0, 0.2)) == (0.75, 1.0, 0.0)
    assert (score(1.0, 1.0), score(1.0, 0.0), score(None, 1.0), score(0.0, None)) == (None,) * 4


def test_segment_roles(spark):
    base = [0.0] * 5
    rows = [("std", base + [q, a, 0.0 - q]) for q, a in ((0.1, 2.0), (-0.1, 3.0))]
    rows += [("swapped", base + [a, q, 0.0 - a]) for q, a in ((0.1, 2.0), (-0.1, 3.0))]
    rows += [("none", base + [-1.0, -2.0, -3.0])]
    df = spark.createDataFrame(rows, "mol_id string, v array<double>")
    got = {r.mol_id: (r.area_col, r.charge_col) for r in surface.segment_roles(df).collect()}
    assert got == {"std": (6, 5), "swapped": (5, 6), "none": (6, 5)}
    terms = {r.mol_id: r for r in surface.surface_terms(df, 0.0, 1.0).collect()}
    assert terms["std"].scdi_variance == pytest.approx(0.0096) and terms["std"].scdi == pytest.approx(0.9904)
    assert terms["swapped"].scdi_variance == pytest.approx(0.0096)
    assert (terms["none"].scdi_variance, terms["none"].scdi) == (0.0, None)


def normalised(spark, rows):
    return {r.mol_id: r for r in batch.quadrants(batch.normalise(spark.createDataFrame(rows, RECORDS))).collect()}


def test_normalise(spark):
    rows = [("a", "success", 1.0, 0.2, 3.0), ("b", "success", 3.0, 1.4, 1.0), ("c", "success", 2.0, 0.5, 2.0), ("d", "failed", 99.0, None, 99.0)]
    got = normalised(spark, rows)
    assert {m: (r.snci_norm, r.scdi_norm, r.scdi_source) for m, r in got.items()} == {
        "a": (0.0, 0.2, "scdi"), "b": (1.0, 1.0, "scdi"), "c": (0.5, 0.5, "scdi"),
    }
    assert {m: r.quadrant for m, r in got.items()} == {"a": "Q3", "b": "Q1", "c": "Q1"}
    rows[1] = ("b", "success", float("nan"), None, 1.0)
    got = normalised(spark, rows)
    assert {m: (r.snci_norm, r.scdi_norm) for m, r in got.items()} == {"a": (0.0, 0.0), "b": (None, 1.0), "c": (1.0, 0.5)}
    assert got["b"].quadrant is None and got["a"].quadrant == "Q3" and got["c"].quadrant == "Q1"
    same = normalised(spark, [(m, "success", 2.0, None, 5.0) for m in "ab"])
    assert {(r.snci_norm, r.scdi_norm) for r in same.values()} == {(0.5, 0.5)}
    assert normalised(spark, [("a", "failed", 1.0, 1.0, 1.0)]) == {}


def test_tally_has_all_quadrants(spark):
    df = spark.createDataFrame([("a", "Q1"), ("b", "Q1"), ("c", None)], "mol_id string, quadrant string")
    assert [tuple(r) for r in batch.quadrant_tally(df).orderBy("quadrant").collect()] == [("Q1", 2), ("Q2", 0), ("Q3", 0), ("Q4", 0)]


def test_status_and_summary(spark):
    runs = spark.createDataFrame(
        [("a", "success", None, 2.0), ("b", "success", None, 2.0), ("c", "success", None, 2.0), ("d", "failed", "x", 2.0), ("e", "stopped", None, 0.0)],
        "mol_id string, status string, error string, elapsed_seconds double",
    )
    results = spark.createDataFrame([("a", True, 1.0), ("b", False, None), ("d", True, 3.0)], "mol_id string, readable boolean, snci double")
    records = batch.resolve_status(runs, results)
    got = {r.mol_id: (r.status, r.error, r.snci) for r in records.collect()}
    assert got == {
        "a": ("success", None, 1.0), "b": ("failed", "Failed to read result", None), "c": ("failed", "Missing result", None),
        "d": ("failed", "x", None), "e": ("stopped", None, None),
    }
    row = batch.throughput(batch.batch_summary(records, 10.0)).first()
    assert tuple(row) == (5, 1, 3, 1, 10.0, 1440.0, 2.5)
    empty = batch.throughput(batch.batch_summary(records.limit(0))).first()
    assert tuple(empty) == (0, 0, 0, 0, 0.0, 0.0, 0.0)
    moved = delta.summary_delta(batch.batch_summary(records, 10.0), batch.batch_summary(records.filter("mol_id <> 'a'"), 4.0))
    assert {r.metric: r.delta for r in moved.collect()} == {"total_files": -1.0, "successful_files": -1.0, "failed_files": 0.0, "stopped_files": 0.0, "total_time_seconds": -6.0}
    assert {r.mol_id for r in batch.pending_inputs(runs, results).collect()} == {"c", "e"}
    assert batch.pending_inputs(runs, results, force=True).count() == 5


def record(spark, rows):
    return spark.createDataFrame(rows, "mol_id string, seen int, snci double, scdi double, scdi_variance double, f array<double>, snci_norm double, scdi_norm double")


def test_deltas(spark):
    old = record(spark, [("a", 1, 9.0, None, 1.0, [1.0] * 9, 0.5, None), ("a", 2, 1.0, None, 1.0, [1.0] * 9, 0.5, None), ("b", 1, 1.0, 1.0, 1.0, [], 0.0, 0.0)])
    new = record(spark, [("a", 1, 4.0, 0.5, 2.0, [2.0] * 9, 1.0, 0.1), ("c", 1, 1.0, 1.0, 1.0, [1.0], 0.0, 0.0)])
    sides = [delta.keep_last(x, "mol_id", "seen").select("mol_id", *delta.vector_metrics(BATCH_METRICS)) for x in (old, new)]
    rows = {(r.mol_id, r.metric): r for r in delta.compare_runs(*sides).collect()}
    assert len(rows) == 3 * 14
    assert (rows["a", "SNCI"].reference, rows["a", "SNCI"].variant, rows["a", "SNCI"].delta) == (1.0, 4.0, 3.0)
    assert rows["a", "SCDI"].delta is None and rows["a", "f9"].delta == 1.0 and rows["b", "f1"].reference is None
    assert rows["c", "f1"].variant == 1.0 and rows["c", "f1"].delta is None and rows["a", "f2"].unit == "deg"
    sides = [x.select("mol_id", *[m for m, _, _ in SINGLE_METRICS]) for x in sides]
    single = {(r.mol_id, r.metric): r for r in delta.compare_to_baseline(sides[1], sides[0]).collect()}
    assert len(single) == 2 * 12
    assert single["a", "SNCI"].reference_found and not single["c", "SNCI"].reference_found


def test_best_setting_and_timing(spark):
    rows = [("new", 3, 4, 0.0), ("mid", 2, 4, 2.0), ("mid", 2, 2, 2.0), ("mid", 2, 8, 5.0), ("old", 1, 1, 0.1)]
    df = spark.createDataFrame(rows, "file string, modified int, setting int, seconds double")
    assert tuple(batch.best_setting(df).first()) == ("mid", 2, 2.0)
    assert batch.best_setting(df.filter("file = 'new'")).count() == 0
    runs = spark.createDataFrame([("slow", 4.0, 10), ("slow", 2.0, 10), ("fast", 1.0, 10)], "method string, seconds double, points int")
    got = {r.method: r for r in batch.timing_statistics(runs, "slow", "points").collect()}
    assert (got["slow"].mean, got["slow"].lowest, got["slow"].highest, got["slow"].deviation) == (3.0, 2.0, 4.0, 1.0)
    assert got["fast"].speedup == 3.0 and got["fast"].points_per_second == 10.0


@pytest.mark.parametrize("bits", [16, 8])
def test_exact_quantiles(spark, monkeypatch, bits):
    # Narrow digits hold more values than counts, so more passes are taken.
    monkeypatch.setattr(quantiles, "DIGIT_BITS", bits)
    rng = np.random.default_rng(6)
    columns = {"normal": rng.normal(size=2000), "ties": rng.integers(0, 4, 2000).astype(float), "same": np.full(2000, 7.0)}
    columns["heavy"] = np.where(rng.random(2000) < 0.4, 0.0, rng.exponential(size=2000))
    # Neighbouring doubles, which differ in their last bits only, and both signs of zero among far values.
    columns["close"] = -1.0 - rng.permutation(2000) * 2.0**-52
    columns["wide"] = rng.permutation(np.r_[np.full(50, -1e300), np.zeros(900), np.full(900, -0.0), np.full(150, 1e300)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], list(columns)).repartition(4)
    for q in (0.0, 0.37, 0.5, 0.999, 1.0):
        if bits == 8 and q not in (0.37, 0.5):
            continue
        got = quantiles.exact_quantiles(df, {n: (F.col(n), q) for n in columns})
        for n, v in columns.items():
            assert got[n] == pytest.approx(np.quantile(v, q), rel=1e-15), (n, q)
    assert statistics.median(columns["normal"]) == pytest.approx(quantiles.exact_quantiles(df, {"m": (F.col("normal"), 0.5)})["m"])
    assert quantiles.exact_quantiles(df, {"m": (F.lit(None).cast("double"), 0.5)}) == {"m": None}
    assert quantiles.exact_quantiles(df.limit(0), {"m": (F.col("normal"), 0.5)}) == {"m": None}
    odd = spark.createDataFrame([(None,), (float("nan"),), (3.0,), (1.0,), (2.0,)], "v double")
    assert quantiles.exact_quantiles(odd, {"m": (F.col("v"), 0.5), "hi": (F.col("v"), 0.75)}) == {"m": 2.0, "hi": 2.5}


def test_order_keys_keep_order():
    rng = np.random.default_rng(8)
    values = np.r_[rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), 0.0, -np.inf, np.inf, 5e-324, -5e-324]
    keys = quantiles.order_keys(values)
    assert (np.argsort(values) == np.argsort(keys)).all() and (quantiles.key_values(keys) == values).all()
    assert quantiles.order_keys(np.array([0.0])) == quantiles.order_keys(np.array([-0.0]))


def test_smallest_rows(spark):
    rows = [(i, float(i % 50) if i % 7 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, v double").repartition(5)
    whole = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0.0, r[0]))
    for n in (1, 60, 342, 343, 350, 400, 999):
        got = quantiles.smallest_rows(df, F.col("v"), "id", n).collect()
        assert sorted(r.id for r in got) == sorted(i for i, _ in whole[:n]), n
    assert quantiles.smallest_rows(df, F.col("v"), "id", 0).count() == 400


def average_rank(v):
    order = np.sort(v)
    return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2


@pytest.mark.parametrize("ranges", [None, 1, 40])
def test_ranks_and_spearman(spark, ranges):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=1500), 2)
    x[:500] = 0.0
    y = x + rng.normal(size=1500)
    g = np.where(rng.random(1500) < 0.7, "a", "b")
    df = spark.createDataFrame([(str(k), float(a), float(b)) for k, a, b in zip(g, x, y)], "g string, x double, y double")
    got = {(r.g, r.x): r["rank"] for r in ranks.average_ranks(df, "x", "g", ranges).collect()}
    for k in "ab":
        want = average_rank(x[g == k])
        assert all(got[k, float(v)] == w for v, w in zip(x[g == k], want))
    holes = df.unionByName(spark.createDataFrame([("a", None, 1.0), ("b", 2.0, None), (None, 1.0, 1.0)], df.schema))
    masks = {"a": F.col("g") == "a", "b": F.col("g") == "b", "none": F.lit(False)}
    found = {r.subset: r for r in ranks.rank_correlations(holes, {"one": ("x", "y"), "two": ("y", "x")}, masks, ranges).collect()}
    for k in "ab":
        a, b = average_rank(x[g == k]), average_rank(y[g == k])
        assert found[k].spearman_one == pytest.approx(np.corrcoef(a, b)[0, 1], rel=1e-12)
        assert found[k].spearman_two == pytest.approx(found[k].spearman_one, rel=1e-12)
    assert found["none"].spearman_one is None


def test_constant_input_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(ranks.pearson(F.col("x"), F.col("y"))).first()[0] is None


def test_agreement_by_subset(spark):
    rng = np.random.default_rng(5)
    a, c = rng.normal(size=800), rng.exponential(1.5, size=800)
    b, d = a + rng.normal(0, 0.3, 800), c + rng.normal(0, 0.1, 800)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, d)], "sl2_ref double, sl2_pred double, rdg_ref double, rdg_pred double")
    inside = (c <= np.quantile(c, 0.9)) & (np.abs(a) <= np.quantile(np.abs(a), 0.9))
    masks = {"all": np.full(800, True), "attractive": a < 0, "trimmed": inside, "low_rdg": c <= 2.0}
    got = {r.subset: r for r in compare.agreement(df, 0.9).collect()}
    for name, m in masks.items():
        r = got[name]
        assert r.n == m.sum()
        assert r.pearson_sl2rho == pytest.approx(np.corrcoef(a[m], b[m])[0, 1])
        assert r.mae_rdg == pytest.approx(np.abs(c - d)[m].mean())
        assert r.rmse_sl2rho == pytest.approx(np.sqrt(((a - b)[m] ** 2).mean()))
        assert r.spearman_rdg == pytest.approx(np.corrcoef(average_rank(c[m]), average_rank(d[m]))[0, 1])
    histogram = compare.parity_histogram(df, "sl2_ref", "sl2_pred", 12).collect()
    assert sum(r["count"] for r in histogram) == 800 and {r.bx for r in histogram} <= set(range(12))
    low = compare.overlay_extract(df).count()
    assert low == ((c <= 2) & (d <= 2)).sum()


def test_sample_is_repeatable_and_whole_when_covered(spark):
    df = spark.range(5000).repartition(7)
    one, two = ({r.id for r in compare.sample_points(df.repartition(k), 300).collect()} for k in (2, 5))
    assert one == two and len(one) == 300
    assert compare.sample_points(df, 10**6).count() == 5000
    assert one != {r.id for r in compare.sample_points(df, 300, seed=8).collect()}


def test_stored_batch_is_one_side_of_a_comparison(spark):
    entry = lambda name, **k: json.dumps({"input_file": name, "status": "success", "a_vector": [1.0] * 9, **k})
    first = '{"summary": {}, "records": [%s, %s, %s, 7, {"SNCI": 2}]}' % (
        entry("a", SNCI=1.0, SCDI=None), entry("b", SNCI="2.5"), entry("a", SNCI=3.0),
    )
    texts = [("one", first), ("cut", first[:40]), ("empty", '{"records": []}'), ("null", None), ("list", "[1]")]
    rows = results.parse_batches(spark.createDataFrame(texts, "file string, text string"))
    found = {(r.file, r.entry): r for r in rows.collect()}
    assert set(found) == {("one", i) for i in range(5)} | {("cut", None), ("null", None), ("list", None)}
    assert [found["one", i].error for i in range(5)] == [None, None, None, "unreadable record", "record without a molecule"]
    assert found["cut", None].error == "unreadable batch" and found["one", 1].snci == 2.5 and len(found["one", 0].f) == 9
    kept = delta.keep_last(rows.filter("readable"), "mol_id", "entry")
    old = record(spark, [("a", 1, 1.0, None, 1.0, [1.0] * 9, 0.5, None)])
    metrics = lambda df: df.select("mol_id", F.col("snci").alias("SNCI"))
    both = metrics(old).alias("o").join(metrics(kept).alias("n"), "mol_id", "full")
    assert sorted(map(tuple, both.collect())) == [("a", 1.0, 3.0), ("b", None, 2.5)]
