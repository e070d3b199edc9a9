"""The vector graph against all pairs, and the pipeline against its stages' definitions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from molframe.llm import decontamination, vectors
from tests.llm import brute


def made(count=700, dims=24, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(count, dims))
    for k in range(0, 200, 4):
        base[k + 1] = base[k] + 0.05 * rng.normal(size=dims)
        base[k + 2] = base[k + 1] + 0.1 * rng.normal(size=dims)
    base[300:360] = base[300] + 0.03 * rng.normal(size=(60, dims))
    base[400:430] = base[400]
    rows = [(i, v.astype(np.float32).tolist(), i % 3) for i, v in enumerate(base)]
    bad = [None, [], [0.0] * dims, [float("nan")] * dims, [float("inf")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [1.0]]
    rows += [(1000 + k, v, 0) for k, v in enumerate(bad)]
    return [*rows, (3, rows[3][1], 1), (None, rows[400][1], 1)]


def expected(rows):
    usable = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    width = max(len(r[1]) for r in usable)
    matrix = np.array([[*r[1], *[0.0] * (width - len(r[1]))] for r in usable])
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    label = brute.reach(len(usable), np.argwhere(near).tolist())
    least = {}
    for r, g in zip(usable, label, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    links = {id(r): (int(n) - 1, least[g]) for r, n, g in zip(usable, near.sum(1), label, strict=True)}
    return sorted((r[0] is not None, r[0] or 0, *links.get(id(r), (0, r[0]))) for r in rows)


@pytest.mark.parametrize("shard,limit", [(1000, 2000), (60, 40)])
def test_vectors(spark, monkeypatch, shard, limit):
    monkeypatch.setattr(vectors, "SHARD", shard)
    monkeypatch.setattr(vectors, "SHARD_LIMIT", limit)
    rows = made()
    found = vectors.duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).collect()
    got, want = sorted((r.vec_id is not None, r.vec_id or 0, r.n_links, r.component_id) for r in found), expected(rows)
    assert found[0].audit_recall >= 0.95 and len(got) == len(want)
    assert sum(g[2] for g in got) >= 0.95 * sum(w[2] for w in want) and all(g[2] <= w[2] for g, w in zip(got, want, strict=True))
    assert np.mean([g[3] == w[3] for g, w in zip(got, want, strict=True)]) > 0.99
    if limit == 2000:
        assert got == want
    assert all(r.kept is None or r.kept == (r.vec_id == r.component_id) for r in found)


def test_no_vectors(spark):
    frame = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r)[:4] for r in vectors.duplicate_vectors(frame).collect()] == [(1, 0, 1, True)]
    assert vectors.duplicate_vectors(frame.limit(0)).count() == 0


def test_graph_reaches_everything():
    rng = np.random.default_rng(1)
    tight = rng.normal(size=(4, 8)).repeat(40, axis=0) + 1e-3 * rng.normal(size=(160, 8))
    unit = tight / np.linalg.norm(tight, axis=1, keepdims=True)
    links, medoid = vectors.robust_pruned(unit)
    seen, wave = {medoid}, [medoid]
    while wave:
        wave = [y for x in wave for y in links[x].tolist() if y >= 0 and y not in seen and not seen.add(y)]
    assert len(seen) == 160
    who, found = vectors.range_search(unit, links, medoid, unit, 0.95)
    assert set(zip(who.tolist(), found.tolist(), strict=True)) == set(map(tuple, np.argwhere(unit @ unit.T >= 0.95).tolist()))


def test_pipeline(spark, tmp_path):
    rows = [*{r[0]: r for r in brute.rows(count=120) if r[0] is not None}.values(), *(r for r in brute.rows(count=120) if r[0] is None)]
    frame = spark.createDataFrame(rows, brute.DOCS).withColumns({"node": F.lit("mine"), "a": F.lit(1), "ids": F.lit(2), "_text": F.lit("x")})
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(1, " ".join(rows[20][1].split()[:12])), (2, "nothing like it here")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        before, after = docs.count(), out.cache().count()
        if name == "near_duplicates":
            sets = [brute.shingles(r.text) for r in docs.collect()]
            near = [(i, j) for i in range(before) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
            assert after == len(set(brute.reach(before, near))) < before
        if name == "decontamination":
            hit = {r[0] for r in brute.contamination([(r.doc_id, r.text) for r in docs.collect()], bench) if r[5]}
            assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in out.collect()} == hit and hit
        if name == "secrets":
            assert after == before
        docs = out
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in last.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}
    assert last.filter("NOT round_trip").count() == 0
    assert decontamination.remove_contaminated(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == docs.count()


def test_pipeline_without_documents(spark, tmp_path):
    spark.createDataFrame([], brute.DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
