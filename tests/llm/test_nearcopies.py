"""The near-copy stage against Jaccard similarity of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from molframe.llm import nearcopies
from tests.llm import brute


def copies():
    """Texts with edits that leave similarities on both sides of 0.8, a crowd of copies, and one passage in many texts."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    made, line = [], "every page ends with this very same line of words"
    for i in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        made.append((i, " ".join(own) + (f" {line}" if i % 2 else "")))
        for k in range(6):
            new = list(own)
            for _ in range(rng.randint(0, 4)):
                new[rng.randrange(len(new))] = rng.choice(words)
            made.append((100 + 10 * i + k, " ".join(new).upper()))
    crowd = [rng.choice(words) for _ in range(90)]
    made += [(2000 + k, " ".join(crowd) + f" t{k} u{k}") for k in range(80)]
    # Exactly 0.8: nine shingles shared of nine and one more each, and one just below it.
    made += [(3000, " ".join(f"z{i}" for i in range(12))), (3001, " ".join(f"z{i}" for i in range(14))), (3002, " ".join(f"z{i}" for i in range(15)))]
    return made + [(r[0] + 5000 if r[0] is not None else None, r[1]) for r in brute.rows()]


@pytest.fixture(scope="module")
def expected():
    made = copies()
    sets = [brute.shingles(t) for _, t in made]
    near = [(i, j) for i in range(len(made)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return made, sets, near, brute.reach(len(made), near)


def partition(labels):
    groups = {}
    for k, g in labels:
        groups.setdefault(g, []).append(k)
    return sorted(sorted(map(repr, g)) for g in groups.values())


@pytest.mark.parametrize(("common", "cell"), [(1 << 16, 2048), (0, 5)])
def test_groups_are_those_of_all_pairs(spark, expected, monkeypatch, common, cell):
    monkeypatch.setattr(nearcopies, "CELL", cell)
    monkeypatch.setattr(nearcopies, "COMMON", common)
    made, sets, near, label = expected
    similar = [5 * len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for i, j in near]
    assert any(x == 4 for x in similar) and sum(4 <= x < 5 for x in similar) > 300
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    found = nearcopies.group(frame).collect()
    names = {}
    for (_, text), s in zip(made, sets, strict=True):
        names[frozenset(s)] = nearcopies._node(nearcopies.shingle_sets(pa.array([text], "string"))[0])
    assert partition({((r.doc_id, r.node), r.root) for r in found}) == partition({((d[0], names[frozenset(s)]), g) for d, s, g in zip(made, sets, label, strict=True)})


def test_stage_keeps_one_of_each_group(spark, expected):
    made, _, _, label = expected
    frame = spark.createDataFrame(made, "doc_id long, text string").withColumns({"node": F.lit("mine"), "root": F.lit(2)})
    kept = corpus_pipeline.keep_one_of_each_group(spark, frame, "")
    rows = kept.collect()
    least = {}
    for (doc_id, _), g in zip(made, label, strict=True):
        least[g] = min(least.get(g, np.inf), np.inf if doc_id is None else doc_id)
    assert kept.columns == frame.columns and {r.node for r in rows} == {"mine"}
    assert sorted(r.doc_id for r in rows) == sorted(least.values())
    assert corpus_pipeline.keep_one_of_each_group(spark, frame.limit(0), "").count() == 0


def test_a_cell_proposes_by_its_roots_and_not_by_its_pairs():
    """Near copies of one text that no centre joined: each proposes its likeliest link, and the rest comes in later rounds."""
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[12:], rng.integers(1, 1 << 62, 12).astype(np.uint64)])) for _ in range(300)]
    nodes, parts = np.arange(300), np.zeros(300, np.int64)
    sizes, odd = np.array([len(s) for s in sets]), [nearcopies.parity(s) for s in sets]
    few, left_out = nearcopies._close(nodes, nodes, parts, sizes, odd, 1)
    assert left_out and 150 <= len(few) <= 300
    assert set(few.ravel().tolist()) == set(range(300))
    every, left_out = nearcopies._close(nodes, nodes, parts, sizes, odd, 300)
    assert not left_out and len(every) == 300 * 299 // 2
    assert nearcopies._close(nodes, nodes * 0, parts, sizes, odd, 1)[0].shape == (0, 2)


def test_stage_takes_links_of_fingerprints(spark):
    """Equal and near fingerprints are proposed, at most as many as nodes, and far ones are not."""
    far = (1 << 62) - 1
    rows = [(n, 9, fp) for n, fp in enumerate([5, 5, 5, 4, far, far ^ 3, far ^ (31 << 40)])] + [(99, 0, 5)]
    nodes = spark.createDataFrame(rows, "node long, size int, fp long")
    found = {tuple(r) for r in nearcopies.fingerprint_links(nodes).collect()}
    label = brute.reach(7, list(found))
    assert len(found) <= 7 and [label[i] == label[j] for i, j in ((0, 1), (1, 2), (2, 3), (4, 5), (0, 4), (4, 6))] == [True] * 4 + [False] * 2
    assert 99 not in {n for pair in found for n in pair}


def test_texts_that_share_many_shingles_meet_in_one_cell(spark):
    """A cell for each set of nodes, not for each shingle: two long texts made 400 cells of two rows before."""
    rows = [(t, n, None) for t in range(400) for n in (1, 2)] + [(t, n, None) for t in range(400, 500) for n in (1, 3, 4)]
    rows += [(t, 5, None) for t in range(500, 520)] + [(1000 + k, n, -7) for k, n in enumerate((1, 2, 6))]
    place, node, t = zip(*rows, strict=True)
    table = pa.table({"place": pa.array(place, pa.int64()), "node": pa.array(node, pa.int64()), "t": pa.array(t, pa.int64())})
    made = pa.Table.from_batches(nearcopies._shared(iter(table.to_batches(max_chunksize=7))))
    cells = {}
    for name, n in zip(made["t"].to_pylist(), made["node"].to_pylist(), strict=True):
        cells.setdefault(name, []).append(n)
    assert sorted(cells.values()) == [[1, 2], [1, 2, 6], [1, 3, 4]] and cells[-7] == [1, 2, 6]


def test_only_nodes_that_share_enough_are_handed_on(spark):
    """Texts with a passage in common, or pieces of two others, met in cells before; pairs at the limit still do."""
    rng = random.Random(5)
    line = " ".join(f"l{i}" for i in range(16))
    made = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(120)) for _ in range(60)]
    rows = [(i, f"{text} {line}") for i, text in enumerate(made)]
    rows += [(100 + i, f"{text} {line} " + " ".join(f"n{i}x{k}" for k in range(33))) for i, text in enumerate(made[:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    outlines = nearcopies.with_outlines(docs).cache()
    cells = nearcopies.shared_cells(docs, outlines.drop("doc_id"))
    found = {r.doc_id for r in outlines.join(cells.select("node").distinct(), "node").collect()}
    assert found == {0, 1, 2, 3, 4, 100, 101, 102, 103, 104}
    sizes = {r.doc_id: r["size"] for r in outlines.collect()}
    assert (sizes[0], sizes[100]) == (132, 165) and 5 * 132 == 4 * 165
    assert nearcopies.group(docs).select("root").distinct().count() == 60


def test_whole_rows_are_not_sent_through_python_again(spark, expected):
    """The last pass sent each text twice to a worker, in its row and beside it, and shuffled the rows that were left twice."""
    made, _, _, label = expected
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    kept = nearcopies.keep_one(frame)
    assert "MapInArrow" not in kept._jdf.queryExecution().executedPlan().toString()
    least = {}
    for (doc_id, text), g in zip(made, label, strict=True):
        least.setdefault(g, []).append((doc_id is None, doc_id or 0, text or ""))
    rows = [(r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect()]
    assert len(rows) == len(least)
    for row in rows:
        own = next(g for g in least.values() if row in g)
        assert row[:2] == min(own)[:2]
