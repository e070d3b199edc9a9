"""Periodic runs, spelling variants and repeated passages against plain definitions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from molframe.llm import fmindex, periodic, repeats, spelling
from tests.llm import brute

WORDS = re.compile("[^\x20\x09-\x0d]+")
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def crc(text):
    return zlib.crc32(text.encode())


def named(doc_id):
    return "" if doc_id is None else str(doc_id)


def runs_of(w):
    """Maximal runs by the definition, period by period."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            size = i - start + q
            if i > start and size >= max(24, 3 * q):
                smaller = any(all(w[k] == w[k + p] for k in range(start, start + size - p)) for p in range(1, q))
                if not smaller:
                    out.append((start, size, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_rows(docs):
    out = []
    for doc_id, text in docs:
        w = WORDS.findall(text or "")
        h, n = crc(named(doc_id)), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_of(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        out.append((
            doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            brute.sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)),
            brute.sha(" ".join(x for k, x in enumerate(w) if k not in gone)), n,
        ))
    return out


def periodic_texts(seed, count):
    rng = random.Random(seed)
    made = []
    for i in range(count):
        kinds, w = rng.choice([1, 2, 3, 5, 9]), []
        while len(w) < rng.randint(0, 130):
            block = [rng.randrange(kinds) for _ in range(rng.randint(1, 12))]
            w += block * rng.choice([1, 1, 3, 4, 9, 20]) + [rng.randrange(30) for _ in range(rng.choice([0, 0, 1, 3]))]
        made.append((i, rng.choice([" ", "\n\t "]).join(f"w{x}" for x in w)))
    return made


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


def with_hard_rows(made):
    return made + [(5000 + k if r[0] is None else r[0] + 6000, r[1]) for k, r in enumerate(brute.rows())] + [(None, made[0][1]), (None, None), made[1], made[1]]


def test_runs_are_those_of_the_definition(spark):
    made = with_hard_rows(periodic_texts(1, 300))
    frame = spark.createDataFrame(made, "doc_id long, text string").withColumns({"runs": F.lit(1), "_text": F.lit("x"), "n_words": F.lit(2), "best": F.lit(3)})
    found = periodic.run_report(frame.repartition(3))
    expected = run_rows(made)
    assert sum(r[1] for r in expected) > 200 and any(r[1] > 3 for r in expected)
    assert ordered(found.collect()) == ordered(expected)
    assert periodic.run_report(frame.limit(0)).count() == 0


def test_runs_and_kept_text_are_real_outputs(spark):
    frame = spark.createDataFrame([(1, "x " + "a b c " * 10 + "y"), (2, None)], "doc_id long, text string")
    one, two = periodic.collapse_runs(frame, ["doc_id"]).orderBy("doc_id").collect()
    assert [tuple(r) for r in one.runs] == [(1, 30, 3)] and one.collapsed == "x a b c y" and one.n_words == 32
    assert (two.n_words, two.runs, two.collapsed) == (0, [], "")


def test_long_texts_and_other_limits():
    rng = random.Random(3)
    w = [rng.randrange(40) for _ in range(20000)]
    w[700:9700] = (w[700:1700] * 9)[:9000]
    assert periodic.lag_scan(np.array(w))[0][2] == 1000
    one = [7] * 60000
    assert periodic.lag_scan(np.array(one)) == [(0, 60000, 1)]
    assert periodic.lag_scan(np.array([1, 2] * 4), 4, 2) == [(0, 8, 2)]
    # Every split leaves one word fewer that is frequent enough, so splitting must go on.
    stairs = [x for k in range(40) for x in [k] * 2 + [k + 1]]
    assert periodic.surviving(np.array(stairs), np.zeros(len(stairs), np.int64), 50, 24, 4) == []


def spelling_rows(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in LETTERS.findall(text or ""):
            run = run.translate(brute.FOLD)
            h = crc(f"{named(doc_id)}:{run}")
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 6
    words = {w: n for w, n in counts.items() if n >= 5}
    rests = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            rests[k, w[:k] + w[k + 1 :], len(w)].add(w)
    near = defaultdict(set)
    for (_, rest, _), some in rests.items():
        for w in some:
            near[w] |= some - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 5 * n:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def spelling_texts(seed=5):
    rng = random.Random(seed)
    letters = "abcdeéÿz"
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(60)]
    for w in pool[:40]:
        for _ in range(4):
            k, x = rng.randrange(len(w)), rng.choice(letters)
            pool.append(rng.choice([w[:k] + x + w[k + 1 :], w[:k] + x + w[k:], w[:k] + w[k + 1 :], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :]]))
    pool += ["École×x", "straßen", "aābcdefgh", "abcdefghi"]
    weights = [5 ** rng.choice([0, 0, 1, 2, 3]) for _ in pool]
    made = [(i, rng.choice([" ", ", ", "中"]).join(x.title() if rng.random() < 0.2 else x for x in rng.choices(pool, weights, k=rng.randint(1, 150)))) for i in range(300)]
    # A form that has a form.
    return made + [(400 + k, "ccddeeabz " * 50 + "ccddeeab " * 8 + "ccddeea") for k in range(8)]


def test_spelling_groups_are_those_of_edit_distance(spark):
    made = with_hard_rows(spelling_texts())
    expected = spelling_rows(made)
    assert sum(r[1] is not None for r in expected) > 20 and any(r[1] not in (None, r[2]) for r in expected)
    frame = spark.createDataFrame(made, "doc_id long, text string").withColumns({"word": F.lit("mine"), "n": F.lit(1)})
    assert ordered(spelling.spelling_report(frame.repartition(4)).collect()) == ordered(expected)
    assert spelling.spelling_report(frame.limit(0)).count() == 0


def test_a_crowd_of_anagrams_and_long_words(spark):
    rng = random.Random(8)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(700)}
    words |= {w[:3] + w[4:] for w in sorted(words)[:50]}
    words |= {"x" * 5000, "x" * 5001, "y" + "x" * 4999, "ab\U0001f600cdef", "ab\U0001f600cdeg"}
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long").unionByName(spark.createDataFrame([(None, 9), ("short", 9), ("rarely", 1)], "word string, n long"))
    found = {r.word: r.n_near for r in spelling.variant_groups(frame).collect()}
    assert set(found) == words
    cut = defaultdict(set)
    for w in words:
        for k in range(len(w)) if len(w) < 100 else ():
            cut[k, w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for (_, rest), some in cut.items():
        for w in some:
            near[w] |= (some | ({rest} & words)) - {w}
            if rest in words:
                near[rest].add(w)
    near["x" * 5000] |= {"x" * 5001, "y" + "x" * 4999}
    near["x" * 5001].add("x" * 5000)
    near["y" + "x" * 4999].add("x" * 5000)
    assert found == {w: len(near[w]) for w in words}


def test_no_join_of_the_spelling_report_goes_through_the_driver(spark, monkeypatch):
    """A table of few compressed bytes may hold many words, each of which gets thirty signatures."""
    plans, write = [], spelling.written
    monkeypatch.setattr(spelling, "written", lambda df: plans.append(df) or write(df))
    frame = spark.createDataFrame([("abcdefgh", 500), ("abcdefg", 20), ("abcdefgi", 5), ("zzzzzzz", 9)], "word string, n long")
    found = spelling.variant_groups(frame)
    assert {r.word: r.root for r in found.collect()} == {"abcdefgh": "abcdefgh", "abcdefg": "abcdefgh", "abcdefgi": "abcdefgh", "zzzzzzz": "zzzzzzz"}
    texts = [d._jdf.queryExecution().executedPlan().toString() for d in (*plans, found)]
    assert sum("SortMergeJoin" in x for x in texts) >= 4 and not any("Broadcast" in x for x in texts)


def test_signatures_of_near_multisets_meet():
    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 12)))
        k, x = rng.randrange(len(w)), rng.choice("abcdef")
        for other in (w[:k] + x + w[k + 1 :], w[:k] + x + w[k:]):
            a, b = spelling.signatures(pa.array([w, other]), 3)
            assert set(a.tolist()) & set(b.tolist()), (w, other)


def passage_rows(docs, window=50):
    split = [(d, WORDS.findall(t or "")) for d, t in docs]
    first = {}
    for d, w in split:
        for i in range(len(w) - window + 1 if d is not None else 0):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), brute.sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def passage_texts(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    pool = [[rng.choice(words) for _ in range(rng.randint(5, 130))] for _ in range(25)] + [["a"] * 400, ["a", "b"] * 150]
    made = []
    for _ in range(300):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pool)
            w += p if rng.random() < 0.5 else p[rng.randrange(len(p)) :]
            w += [rng.choice(words) for _ in range(rng.choice([0, 0, 1, 10, 40]))]
        made.append((rng.randint(0, 500) if rng.random() < 0.95 else None, rng.choice([" ", "\n  "]).join(w)))
    made += [(1000 + k, made[5][1]) for k in range(30)] + [(0, made[7][1]), (0, made[8][1])]
    return made


@pytest.mark.parametrize(("shard", "segment"), [(4096, 256), (7, 3)])
def test_repeated_passages_are_those_of_all_windows(spark, monkeypatch, shard, segment):
    monkeypatch.setattr(repeats, "SHARD", shard)
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    made = with_hard_rows(passage_texts())
    frame = spark.createDataFrame(made, "doc_id long, text string").withColumns({"hits": F.lit(1), "a": F.lit("x"), "needs": F.lit(2), "_text": F.lit(3)})
    expected = passage_rows(made)
    assert sum(0 < r[2] < r[1] for r in expected) > 50
    assert ordered(repeats.repeat_report(frame.repartition(3)).collect()) == ordered(expected)
    assert repeats.repeat_report(frame.limit(0)).count() == 0


def test_spans_and_kept_text_are_real_outputs(spark):
    shared = " ".join(f"s{i}" for i in range(50))
    rows = [(1, f"p q {shared}"), (2, f"{shared} r"), (3, f"x {shared[:-2]}zz y"), (4, f"p q {shared}")]
    found = {r.doc_id: r for r in repeats.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(k, [tuple(s) for s in r.spans], r.kept) for k, r in sorted(found.items())] == [(1, [], None), (2, [(0, 50)], "r"), (3, [], None), (4, [(0, 52)], "")]
    assert found[2].kept_sha256 == hashlib.sha256(b"r").hexdigest()


def test_index_finds_the_least_value_of_every_window():
    rng = random.Random(2)
    for _ in range(150):
        kinds, window = rng.choice([1, 2, 3, 6]), rng.choice([1, 2, 3, 5, 9])
        held = [[rng.randint(1, kinds) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(1, 12))]
        values = np.array([rng.randint(0, 50) for _ in held])
        more = kinds + rng.choice([0, 2])
        index = fmindex.FMIndex(np.array(sum(held, [])), np.array([len(s) for s in held]), values, more, window)
        asked = [[rng.randint(1, more) for _ in range(rng.randint(0, 40))] + rng.choice(held)[: rng.randint(0, 30)] for _ in range(8)] + held
        sizes = np.array([len(s) for s in asked])
        found = index.least_values(np.array(sum(asked, []), np.int64), np.cumsum(sizes) - sizes, sizes)
        expected = []
        for s in asked:
            for i in range(len(s)):
                w = s[i : i + window]
                there = [v for t, v in zip(held, values.tolist(), strict=True) if len(w) == window and any(t[j : j + window] == w for j in range(len(t)))]
                expected.append(min(there, default=fmindex.NONE))
        assert found.tolist() == expected
