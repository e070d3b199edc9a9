"""Operator 4: near-duplicate vectors by a robust-pruned flat graph, searched by range from the medoids of its shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import stored
from molframe.llm.components import components

SIMILAR = 0.95
SHARD = 1000
SHARD_LIMIT = 2000
# Centres are fitted on a bounded sample drawn by hash; every vector is indexed.
MAX_CENTRES = 2048
SAMPLE_PER_CENTRE = 16
OVERLAP = 2
DEGREE, CANDIDATES, ALPHA, BEAM = 24, 64, 1.2, 32
FAR_LINKS = 6
AUDITED = 1000


def distinct_vectors(rows: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vec_id, node) of every row, and (node, least, copies, v) of every distinct usable vector.

    Vectors that are null, empty, zero or hold null or non-finite components have a null node. Shorter vectors are read
    as if they ended in zeros.
    """
    width = rows.agg(F.max(F.size(column))).first()[0] or 0
    v = F.col(column).cast("array<float>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    filled = F.concat(F.transform(v, lambda x: x + F.lit(0.0).cast("float")), F.array_repeat(F.lit(0.0).cast("float"), F.lit(width) - F.size(v)))
    named = rows.select(F.col(id_column).alias("vec_id"), F.when(usable, filled).alias("v"))
    named = named.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    points = named.filter("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    return named.select("vec_id", "node"), points


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a column of lists as unit vectors in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))
    matrix = matrix / np.maximum(np.abs(matrix).max(1, keepdims=True, initial=0.0), 1e-300)
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def fit_centres(points: DataFrame, count: int) -> np.ndarray:
    """Spherical k-means on a sample of about ``SAMPLE_PER_CENTRE`` vectors per centre; the sample is what the driver holds."""
    centres = max(1, min(MAX_CENTRES, -(-count // SHARD)))
    share = min(1.0, centres * SAMPLE_PER_CENTRE / max(count, 1))
    drawn = points.filter(F.pmod(F.col("node"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    sample = _matrix(drawn.select("v").orderBy("node").limit(2 * MAX_CENTRES * SAMPLE_PER_CENTRE).toArrow().column(0))
    found = sample[np.linspace(0, len(sample) - 1, min(centres, len(sample))).astype(int)].copy()
    for _ in range(8):
        nearest = (sample @ found.T).argmax(1)
        for c in range(len(found)):
            own = sample[nearest == c]
            if len(own) and (norm := np.linalg.norm(total := own.sum(0))) > 0:
                found[c] = total / norm
    return found


def assign(points: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """``points`` with ``leaves``, the sorted numbers of the nearest centres."""
    held = points.sparkSession.sparkContext.broadcast(centres)
    names = points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("v")
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                near = _matrix(part.column(at)) @ held.value.T
                many = min(overlap, near.shape[1])
                leaves = np.sort(np.argpartition(-near, many - 1, axis=1)[:, :many], axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaves.tolist(), pa.list_(pa.int32()))], [*names, "leaves"])

    return points.mapInArrow(run, points.withColumn("leaves", F.array().cast("array<int>")).schema)


def robust_pruned(vectors: np.ndarray) -> tuple[np.ndarray, int]:
    """Neighbour lists (padded with -1) of one shard and its medoid.

    Candidates are the nearest vectors of the shard and a few far ones; a candidate goes if a kept neighbour is nearer to it
    by the factor ``ALPHA``. What the medoid cannot reach is hung below its nearest reached vector.
    """
    n = len(vectors)
    medoid = int((vectors @ vectors.sum(0)).argmax())
    if n == 1:
        return np.full((1, 1), -1), medoid
    near = vectors @ vectors.T
    np.fill_diagonal(near, -2.0)
    many = min(CANDIDATES, n - 1)
    best = np.argpartition(-near, many - 1, axis=1)[:, :many]
    far = (np.arange(n)[:, None] + 1 + (np.arange(min(FAR_LINKS, n - 1)) * (n - 1)) // max(1, min(FAR_LINKS, n - 1))) % n
    chosen = np.concatenate([best, far], axis=1)
    distance = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(near, chosen, 1)))
    order = np.argsort(distance, axis=1, kind="stable")
    chosen, distance = np.take_along_axis(chosen, order, 1), np.take_along_axis(distance, order, 1)
    alive = chosen != np.arange(n)[:, None]
    kept = np.full((n, DEGREE), -1)
    rows = np.arange(n)
    for k in range(DEGREE):
        first = alive.argmax(1)
        has = alive[rows, first]
        if not has.any():
            break
        pick = chosen[rows, first]
        kept[has, k] = pick[has]
        between = np.sqrt(np.maximum(0, 2 - 2 * near[pick[:, None], chosen]))
        alive &= ~(has[:, None] & ((ALPHA * between <= distance) | (chosen == pick[:, None])))
    return _reachable(kept, near, medoid), medoid


def _reachable(kept: np.ndarray, near: np.ndarray, medoid: int) -> np.ndarray:
    """Add the reverse of every link, then links until all is reached from the medoid."""
    n = len(kept)
    a, b = np.nonzero(kept >= 0)[0], kept[kept >= 0]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    while True:
        reached, wave = np.zeros(n, bool), np.array([medoid])
        starts = np.searchsorted(pairs, np.arange(n + 1) * n)
        reached[medoid] = True
        while len(wave):
            sizes = starts[wave + 1] - starts[wave]
            at = np.repeat(starts[wave] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            wave = np.unique(pairs[at] % n)
            wave = wave[~reached[wave]]
            reached[wave] = True
        if reached.all():
            break
        lost, held = np.flatnonzero(~reached), np.flatnonzero(reached)
        block = near[np.ix_(lost, held)]
        one = int(block.max(1).argmax())
        bridge = held[block[one].argmax()] * n + lost[one]
        pairs = np.unique(np.append(pairs, [bridge, (bridge % n) * n + bridge // n]))
    starts = np.searchsorted(pairs, np.arange(n + 1) * n)
    sizes = np.diff(starts)
    out = np.full((n, max(1, sizes.max())), -1)
    out[np.repeat(np.arange(n), sizes), np.arange(len(pairs)) - np.repeat(starts[:-1], sizes)] = pairs % n
    return out


def range_search(vectors: np.ndarray, links: np.ndarray, medoid: int, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of what is found at ``least`` or more: beam search from the medoid, then the range is walked to its end.

    All queries advance together, one expansion each per step.
    """
    count, n = len(queries), len(vectors)
    seen = np.zeros((count, n), bool)
    seen[:, medoid] = True
    beam = np.full((count, BEAM), -1)
    scores = np.full((count, BEAM), -np.inf)
    done = np.ones((count, BEAM), bool)
    beam[:, 0], scores[:, 0], done[:, 0] = medoid, queries @ vectors[medoid], False
    inside = [np.stack([np.flatnonzero(scores[:, 0] >= least), np.full((scores[:, 0] >= least).sum(), medoid)])]
    while True:
        active = np.flatnonzero(~done.all(1))
        if not len(active):
            break
        slot = np.where(done[active], -np.inf, scores[active]).argmax(1)
        done[active, slot] = True
        next_to = links[beam[active, slot]]
        fresh = (next_to >= 0) & ~seen[active[:, None], next_to]
        who, where = np.nonzero(fresh)
        place = next_to[who, where]
        seen[active[who], place] = True
        value = np.full(next_to.shape, -np.inf)
        value[who, where] = np.einsum("ij,ij->i", vectors[place], queries[active[who]])
        hit = value[who, where] >= least
        inside.append(np.stack([active[who[hit]], place[hit]]))
        ids = np.concatenate([beam[active], np.where(fresh, next_to, -1)], axis=1)
        total = np.concatenate([scores[active], value], axis=1)
        state = np.concatenate([done[active], ~fresh], axis=1)
        top = np.argpartition(-total, BEAM - 1, axis=1)[:, :BEAM]
        beam[active], scores[active] = np.take_along_axis(ids, top, 1), np.take_along_axis(total, top, 1)
        done[active] = np.take_along_axis(state, top, 1)
    wave = np.concatenate(inside, axis=1)
    found = [wave]
    while wave.shape[1]:
        fresh_waves = []
        for low in range(0, wave.shape[1], 1 << 15):
            who = np.repeat(wave[0, low : low + (1 << 15)], links.shape[1])
            place = links[wave[1, low : low + (1 << 15)]].ravel()
            key = np.unique((who * n + place)[(place >= 0) & ~seen[who, place]])
            who, place = key // n, key % n
            seen[who, place] = True
            hit = np.einsum("ij,ij->i", vectors[place], queries[who]) >= least
            fresh_waves.append(np.stack([who[hit], place[hit]]))
        wave = np.concatenate(fresh_waves, axis=1)
        found.append(wave)
    pairs = np.concatenate(found, axis=1)
    return pairs[0], pairs[1]


def _labels(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place that each place reaches over the pairs."""
    label = np.arange(count)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


LINKED = "node bigint, other bigint, n_links bigint"


def _linked(index: pa.Table, queries: pa.Table, same: bool, leaf: int, least: float) -> pa.Table:
    """Verified links between two parts of one leaf: sums per vector, and one link each to the least of its group.

    A pair that shares two leaves counts in the lower one only.
    """
    if not index.num_rows or not queries.num_rows:
        return pa.table({"node": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64())})
    nodes = index.column("node").to_numpy()
    order = np.argsort(nodes)
    vectors = _matrix(index.column("v"))
    lists = index.column("links").combine_chunks()
    sizes, wanted = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    place = np.minimum(np.searchsorted(nodes[order], wanted), len(nodes) - 1)
    local = np.where(nodes[order][place] == wanted, order[place], -1)
    width = max(1, sizes.max(initial=1))
    links = np.full((len(nodes), width), -1)
    links[np.repeat(np.arange(len(nodes)), sizes), np.arange(len(local)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = local
    medoid = int((vectors @ vectors.sum(0)).argmax())
    # Links leave for other leaves too, so what was reachable in the shard stays so: its own lists are part of the union.
    asked = queries.column("node").to_numpy()
    who, found = range_search(vectors, links, medoid, _matrix(queries.column("v")), least)
    a, b = asked[who], nodes[found]
    if same:
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
    pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
    everyone, first = np.unique(np.concatenate([nodes, asked]), return_index=True)
    copies = np.concatenate([index.column("copies").to_numpy(), queries.column("copies").to_numpy()])[first]
    leaves = np.concatenate([_leaf_array(index), _leaf_array(queries)])[first]
    left, right = np.searchsorted(everyone, pairs[:, 0]), np.searchsorted(everyone, pairs[:, 1])
    shared = np.where((leaves[left][:, :, None] == leaves[right][:, None, :]).any(2), leaves[left], np.iinfo(np.int32).max)
    here = shared.min(1, initial=np.iinfo(np.int32).max) == leaf
    sums = np.bincount(left[here], copies[right[here]], minlength=len(everyone))
    if not same:
        sums += np.bincount(right[here], copies[left[here]], minlength=len(everyone))
    label = _labels(len(everyone), left, right)
    out = np.flatnonzero((sums > 0) | (label != np.arange(len(everyone))))
    return pa.table({"node": everyone[out], "other": everyone[label[out]], "n_links": sums[out].astype(np.int64)})


def _leaf_array(table: pa.Table) -> np.ndarray:
    lists = table.column("leaves").combine_chunks()
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def near_vectors(points: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(node, other, n_links): verified links at cosine ``least`` or more, as counts and as spanning pairs.

    Vectors go to the shards of their two nearest centres; a crowded leaf is cut by hash into parts of at most about
    ``SHARD_LIMIT``, and every part is searched for every other, so no task holds more than two parts. Each part builds its
    pruned graph, the lists of a vector from all its shards are united, and the searches walk the united lists.
    """
    count = points.count()
    if not count:
        return points.select("node", F.col("node").alias("other"), F.lit(0).cast("long").alias("n_links"))
    centres = fit_centres(points, count)
    placed = stored(assign(points, centres, OVERLAP))
    rows = placed.select("node", "copies", "v", "leaves", F.explode("leaves").alias("leaf"))
    # One row per leaf, of which there are MAX_CENTRES at most.
    crowd = {r["leaf"]: -(-r["count"] // SHARD_LIMIT) for r in rows.groupBy("leaf").count().collect()}
    parts = F.create_map(*(F.lit(x) for pair in crowd.items() for x in pair))[F.col("leaf")]
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_numpy()
        lists, _ = robust_pruned(_matrix(group.column("v")))
        held = [nodes[row[row >= 0]] for row in lists]
        return pa.table({"node": pa.array(nodes), "links": pa.array(held, pa.list_(pa.int64()))})

    lists = rows.groupBy("leaf", "part").applyInArrow(build, "node bigint, links array<bigint>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"))
    index = rows.join(united, "node").withColumn("asked", F.explode(F.expr("sequence(part, parts - 1)")))
    queries = rows.drop("links").withColumn("asked", F.col("part")).withColumn("part", F.explode(F.expr("sequence(0, asked)")))
    columns = ["leaf", "part", "asked", "node", "copies", "v", "leaves"]

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        leaf, part, asked = (k.as_py() for k in key)
        return _linked(left, right, part == asked, leaf, least)

    asked = queries.select(*(F.col(c).alias(c) for c in columns))
    both = index.select(*columns, "links").groupBy("leaf", "part", "asked").cogroup(asked.groupBy("leaf", "part", "asked"))
    return both.applyInArrow(search, LINKED)


def audit(points: DataFrame, counts: DataFrame, least: float = SIMILAR, audited: int = AUDITED) -> float:
    """Share of the links of about ``audited`` vectors, drawn by hash, that were found; against every vector, in blocks."""
    total = points.count()
    share = int(min(1.0, audited / max(total, 1)) * (1 << 30)) + 1
    asked = points.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < share).select("node", "v").limit(4 * audited).toArrow()
    if not asked.num_rows:
        return 1.0
    held = points.sparkSession.sparkContext.broadcast((asked.column("node").to_numpy(), _matrix(asked.column("v"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, vectors = held.value
        sums = np.zeros(len(nodes), np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                near = (_matrix(part.column(2)) @ vectors.T >= least) & (part.column(0).to_numpy()[:, None] != nodes[None, :])
                sums += part.column(1).to_numpy() @ near
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sums)], ["node", "links"])

    true = points.select("node", "copies", "v").mapInArrow(run, "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))
    row = true.join(counts, "node", "left").agg(F.sum("links"), F.sum(F.coalesce("n_links", F.lit(0)))).first()
    return float(row[1] / row[0]) if row[0] else 1.0


def duplicate_vectors(rows: DataFrame, id_column: str = "vec_id", column: str = "embedding", least: float = SIMILAR) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall), one row per row of ``rows``.

    Equal vectors are one point with a number of copies, so a group of copies costs one search. Links are verified in double
    precision. Unusable vectors (see ``distinct_vectors``) have no links and are their own component. ``audit_recall`` is the
    measured share of true links found for the audited vectors. An empty table gives an empty result.
    """
    named, points = distinct_vectors(rows, id_column, column)
    points = stored(points)
    links = stored(near_vectors(points, least))
    counts = stored(links.groupBy("node").agg(F.sum("n_links").alias("n_links")))
    recall = audit(points, counts, least)
    roots = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    rooted = points.select("node", "least", "copies").join(counts, "node", "left").join(roots, "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(ids, "root").select("node", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    joined = named.join(known, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
        F.lit(recall).alias("audit_recall"),
    )
