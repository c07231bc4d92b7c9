"""Centroid clustering and hard negatives against exact arithmetic in plain Python, on ties, nulls, wide numbers and repeated rows."""

import hashlib
import math
import random

import numpy as np
import pytest

KINDS = "vec_id long, embedding array<double>, label int, x string, cluster string, id string"


def whole(v):
    return [min(2 ** 53, max(-2 ** 53, math.floor(256 * x))) for x in v]


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def data(dims=4, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.choice((-0.5, -0.25, 0.0, 0.25, 0.5, rng.gauss(0, 0.2))) for _ in range(dims)], 0 if rng.random() < 0.4 else rng.randrange(4)) for i in range(n)]
    rows += [(7, rows[7][1], 1), (100, rows[100][1], rows[100][2]), (100, rows[100][1], rows[100][2]), (None, rows[3][1], 0), (500, None, 0), (501, [0.1, None, 0.1, 0.1], 0), (502, [0.1, math.nan, 0.1, 0.1], 0),
             (600, [0.1, math.inf, 0.1, 0.1], 0), (700, [0.5] * (dims - 1), 0), (701, [], 0), (800, [0.5] * dims, None), (900, [0.0] * dims, 2), (901, [3e6] * dims, 2), (902, [1e300, -1e9, 0.0, 1.0], 3), (903, [-3e6] * dims, 0)]
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], KINDS).repartition(parts)


def brute_clusters(rows, k, dims, rounds):
    kept = [(i, whole(v)) for i, v, _ in rows if fine(v) and len(v) == dims]
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), np.array(v, float).tobytes(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, _, v in starts]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        groups = {}
        for (_, v), (_, n) in zip(kept, assign()):
            groups.setdefault(n, []).append(v)
        centroids = [[sum(x) // len(x) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    top = 2 ** 63 - 1
    found = assign()
    inertia = {n: sum(min(d, top) for d, m in found if m == n) for _, n in found}
    return [(i, n, min(d, top), min(inertia[n], top), min(sum(inertia.values()), top), centroids[n]) for (i, _), (d, n) in zip(kept, found)]


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("k", [6, 1000])
def test_clusters(spark, wide, k):
    from polyvane.llm.centroids import centroid_clusters

    rows = [r for r in data() if wide or r[0] is None or r[0] < 901]
    got = centroid_clusters(frame(spark, rows), k=k, dims=4, rounds=3)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_clusters(rows, k, 4, 3), key=str)


def test_no_vectors(spark):
    from polyvane.llm.centroids import centroid_clusters
    from polyvane.llm.negatives import hard_negatives

    none = spark.createDataFrame([], KINDS)
    assert centroid_clusters(none, dims=4).collect() == [] and hard_negatives(none).collect() == []
    lone = spark.createDataFrame([(5, None, 1, "", "", ""), (100, [1.0], 1, "", "", "")], KINDS)
    assert centroid_clusters(lone, dims=4).collect() == [] and hard_negatives(lone).collect() == []


def test_screen_is_rigorous():
    """The shortlist always holds all nearest centroids, though float32 alone would pick others, and is short on vectors that lie apart."""
    from polyvane.llm.centroids import nearest, screen

    rng = np.random.default_rng(5)
    wrong = 0
    for scale in (1 << 8, 1 << 13, 1 << 25):
        centroids = rng.integers(-scale, scale, (40, 64)).astype(float)
        centroids[20:] = centroids[:20]
        centroids[20:, 0] += rng.integers(0, 2, 20)  # ties and near ties
        x = centroids[rng.integers(0, 40, 500)] + rng.integers(-3, 4, (500, 64))
        d = ((x[:, None, :].astype(np.int64) - centroids[None].astype(np.int64)) ** 2).sum(axis=2)
        near = screen(x, centroids)
        assert near[d == d.min(axis=1)[:, None]].all()
        label, distance = nearest(x, centroids)
        assert (label == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
        assert near.sum(axis=1).mean() < 6
        middle = (centroids * centroids).sum(axis=1).astype(np.float32) - 2 * (x.astype(np.float32) @ centroids.astype(np.float32).T)
        wrong += (middle.argmin(axis=1) != d.argmin(axis=1)).sum()
    assert wrong > 0


def brute_negatives(rows, positives, negatives, low, high):
    top = 2 ** 63 - 1
    kept = [(i, whole(v), y) for i, v, y in rows if i is not None and y is not None and fine(v)]
    out = []
    for a, (anchor, v, y) in enumerate(kept):
        if anchor % 100:
            continue
        scored = [(-max(-top, min(top, sum(p * q for p, q in zip(v, w)))), i, z) for b, (i, w, z) in enumerate(kept) if b != a]
        for s, i, _ in sorted(x for x in scored if x[2] == y)[:positives]:
            inside = sorted((t, j) for t, j, z in scored if z != y and low * -s <= 100 * -t <= high * -s)
            out += [(anchor, i, n + 1, j, -s, -t) for n, (t, j) in enumerate(inside[:negatives])]
    return out


@pytest.mark.parametrize("wide", [False, True])
def test_negatives(spark, wide, monkeypatch):
    from polyvane.llm import negatives as N

    rows = [r for r in data() if wide or r[0] is None or r[0] < 901]
    want = sorted(brute_negatives(rows, 5, 10, 30, 90))
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = N.hard_negatives(frame(spark, rows))
    assert got.columns == columns and sorted(map(tuple, got.collect())) == want and len(want) > 100
    # several batches of anchors, several blocks of a batch
    monkeypatch.setattr(N, "ANCHORS", 3)
    monkeypatch.setattr(N, "BLOCK", 2)
    assert sorted(map(tuple, N.hard_negatives(frame(spark, rows, 3)).collect())) == want
    few = N.hard_negatives(frame(spark, rows), "vec_id % 100 = 0", positives=2, negatives=3, window=(50, 80))
    assert sorted(map(tuple, few.collect())) == sorted(brute_negatives(rows, 2, 3, 50, 80))


def test_blocks_are_bounded():
    """Blocks hold at most so many doubles, also where one vector is far longer than the others."""
    import pyarrow as pa

    from polyvane.llm import vectors as V

    sizes = np.array([3] * 5000 + [400_000] + [3] * 10)
    column = V.pack(np.arange(sizes.sum(), dtype=float), sizes)
    batch = pa.RecordBatch.from_arrays([column], ["x"])
    parts = list(V.chunks(batch, "x"))
    assert sum(p.num_rows for p in parts) == len(sizes)
    assert all(p.num_rows == 1 or V.matrix(p.column(0)).size <= V.ENTRIES for p in parts)
    assert (V.matrix(parts[1].column(0))[0] == np.arange(3 * parts[0].num_rows, 3 * parts[0].num_rows + 3)).all()
