"""Operators on vectors: brute-force versions, nulls, non-finite and short vectors, ties,
repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, v string, cluster string, n string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def _sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _clusters(rows, k, rounds, dimensions, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if _sound(v) and len(v) == dimensions]
    def key(row):
        return (row[0] is None, hashlib.sha256(f"3:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1])
    means = [v for _, v in sorted(kept, key=key)[:k]]
    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(means))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(means)):
            group = [v for (_, v), o in zip(kept, own) if o == c]
            if group:
                means[c] = [sum(x) // len(group) for x in zip(*group)]
    last = [(i, *nearest(v)) for i, v in kept]
    return sorted((str(i), c, d, sum(x[1] for x in last if x[2] == c), sum(x[1] for x in last),
                   hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for i, d, c in last)


def _vectors(dimensions, seed=3):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice((-2.0, -1.0, -0.5, 0.0, 0.25, 1.0, 3.0)) for _ in range(dimensions)], rnd.randint(0, 3)) for i in range(160)]
    rows += [(None, [0.5] * dimensions, 1), (None, None, None), (900, None, 2), (901, [], 2), (902, [1.0] * (dimensions + 1), 2),
             (903, [float("nan")] * dimensions, 1), (904, [float("-inf")] + [0.0] * (dimensions - 1), 1),
             (905, [None] + [0.0] * (dimensions - 1), 1)]
    return rows + [rows[5], rows[5], (5, rows[6][1], 2)]


@pytest.mark.parametrize("k, rounds, dimensions", [(8, 10, 6), (1, 3, 6), (400, 2, 3), (3, 0, 2)])
def test_clusters_equal_brute_force(spark, k, rounds, dimensions):
    rows = _vectors(dimensions)
    got = centroids.cluster_vectors(_frame(spark, rows).repartition(3), k, rounds, dimensions, scale=4).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == _clusters(rows, k, rounds, dimensions, 4)


def test_clusters_of_nothing_and_of_too_much(spark):
    assert centroids.cluster_vectors(_frame(spark, []), 3, 2, 2).count() == 0
    assert centroids.cluster_vectors(_frame(spark, [(1, None, 1)]), 3, 2, 2).columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster_vectors(_frame(spark, [(1, [1e300, 0.0], 1)]), 3, 2, 2).count()


def test_threshold_search_stops_early_and_keeps_ties():
    rng = np.random.default_rng(4)
    means = rng.integers(-9, 9, (300, 3))
    means[200:] = means[:100]          # equal centroids: the smaller number wins
    x = rng.integers(-12, 12, (500, 3))
    lists = centroids.CentroidLists(means)
    number, best = lists.nearest(x)
    exact = ((x[:, None, :] - means) ** 2).sum(axis=2)
    assert (best == exact.min(axis=1)).all() and (number == exact.argmin(axis=1)).all()
    assert [len(a) for a in lists.nearest(x[:0])] == [0, 0]


def _negatives(rows, anchor, p, q, window, scale):
    kept = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows if lab is not None and _sound(v)]
    def by(entry):
        return (-entry[0], entry[1] is None, entry[1] or 0)
    out = []
    for i, lab, v in kept:
        if i is None or not anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in kept]
        first = sorted(((s, j) for s, j, other in scored if other == lab and j != i), key=by)[:p]
        for score, j in first:
            near = sorted(((s, m) for s, m, other in scored if other != lab
                           and window[0] * score <= 100 * s <= window[1] * score), key=by)[:q]
            out += [(i, j, k + 1, m, score, s) for k, (s, m) in enumerate(near)]
    return sorted(out, key=str)


@pytest.mark.parametrize("tile, p, q, window", [(16, 5, 3, (50, 95)), (1024, 2, 4, (0, 100)), (7, 1, 1, (-50, 95))])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, tile, p, q, window):
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", tile)
    monkeypatch.setattr(hard_negatives, "HELD_TILES", 2)
    rows = _vectors(6) + [(910, [1.0, 2.0], 1), (915, [], 1), (920, [3.0] * 9, None)]
    frame = _frame(spark, rows).repartition(4)
    got = hard_negatives.hard_negatives(frame, F.expr("vec_id % 5 = 0"), p, q, window, scale=4).collect()
    want = _negatives(rows, lambda i: i % 5 == 0, p, q, window, 4)
    assert sorted(map(tuple, got), key=str) == want and len(want) > 30


def test_hard_negatives_of_nothing_and_of_too_much(spark):
    for rows in ([], [(1, [1.0], 1)], [(50, None, 1), (100, [1.0], None)], [(50, [], 1), (51, [], 1), (52, [], 2)]):
        got = hard_negatives.hard_negatives(_frame(spark, rows)).collect()
        assert [tuple(r) for r in got] == ([(50, 51, 1, 52, 0, 0)] if len(rows) == 3 else [])
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.hard_negatives(_frame(spark, [(50, [1e300], 1)])).count()


@pytest.mark.parametrize("shape", [(1, 1, 1), (300, 17, 301), (513, 64, 260), (700, 33, 515), (5, 0, 4)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(7)
    a, b = rng.integers(-1 << 28, 1 << 28, shape[:2]), rng.integers(-1 << 28, 1 << 28, shape[1:])
    a[0], b[:, 0] = a[0] // 1000, b[:, 0] * 4      # sums on the way may pass 64 bits
    assert (hard_negatives.strassen(a, b) == a @ b).all()


def test_heaps_merge():
    rng = np.random.default_rng(8)
    slot, score, ids = rng.integers(0, 9, 400), rng.integers(0, 6, 400), rng.integers(0, 50, 400)
    none = rng.random(400) < 0.1
    ids[none] = 0
    whole, parts = hard_negatives.Heaps(9, 4), [hard_negatives.Heaps(9, 4) for _ in range(3)]
    whole.offer(slot, score, ids, none)
    for i, h in enumerate(parts):
        h.offer(slot[i::3], score[i::3], ids[i::3], none[i::3])
        if i:
            parts[0].offer(h.slot, h.score, h.id, h.no_id)
    for name in ("slot", "score", "id", "no_id", "least"):
        assert (getattr(whole, name) == getattr(parts[0], name)).all(), name
