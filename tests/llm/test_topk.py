"""Top-k against all products."""

import math
import random

import numpy as np
import pytest

from loomtext.llm import topk


def brute(rows, k=5, every=50):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            s = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q))[:k]
            out += [(q, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -x))) for n, (x, i) in enumerate(s)]
    return sorted(out)


def test_equals_all_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 70)
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "SAMPLE", 40)
    r = random.Random(2)
    rows = [(i, [float(np.float32(r.gauss(0, 0.3))) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(150)]
    rows += [(700, None), (701, [None] + [0.1] * 7), (750, [math.nan] * 8), (751, [math.inf] * 8), (None, [0.5] * 8), (800, []), (801, [1.0]), (850, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(4)
    got = sorted(tuple(x) for x in topk.top_k(df).collect())
    assert got == brute(rows)


def test_large_components_few_rows_and_empty(spark):
    rows = [(0, [1e16, 3.0]), (1, [1e15, -7.0]), (2, [1e30, 1.0]), (50, [-1e16, 2.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in topk.top_k(df).collect()) == brute(rows)
    assert topk.top_k(df.where("vec_id = 0")).count() == 0
    assert topk.top_k(df.where("vec_id > 99")).count() == 0


@pytest.mark.parametrize("shift", [0.0, 0.5])
def test_tree_bounds_hold(shift):
    g = np.random.default_rng(3)
    x = np.floor(256 * g.normal(shift, 0.2, (1000, 16)))
    t = topk.BallTree(np.arange(1000), x)
    q = np.floor(256 * g.normal(0, 0.2, (5, 16)))
    b = t.bounds(q)
    for i, (s, e) in enumerate(t.leaves):
        assert ((q @ t.x[s:e].T).max(1) <= b[:, i]).all()
    assert sorted(t.ids) == list(range(1000))


def computed_share(x, q):
    """The share of all products that a search computes with the k-th best of a sample as the floor."""
    own = scores_of(q, x)
    floors = -np.partition(-own[:, :2048], 4, axis=1)[:, 4].astype(float)
    best, n = topk.Best(5, np.full(len(q), -1), floors), 0
    for a in range(0, len(x), topk.SHARD):
        n += topk.search(topk.BallTree(np.arange(a, min(len(x), a + topk.SHARD)), x[a : a + topk.SHARD]), q, best)
    for i, heap in enumerate(best.heaps):
        assert sorted((-s, -v) for s, v in heap) == sorted(zip(-own[i], range(len(x))))[:5]
    return n / own.size


def scores_of(q, x):
    return (q @ x.T).astype(np.int64)


def unit(v):
    return np.floor(256 * v / np.sqrt((v * v).sum(1, keepdims=True)))


def test_the_tree_prunes_where_vectors_cluster():
    """Directions in all of space alike (as in the test tables) leave nothing out; clusters and lengths do."""
    g = np.random.default_rng(5)
    centres = g.normal(size=(150, 64))
    close = unit(centres[g.integers(0, 150, 8000)] + 0.25 * g.normal(size=(8000, 64)))
    assert computed_share(close, close[::50]) < 0.15
    lengths = np.floor(unit(g.normal(size=(8000, 64))) * g.pareto(1.5, (8000, 1)))
    assert computed_share(lengths, lengths[::50]) < 0.3
    assert computed_share(unit(g.normal(size=(4000, 64))), unit(g.normal(size=(60, 64)))) <= 1


def test_memory_of_a_task_does_not_change_results(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "HELD", 1)
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    assert sorted(tuple(x) for x in topk.top_k(df).collect()) == brute(rows)
