"""The layout queries lay out every order."""

import math
import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from loomtext.catalog import table
from loomtext.operators import layout
from loomtext.plans import queries

SF = "/root/testdata/sf0.001"


def by_customer(spark):
    out = {}
    for r in table(spark, SF, "orders").select("o_custkey", "o_orderkey").collect():
        out.setdefault(r.o_custkey, []).append(r.o_orderkey)
    return {k: sorted(v) for k, v in out.items()}


def test_graph_layout_has_all_orders(spark):
    got = queries.graph_layout(spark, SF).collect()
    want = by_customer(spark)
    assert sorted((r.graph_id, r.id) for r in got) == sorted((k, x) for k, v in want.items() for x in v)
    # Edges go to the order after the next, so ranks follow from the place among the customer's orders.
    assert {r.id: r.rank for r in got} == {x: i // 2 for v in want.values() for i, x in enumerate(v)}


def test_force_layout_simulates_all_orders_and_edges(spark):
    got = {(r.graph_id, r.id): (r.x, r.y) for r in queries.force_layout(spark, SF).collect()}
    want = by_customer(spark)
    assert set(got) == {(k, x) for k, v in want.items() for x in v}
    for k in sorted(want)[:5]:
        ids = want[k]
        nodes = pd.DataFrame({"id": ids, "x": None, "y": None, "fixed": False})
        edges = pd.DataFrame({"source": ids[:-2], "target": ids[2:], "distance": None, "strength": None})
        out = layout.simulate(nodes, edges)
        assert [got[k, x] for x in ids] == [pytest.approx(p, abs=1e-6) for p in zip(out["x"], out["y"], strict=True)]
        assert len(ids) < 3 or layout.simulate(nodes, edges[:0])["x"] != out["x"]


def test_order_by_neighbours_alone():
    """A layer is ordered by the mean place of its neighbours in other layers; those in the layer itself count as 0."""
    nodes = {"id": list("abcdef"), "width": [10.0] * 6, "height": [10.0] * 6, "rank": [0, 0, 0, 1, 1, 1]}
    edges = {"source": list("abc"), "target": list("fed"), "minlen": [None] * 3}
    out = layout.layered(nodes, edges)
    x = dict(zip(out["id"], out["x"], strict=True))
    assert (x["a"] < x["b"] < x["c"]) == (x["f"] < x["e"] < x["d"])
    many = {"id": list(range(20_000)), "width": [1.0] * 20_000, "height": [1.0] * 20_000, "rank": [None] * 20_000}
    chain = {"source": list(range(19_999)), "target": list(range(1, 20_000)), "minlen": [1] * 19_999}
    assert layout.layered(many, chain)["rank"] == list(range(20_000))  # linear in layers and edges for each sweep


def _one_by_one(x, y, fixed, arcs, o):
    """The simulation as plain loops over nodes and edges (source, target, distance or None, strength or None)."""
    n, vx, vy, degree = len(x), [0.0] * len(x), [0.0] * len(x), [0] * len(x)
    for k in range(n):
        w, r = k * math.pi * (3.0 - math.sqrt(5.0)), math.sqrt(k + 0.5) * 10.0
        x[k], y[k] = r * math.cos(w) if x[k] is None else x[k], r * math.sin(w) if y[k] is None else y[k]
    for u, v, _, _ in arcs:
        degree[u] += 1
        degree[v] += 1
    alpha, decay = o.alpha, 1.0 - 0.001 ** (1.0 / max(1, o.iterations))
    for _ in range(o.iterations):
        if alpha < 0.001:
            break
        for i in range(n):
            fx = fy = 0.0
            for j in range(n):
                if i != j:
                    dx, dy = x[i] - x[j], y[i] - y[j]
                    square = max(dx * dx + dy * dy, 1e-6)
                    d, w = math.sqrt(square), (o.charge * alpha) / square
                    fx += (dx / d) * w
                    fy += (dy / d) * w
            if not fixed[i]:
                vx[i] += fx
                vy[i] += fy
        for u, v, rest, pull in arcs:
            dx, dy = x[v] - x[u], y[v] - y[u]
            d = max(math.sqrt(dx * dx + dy * dy), 1e-6)
            w = alpha * (pull or 1.0 / max(1, min(degree[u], degree[v]))) * ((d - (30.0 if rest is None else rest)) / d)
            for p, q, sign in ((u, degree[v], 1), (v, degree[u], -1)):
                if not fixed[p]:
                    vx[p] += sign * (dx * w * (q / max(1, degree[u] + degree[v])))
                    vy[p] += sign * (dy * w * (q / max(1, degree[u] + degree[v])))
        for i in range(n):
            if not fixed[i]:
                vx[i] += (o.center_x - x[i]) * o.center_strength * alpha
                vy[i] += (o.center_y - y[i]) * o.center_strength * alpha
        for i in range(n if o.collide_radius > 0 else 0):
            for j in range(i + 1, n):
                dx, dy = x[j] - x[i], y[j] - y[i]
                d = max(math.sqrt(dx * dx + dy * dy), 1e-6)
                if d < o.collide_radius * 2.0:
                    overlap = (o.collide_radius * 2.0 - d) / 2.0
                    for p, sign in ((i, -1), (j, 1)):
                        if not fixed[p]:
                            x[p] += sign * (dx / d * overlap)
                            y[p] += sign * (dy / d * overlap)
        for i in range(n):
            if not fixed[i]:
                vx[i] *= 1.0 - o.velocity_decay
                vy[i] *= 1.0 - o.velocity_decay
                x[i] += vx[i]
                y[i] += vy[i]
        alpha *= 1.0 - decay
    return x, y


def _random_graphs(count, largest, seed):
    rng = random.Random(seed)
    for g in range(count):
        n = rng.randint(1, largest)
        place = lambda: None if rng.random() < 0.3 else rng.uniform(-90, 90)  # noqa: E731, B023
        nodes = [(g, f"n{i:02}", place(), place(), rng.choice([None, False, False, True])) for i in range(n)]
        edges = [(g, f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}", rng.choice([None, 20.0]), rng.choice([None, 0.0, 0.5])) for _ in range(rng.randint(0, 2 * n))]
        yield nodes, sorted({e[:3]: e for e in edges}.values())


@pytest.mark.parametrize("options", [layout.ForceOptions(), layout.ForceOptions(iterations=40, charge=25.0, collide_radius=12.0, center_x=3.0)])
def test_force_layout_is_the_loop_over_each_graph(spark, options):
    """To the last bit, as the simulation magnifies rounding; graphs of one task do not touch each other, unknown ends do not count."""
    graphs = list(_random_graphs(40, 12, 5))
    graphs += [([(g + 100, *v[1:]) for v in n], [(g + 100, *e[1:]) for e in a]) for g, (n, a) in enumerate(graphs[:10])]  # equal ones
    nodes, edges = [v for n, _ in graphs for v in n], [e for _, a in graphs for e in a]
    stray = [(0, "n00", "nowhere", None, None), (0, None, "n00", None, None), (77, "n00", "n01", None, None)]
    frames = spark.createDataFrame(nodes, "graph_id int, id string, x double, y double, fixed boolean"), spark.createDataFrame(edges + stray, "graph_id int, source string, target string, distance double, strength double")
    got = {(r.graph_id, r.id): (r.x, r.y) for r in layout.force_layout(*frames, options=options).collect()}
    assert len(got) == len(nodes)
    for n, a in graphs:
        at = {v[1]: i for i, v in enumerate(n)}
        x, y = _one_by_one([v[2] for v in n], [v[3] for v in n], [bool(v[4]) for v in n], [(at[e[1]], at[e[2]], *e[3:]) for e in a], options)
        assert [got[v[0], v[1]] for v in n] == list(zip(x, y, strict=True))
    assert layout.force_layout(frames[0].limit(0), frames[1]).count() == 0


def test_force_layout_cuts_graphs_and_blocks(monkeypatch):
    """Tables end between graphs, however batches fall; a graph of many nodes goes in blocks of them."""
    n = 400
    x, y = _one_by_one([None] * n, [None] * n, [False] * n, [], layout.ForceOptions(iterations=3))
    nodes = {"id": list(range(n)), "x": [None] * n, "y": [None] * n, "fixed": [False] * n}
    none = {c: [] for c in ("source", "target", "distance", "strength")}
    out = layout.simulate(nodes, none, layout.ForceOptions(iterations=3))
    assert (out["x"], out["y"]) == (x, y)
    monkeypatch.setattr(layout, "_ROWS", 4)
    keys = [None, 1, 1, 2, 2, 2, 2, 2, 2, 3, 4, 4, 5, 5, 5]
    for width in (1, 2, 3, 7, 20):
        batches = [pa.record_batch({"key": pa.array(keys[i : i + width], pa.int64())}) for i in range(0, len(keys), width)]
        cut = [t.column("key").to_pylist() for t in layout._cut([batches[0][:0], *batches])]
        assert [k for c in cut for k in c] == keys and not any(set(a) & set(b) for i, a in enumerate(cut) for b in cut[i + 1 :])


def test_force_layout_of_many_graphs_in_time():
    """Graphs that all differ; one by one these took a minute."""
    rng = np.random.default_rng(3)
    graphs, n = 3000, 10
    x, y = rng.uniform(-90, 90, (2, graphs * n)).tolist()
    rows = {"key": [g for g in range(graphs) for _ in range(n)], "edge": [False] * graphs * n, "order": list(range(n)) * graphs, "then": pa.nulls(graphs * n, pa.int64()), "first": x, "second": y, "fixed": [False] * graphs * n}
    began = time.process_time()
    out = layout._simulated(pa.table(rows), layout.ForceOptions())
    assert time.process_time() - began < 20 and out.num_rows == graphs * n
    alone = layout.simulate({"id": list(range(n)), "x": x[-n:], "y": y[-n:], "fixed": [False] * n}, {c: [] for c in ("source", "target", "distance", "strength")})
    assert out.column("x").to_pylist()[-n:] == alone["x"] and out.column("y").to_pylist()[-n:] == alone["y"]
