"""Layouts of many graphs at once: nodes and edges are tables keyed by graph, and each graph is a group.

A graph is laid out by one task, as its layout depends on all of it; graphs spread over tasks.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns by name: a dictionary of lists, or a data frame.
Columns = Mapping[str, Sequence]


@dataclass(frozen=True)
class LayerOptions:
    direction: str = "TB"
    node_gap: float = 50.0
    rank_gap: float = 50.0
    margin_x: float = 0.0
    margin_y: float = 0.0
    sweeps: int = 4


def ranks(n: int, arcs: dict[tuple[int, int], int], multiplicity: dict[tuple[int, int], int]) -> list[int]:
    """Longest path from the sources; nodes that only cycles reach keep what they have got."""
    out, waiting = [0] * n, [0] * n
    after: dict[int, list[int]] = {}
    for (u, v), m in multiplicity.items():
        after.setdefault(u, []).append(v)
        waiting[v] += m
    ready = deque(v for v in range(n) if not waiting[v])
    while ready:
        u = ready.popleft()
        for v in after.get(u, ()):
            out[v] = max(out[v], out[u] + arcs[u, v])
            waiting[v] -= multiplicity[u, v]
            if not waiting[v]:
                ready.append(v)
    return out


def _missing(x) -> bool:
    return x is None or x != x


def layered(nodes: Columns, edges: Columns, o: LayerOptions = LayerOptions()) -> dict[str, list]:
    """nodes (id, width, height, rank or null) with x, y and rank; edges (source, target, minlen or null) to unknown nodes do not count."""
    ids = list(nodes["id"])
    at = {x: i for i, x in enumerate(ids)}
    known = [(at[s], at[t], 1 if _missing(m) else int(m)) for s, t, m in zip(edges["source"], edges["target"], edges["minlen"], strict=True) if s in at and t in at]
    arcs = {(u, v): m for u, v, m in known}
    times: dict[tuple[int, int], int] = {}
    for u, v, _ in known:
        times[u, v] = times.get((u, v), 0) + 1
    rank = ranks(len(ids), arcs, times)
    rank = [r if _missing(p) else int(p) for r, p in zip(rank, nodes["rank"], strict=True)]
    layers: list[list[int]] = [[] for _ in range(max(rank, default=0) + 1)]
    for i, r in enumerate(rank):
        layers[r].append(i)
    before: dict[int, list[int]] = {}
    after: dict[int, list[int]] = {}
    for u, v, _ in known:
        after.setdefault(u, []).append(v)
        before.setdefault(v, []).append(u)

    place = [0] * len(ids)
    for layer in layers:
        for i, v in enumerate(layer):
            place[v] = i

    def order(k: int, near: dict[int, list[int]]) -> None:
        # Neighbours in other layers count with their place there, those in the layer itself as 0.
        mean = {v: sum(place[m] for m in near[v] if rank[m] != k) / len(near[v]) if v in near else math.inf for v in layers[k]}
        layers[k].sort(key=mean.__getitem__)
        for i, v in enumerate(layers[k]):
            place[v] = i

    for _ in range(o.sweeps):
        for k in range(1, len(layers)):
            order(k, before)
        for k in range(len(layers) - 2, -1, -1):
            order(k, after)
    width, height = (np.array(list(nodes[c]), float) for c in ("width", "height"))
    x, y = np.zeros(len(ids)), np.zeros(len(ids))
    top, widest = o.margin_y, 0.0
    for layer in layers:
        tall = max((height[i] for i in layer), default=0.0)
        w = width[layer]
        left = o.margin_x + np.concatenate([[0.0], np.cumsum(w + o.node_gap)])
        x[layer], y[layer] = left[:-1] + w / 2, top + tall / 2
        widest = max(widest, left[-1] - o.node_gap)
        top += tall + o.rank_gap
    total = top - o.rank_gap + o.margin_y
    if o.direction in ("LR", "RL"):
        x, y = (total - y if o.direction == "RL" else y), x
    elif o.direction == "BT":
        y = total - y
    return {"id": ids, "x": x.tolist(), "y": y.tolist(), "rank": rank}


@dataclass(frozen=True)
class ForceOptions:
    iterations: int = 300
    charge: float = -30.0
    collide_radius: float = 0.0
    center_x: float = 0.0
    center_y: float = 0.0
    center_strength: float = 0.1
    velocity_decay: float = 0.4
    alpha: float = 1.0
    alpha_decay: float | None = None


#: Pairs of nodes that are held at once, few enough for the caches, and rows of nodes and edges that a task lays out at once, beyond those of the last graph.
_PAIRS, _ROWS = 32768, 1 << 19


def _spiral(n: int) -> np.ndarray:
    """Where nodes begin that have no place of their own."""
    around = [k * math.pi * (3 - math.sqrt(5)) for k in range(n)]
    return np.array([(math.sqrt(k + 0.5) * 10.0 * math.cos(w), math.sqrt(k + 0.5) * 10.0 * math.sin(w)) for k, w in enumerate(around)]).reshape(n, 2)


def _moved(x: np.ndarray, y: np.ndarray, free: np.ndarray, a: np.ndarray, b: np.ndarray, rest: np.ndarray, pull: np.ndarray, o: ForceOptions) -> tuple[np.ndarray, np.ndarray]:
    """x and y after the simulation of several graphs of equally many nodes: arrays of (nodes, graphs).

    Edges go from a to b, places in the flat arrays; rest and pull are NaN where not given. The simulation magnifies
    rounding, so each sum is taken in the order of nodes, then of edges, as a loop over single graphs takes it, and what
    a graph gets does not depend on the others. A block of nodes meets all others at once, so memory is linear in nodes.
    """
    n, graphs = x.shape
    x, y = x.copy(), y.copy()
    degree = np.bincount(a, minlength=x.size) + np.bincount(b, minlength=x.size)
    rest, pull = np.where(np.isnan(rest), 30.0, rest), np.where(np.isnan(pull), 0.0, pull)
    pull = np.where(pull == 0, 1 / np.maximum(1, np.minimum(degree[a], degree[b])), pull)
    both = np.maximum(1, degree[a] + degree[b])
    ends, share = np.column_stack([a, b]).ravel(), np.column_stack([degree[b] / both, -(degree[a] / both)])
    decay = 1 - 0.001 ** (1 / max(1, o.iterations)) if o.alpha_decay is None else o.alpha_decay
    alpha, held = o.alpha, None if free.all() else ~free
    vx, vy, fx, fy = (np.zeros_like(x) for _ in range(4))
    # Never one column alone: numpy would sum it in another order.
    block = min(n, max(2, _PAIRS // (n * graphs)))
    gx, gy, s, t = (np.empty((n, block, graphs)) for _ in range(4))
    for _ in range(o.iterations):
        if alpha < 0.001:
            break
        for i in range(0, n if n > 1 else 0, block):
            own = slice(min(i, n - block), min(i, n - block) + block)
            np.subtract(x[own], x[:, None], out=gx)
            np.subtract(y[own], y[:, None], out=gy)
            np.multiply(gx, gx, out=s)
            np.multiply(gy, gy, out=t)
            np.add(s, t, out=s)
            np.maximum(s, 1e-6, out=s)
            np.sqrt(s, out=t)
            np.divide(o.charge * alpha, s, out=s)
            for g, f in ((gx, fx), (gy, fy)):
                np.divide(g, t, out=g)
                np.multiply(g, s, out=g)
                np.add.reduce(g, axis=0, out=f[own])
        vx += fx
        vy += fy
        if len(a):
            ex, ey = x.ravel()[b] - x.ravel()[a], y.ravel()[b] - y.ravel()[a]
            length = np.maximum(np.sqrt(ex * ex + ey * ey), 1e-6)
            move = alpha * pull * ((length - rest) / length)
            for v, e in ((vx, ex), (vy, ey)):
                np.add.at(v.reshape(-1), ends, ((e * move)[:, None] * share).ravel())
        if o.center_strength > 0:
            vx += (o.center_x - x) * o.center_strength * alpha
            vy += (o.center_y - y) * o.center_strength * alpha
        if o.collide_radius > 0:
            for i in range(n):
                for j in range(i + 1, n):
                    dx, dy = x[j] - x[i], y[j] - y[i]
                    length = np.maximum(np.sqrt(dx * dx + dy * dy), 1e-6)
                    overlap = np.where(length < o.collide_radius * 2, (o.collide_radius * 2 - length) / 2, 0)
                    for p, d in ((x, dx), (y, dy)):
                        p[i] -= np.where(free[i], d / length * overlap, 0)
                        p[j] += np.where(free[j], d / length * overlap, 0)
        for p, v in ((x, vx), (y, vy)):
            v *= 1 - o.velocity_decay
            if held is not None:
                v[held] = 0
            p += v
        alpha *= 1 - decay
    return x, y


def simulate(nodes: Columns, edges: Columns, o: ForceOptions = ForceOptions()) -> dict[str, list]:
    """nodes (id, x, y, fixed; x and y may be null) with x and y; edges (source, target, distance, strength, the last two may be null).

    The charge keeps the sign that is given: with the default, velocities point to the other nodes.
    """
    ids = list(nodes["id"])
    at = {x: i for i, x in enumerate(ids)}
    numbers = lambda values: np.array([math.nan if _missing(v) else v for v in values], float)
    x, y, spiral = numbers(nodes["x"]), numbers(nodes["y"]), _spiral(len(ids))
    x, y = np.where(np.isnan(x), spiral[:, 0], x), np.where(np.isnan(y), spiral[:, 1], y)
    free = ~np.array([not _missing(v) and bool(v) for v in nodes["fixed"]], bool)
    known = [(at[s], at[t], d, g) for s, t, d, g in zip(edges["source"], edges["target"], edges["distance"], edges["strength"], strict=True) if s in at and t in at]
    a, b = (np.array([e[i] for e in known], np.int64) for i in (0, 1))
    if not ids:
        return {"id": ids, "x": [], "y": []}
    with np.errstate(all="ignore"):
        x, y = _moved(x[:, None], y[:, None], free[:, None], a, b, numbers(e[2] for e in known), numbers(e[3] for e in known), o)
    return {"id": ids, "x": x[:, 0].tolist(), "y": y[:, 0].tolist()}


def _grouped(nodes: DataFrame, edges: DataFrame, key: str, fn, ddl: str) -> DataFrame:
    """fn of each graph's nodes and edges. One sorted stream holds the nodes of a graph, then its edges, then the next
    graph, so that graphs of a few nodes cost no more than their rows, and a task holds one graph at a time."""
    own = [c for c in nodes.columns if c != key]
    arcs = [c for c in edges.columns if c != key]
    n = nodes.select(F.col(key).alias("key"), F.lit(False).alias("edge"), F.col("id").alias("order"), F.lit(None).cast(nodes.schema["id"].dataType).alias("then"), F.struct(*own).alias("node"), F.lit(None).cast(edges.select(F.struct(*arcs).alias("s")).schema["s"].dataType).alias("arc"))
    e = edges.select(F.col(key).alias("key"), F.lit(True).alias("edge"), F.col("source").alias("order"), F.col("target").alias("then"), F.lit(None).cast(n.schema["node"].dataType).alias("node"), F.struct(*arcs).alias("arc"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = n.unionByName(e).repartition(parts, "key").sortWithinPartitions("key", "edge", "order", "then")
    ddl = f"{key} {nodes.schema[key].dataType.simpleString()}, id {nodes.schema['id'].dataType.simpleString()}, {ddl}"
    columns = [x.split()[0] for x in ddl.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def laid_out(graph) -> list[list]:
            k, vertices, links = graph
            out = fn({c: [v[c] for v in vertices] for c in own}, {c: [a[c] for a in links] for c in arcs}) if vertices else {}
            return [[k] * len(vertices), *(out[c] for c in columns[1:])] if vertices else [[] for _ in columns]

        graph, kinds = None, None
        for b in batches:
            kinds = [b.schema.field("key").type, b.schema.field("order").type, *(pa.int32() if d.endswith(" int") else pa.float64() for d in ddl.split(", ")[2:])]
            done = [[] for _ in columns]
            for k, node, arc in zip(*(b.column(c).to_pylist() for c in ("key", "node", "arc")), strict=True):
                if graph is None or graph[0] != k:
                    if graph is not None:
                        for held, new in zip(done, laid_out(graph), strict=True):
                            held += new
                    graph = k, [], []
                graph[2 if node is None else 1].append(arc if node is None else node)
            yield pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip(done, kinds, strict=True)], names=columns)
        if graph is not None:
            yield pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip(laid_out(graph), kinds, strict=True)], names=columns)

    return rows.select("key", "order", "node", "arc").mapInArrow(run, ddl)


def layered_layout(nodes: DataFrame, edges: DataFrame, key: str = "graph_id", options: LayerOptions = LayerOptions()) -> DataFrame:
    """(key, id, x, y, rank) of nodes (key, id, width, height, rank) and edges (key, source, target, minlen); nodes in order of id."""
    return _grouped(nodes, edges, key, lambda n, e: layered(n, e, options), "x double, y double, rank int")


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole graphs from batches in which each graph's rows follow one another."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows and sum(h.num_rows for h in held) >= _ROWS:
            keys = pa.chunked_array([held[-1].column("key")[-1:], b.column("key")]).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            new = np.flatnonzero(keys[1:] != keys[:-1])
            if len(new):
                yield pa.Table.from_batches([*held, b[: int(new[0])]])
                held, b = [], b[int(new[0]) :]
        held += [b] if b.num_rows else []
    if held:
        yield pa.Table.from_batches(held)


def _simulated(rows: pa.Table, o: ForceOptions) -> pa.RecordBatch:
    """The nodes of whole graphs with their places. Graphs of equally many nodes move together, and graphs that are equal but for the names of their nodes once."""
    rows = rows.combine_chunks()
    column = lambda t, c: pa.concat_arrays(t.column(c).chunks) if t.num_rows else pa.array([], t.schema.field(c).type)
    numbers = lambda t, c: np.asarray(column(t, c).fill_null(math.nan))
    keys = column(rows, "key").dictionary_encode("encode").indices.to_numpy()
    graph, edge = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])), np.asarray(column(rows, "edge"))
    nodes, edges = rows.filter(pa.array(~edge)), rows.filter(pa.array(edge))
    of_node, of_edge, graphs = graph[~edge], graph[edge], int(graph[-1]) + 1
    size = np.bincount(of_node, minlength=graphs)
    first = np.cumsum(size) - size
    local = np.arange(len(of_node)) - first[of_node]

    # Edges know nodes by name, of several with one name the last.
    names = pa.concat_arrays([column(nodes, "order"), column(edges, "order"), column(edges, "then")]).dictionary_encode("encode").indices.to_numpy().astype(np.int64)
    names += np.concatenate([of_node, of_edge, of_edge]) * (int(names.max(initial=0)) + 1)
    own, ends = names[: len(of_node)], names[len(of_node) :]
    sorted_by = np.argsort(own, kind="stable")
    found = np.searchsorted(own, ends, "right", sorted_by) - 1
    place = sorted_by[np.maximum(found, 0)] if len(own) else np.zeros(len(ends), np.int64)
    known = (found >= 0) & (own[place] == ends) if len(own) else np.zeros(len(ends), bool)
    known = known[: len(of_edge)] & known[len(of_edge) :]
    of_edge, a, b = of_edge[known], local[place[: len(edges)][known]], local[place[len(edges) :][known]]

    spiral, x, y = _spiral(int(size.max(initial=0)))[local], numbers(nodes, "first"), numbers(nodes, "second")
    starts = np.column_stack([np.where(np.isnan(x), spiral[:, 0], x), np.where(np.isnan(y), spiral[:, 1], y), ~np.asarray(column(nodes, "fixed").fill_null(False))])
    links = np.column_stack([a, b, numbers(edges, "first")[known], numbers(edges, "second")[known]])
    arcs = np.concatenate([[0], np.cumsum(np.bincount(of_edge, minlength=graphs))])
    kinds: dict[tuple[bytes, bytes], int] = {}
    sample: list[int] = []  # of each kind, one graph
    kind = np.zeros(graphs, np.int64)
    starts_of, links_of, wide, long = starts.tobytes(), links.tobytes(), starts.itemsize * 3, links.itemsize * 4
    for g, (i, n, j, k) in enumerate(zip(first.tolist(), size.tolist(), arcs[:-1].tolist(), arcs[1:].tolist(), strict=True)):
        kind[g] = kinds.setdefault((starts_of[i * wide : (i + n) * wide], links_of[j * long : k * long]), len(sample))
        if kind[g] == len(sample):
            sample.append(g)

    chosen = np.array(sample, np.int64)
    begins = np.cumsum(size[chosen]) - size[chosen]
    out = np.empty((int(size[chosen].sum()), 2))
    for n in np.unique(size[chosen][size[chosen] > 0]).tolist():
        same = np.flatnonzero(size[chosen] == n)
        wide = max(1, _PAIRS // (n * n))
        for part in (same[i : i + wide] for i in range(0, len(same), wide)):
            rows_of = first[chosen[part]] + np.arange(n)[:, None]
            x, y, free = starts[rows_of].transpose(2, 0, 1)
            count = arcs[chosen[part] + 1] - arcs[chosen[part]]
            at = np.repeat(arcs[chosen[part]] - np.cumsum(count) + count, count) + np.arange(count.sum())
            a, b = (links[at, i].astype(np.int64) * len(part) + np.repeat(np.arange(len(part)), count) for i in (0, 1))
            with np.errstate(all="ignore"):
                x, y = _moved(x, y, free.astype(bool), a, b, links[at, 2], links[at, 3], o)
            to = begins[part] + np.arange(n)[:, None]
            out[to, 0], out[to, 1] = x, y
    done = out[begins[kind[of_node]] + local]
    return pa.RecordBatch.from_arrays([column(nodes, "key"), column(nodes, "order"), pa.array(done[:, 0]), pa.array(done[:, 1])], names=["key", "id", "x", "y"])


def force_layout(nodes: DataFrame, edges: DataFrame, key: str = "graph_id", options: ForceOptions = ForceOptions()) -> DataFrame:
    """(key, id, x, y) of nodes (key, id, x, y, fixed) and edges (key, source, target, distance, strength)."""
    number = lambda c: F.col(c).cast("double")
    n = nodes.select(F.col(key).alias("key"), F.lit(False).alias("edge"), F.col("id").alias("order"), F.lit(None).cast(nodes.schema["id"].dataType).alias("then"), number("x").alias("first"), number("y").alias("second"), F.col("fixed").cast("boolean").alias("fixed"))
    e = edges.select(F.col(key).alias("key"), F.lit(True).alias("edge"), F.col("source").alias("order"), F.col("target").alias("then"), number("distance").alias("first"), number("strength").alias("second"), F.lit(None).cast("boolean").alias("fixed"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = n.unionByName(e)
    rows = rows.repartition(parts, "key").sortWithinPartitions("key", "edge", "order", "then")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("key", "order")}
    out = rows.mapInArrow(lambda batches: (_simulated(t, options) for t in _cut(batches)), f"key {kinds['key']}, id {kinds['order']}, x double, y double")
    return out.select(F.col("key").cast(nodes.schema[key].dataType).alias(key), F.col("id").cast(nodes.schema["id"].dataType).alias("id"), "x", "y")
