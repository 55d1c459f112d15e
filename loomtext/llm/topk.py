"""Exact top-k inner products: ball trees over shards, branch and bound.

Queries are written to the shared folder in blocks, each with a floor: the k-th best score within a bounded sample of
all vectors, which no k-th best score overall is below. A task reads its vectors in shards and builds a ball tree over
each. For every block each query takes the leaves in descending order of their bound, one, two, four and so on at a
time, until the bound falls below its current k-th score; the queries that take a leaf in one turn meet it in one matrix
product. That score starts at the floor and is shared by all shards of the task. Tasks report what reaches it, so few
rows go on, and the best k of each query are taken from them. Work is the stated query set against all rows, in blocks.

A node's bound is the smaller of two: query times centre plus length of the query times radius; and, with the rows
split into their part along the centre's direction and the rest, the best part along times the query's own plus the
length of the query's rest times that of the longest rest. Neither is above that of the nodes over it.

A task holds HELD bytes of vectors at a time, whatever its partition; whole numbers are kept in single precision while
that is exact.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do rows with a null
id; shorter vectors count as filled up with zeros; candidates with the query's own vec_id are its own row; equal ids
otherwise count as rows of their own, and a query that occurs twice is answered for each; scores beyond a long are
given as the largest or smallest long; with fewer candidates all are returned; other columns are ignored.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import freeing
from loomtext.llm.files import read_file, write_file
from loomtext.session import stored, workspace

SHARD, LEAF, BLOCK, SAMPLE, HELD, MEANS = 16_384, 64, 2048, 2048, 128 << 20, 8
_MAX, _MIN = (1 << 63) - 1, -(1 << 63)


def quantized(ids: pa.ChunkedArray | pa.Array, vectors: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows floor(256 * x) of the vectors that take part, as whole doubles."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], vectors.type)
    n = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), np.int64)
    values = np.asarray(vectors.flatten().cast(pa.float64()), float)  # null as NaN
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * 256)
    row = np.repeat(np.arange(len(n)), n)
    bad = np.bincount(row[~np.isfinite(values)], minlength=len(n)) > 0
    good = ~bad & np.asarray(pc.is_valid(vectors)) & np.asarray(pc.is_valid(ids))
    out = np.zeros((int(good.sum()), int(n[good].max(initial=0))))
    use = good[row]
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    out[(np.cumsum(good) - 1)[row[use]], place[use]] = values[use]
    return np.asarray(ids.filter(pa.array(good)), np.int64), out


def widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def scores(q: np.ndarray, x: np.ndarray, peak: float | None = None):
    """Exact integer products of rows of whole numbers: in single or double precision if that holds all sums, else in
    Python's integers. peak is the largest product of two components, if known."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)))
    if peak is None:
        peak = float(np.abs(q).max()) * float(np.abs(x).max())
    if peak * q.shape[1] < 2.0**24:
        return q.astype(np.float32) @ x.astype(np.float32, copy=False).T
    if peak * q.shape[1] < 2.0**53:
        return q @ x.T.astype(np.float64, copy=False)
    whole = lambda a: np.array([[int(v) for v in r] for r in a], object).reshape(a.shape)
    return whole(q) @ whole(x).T


class BallTree:
    """Nodes part their rows by the nearer of two means, from two far points on; bounds hold for all rows below a node."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order, self.leaves, nodes, self.paths = np.arange(len(x)), [], [], []
        stack: list[tuple[int, int, list[int]]] = [(0, len(x), [])] if len(x) else []
        while stack:
            a, b, path = stack.pop()
            rows = x[order[a:b]]
            centre = rows.mean(0)
            away = np.sqrt(((rows - centre) ** 2).sum(1))
            path = [*path, len(nodes)]
            size = np.sqrt(centre @ centre)
            along = rows @ (centre / size) if size > 0 else np.zeros(len(rows))
            rest = np.sqrt(np.maximum(0, (rows * rows).sum(1) - along * along))
            nodes.append((centre, away.max(), size, along.min(), along.max(), rest.max()))
            if b - a <= LEAF or away.max() == 0:
                # Rows that are all alike cannot be halved; they are one leaf, cut in parts.
                for s in range(a, b, LEAF):
                    self.leaves.append((s, min(b, s + LEAF)))
                    self.paths.append(path)
                continue
            p = rows[away.argmax()]
            q = rows[((rows - p) ** 2).sum(1).argmax()]
            for _ in range(MEANS):
                side = rows @ (q - p) > (q @ q - p @ p) / 2
                if side.all() or not side.any():
                    break
                p, q = rows[~side].mean(0), rows[side].mean(0)
            along = rows @ (q - p) - (q @ q - p @ p) / 2
            order[a:b] = order[a:b][np.argsort(along, kind="stable")]
            mid = a + int((along <= 0).sum())
            if min(mid - a, b - mid) < (b - a) // 16:  # keeps the tree's depth a logarithm
                mid = (a + b) // 2
            stack += [(a, mid, path), (mid, b, path)]
        self.ids, self.peak = ids[order], float(np.abs(x).max(initial=0))
        self.x = x[order].astype(np.float32 if self.peak < 2.0**24 else np.float64)
        self.centres = np.array([n[0] for n in nodes])
        self.radii, self.size, self.low, self.high, self.rest = (np.array([n[i] for n in nodes]) for i in range(1, 6))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and leaf, what no score below the leaf exceeds; a little above for rounding."""
        length, inner = np.sqrt((q * q).sum(1)), q @ self.centres.T
        node = inner + length[:, None] * self.radii
        own = inner / np.where(self.size > 0, self.size, 1)
        split = np.maximum(own * self.low, own * self.high) + np.sqrt(np.maximum(0, (length**2)[:, None] - own**2)) * self.rest
        slack = 1e-9 * length[:, None] * (self.size + self.radii + self.rest + np.abs(self.low) + np.abs(self.high)) + 1e-6
        # The rest of a query along a centre loses half of its digits at most.
        node = np.minimum(node, split + 1e-6 * length[:, None] * self.rest) + slack
        out = np.empty((len(q), len(self.paths)))
        for i, p in enumerate(self.paths):
            out[:, i] = node[:, p].min(1)
        return out


class Best:
    """The best k (score, smaller id first) of each query of a block so far, and `reach`, below which no row counts."""

    def __init__(self, k: int, ids: np.ndarray, floors: np.ndarray):
        self.k, self.ids, self.heaps, self.reach = k, ids.tolist(), [[] for _ in ids], floors.copy()

    def offer(self, query: int, score, vec_id: int) -> None:
        heap, entry = self.heaps[query], (score, -vec_id)
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        else:
            return
        if len(heap) == self.k:
            # Doubles below 2**53 are exact; a larger score's is surely low enough.
            low = float(heap[0][0])
            self.reach[query] = max(self.reach[query], low if abs(low) < 2.0**53 else np.nextafter(low, -np.inf))


def search(tree: BallTree, q: np.ndarray, best: Best) -> int:
    """Offers what the tree has for a block of queries; returns how many products were computed."""
    if not tree.leaves:
        return 0
    width = max(q.shape[1], tree.x.shape[1])
    q = widened(q, width)
    if tree.x.shape[1] < width:
        tree.x, tree.centres = widened(tree.x, width), widened(tree.centres, width)
    peak = float(np.abs(q).max(initial=0)) * tree.peak
    bound = tree.bounds(q)
    order = np.argsort(-bound, axis=1)
    at, turn, computed = 0, 1, 0
    while at < len(tree.leaves):
        part = order[:, at : at + turn]
        query, place = np.nonzero(np.take_along_axis(bound, part, 1) >= best.reach[:, None])
        if not len(query):
            break  # bounds only fall from here on
        leaf = part[query, place]
        sort = np.argsort(leaf, kind="stable")
        leaf, query = leaf[sort], query[sort]
        cuts = np.flatnonzero(np.diff(leaf, prepend=-1)).tolist()
        for a, z in zip(cuts, [*cuts[1:], len(leaf)], strict=True):
            s, e = tree.leaves[leaf[a]]
            rows = query[a:z]
            rows = rows[bound[rows, leaf[a]] >= best.reach[rows]]
            got = scores(q[rows], tree.x[s:e], peak)
            computed += got.size
            for i, j in zip(*(x.tolist() for x in np.nonzero(got >= best.reach[rows][:, None])), strict=True):
                n, vec_id = int(rows[i]), int(tree.ids[s + j])
                if vec_id != best.ids[n]:
                    best.offer(n, got[i, j], vec_id)
        at += turn
        turn *= 2
    return computed


def _save(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows for each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where("vec_id is not null and vector is not null")
    folder = workspace(spark, "queries")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # SAMPLE rows at most
    s_ids, s_x = quantized(pa.array([r.vec_id for r in sample], pa.int64()), pa.array([list(r.vector) for r in sample], pa.list_(pa.float64())))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch | None:
            nonlocal n, held
            t = pa.Table.from_batches(held)
            held = []
            ids, q = quantized(t["vec_id"], t["vector"])
            if not len(ids):
                return None
            width = max(q.shape[1], s_x.shape[1])
            got = scores(widened(q, width), widened(s_x, width))
            if got.dtype == object:  # floats of integers beyond 2**53, surely low enough
                got = np.nextafter(got.astype(float), -np.inf)
            got = np.where(s_ids[None, :] == ids[:, None], -np.inf, got)
            floors = -np.partition(-got, k - 1, axis=1)[:, k - 1] if len(s_ids) >= k else np.full(len(ids), -np.inf)
            path = f"{folder}/block-{part:06d}-{n:06d}"
            write_file(path, _save(ids=ids, q=q, floors=floors))
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

        size = 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                held.append(b.slice(at, BLOCK))
                size += held[-1].num_rows
                if size >= BLOCK:
                    size = 0
                    if (out := flush()) is not None:
                        yield out
        if held and (out := flush()) is not None:
            yield out

    queries = rows.where(F.col("vec_id") % every == 0)
    paths = [r.path for r in stored(queries.mapInArrow(freeing(write), "path string"), "query-blocks").orderBy("path").collect()]  # one for BLOCK queries

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # HELD bytes of trees stay in memory, and one block of queries at a time.
        trees, held, size = [], [], 0

        def build() -> None:
            nonlocal held, size
            t = pa.Table.from_batches(held)
            held, size = [], 0
            trees.append(BallTree(*quantized(t["vec_id"], t["vector"])))

        def answers() -> Iterator[pa.RecordBatch]:
            for p in paths if trees else ():
                f = np.load(io.BytesIO(read_file(p)))
                best = Best(k, f["ids"], f["floors"])
                for tree in trees:
                    search(tree, f["q"], best)
                out = [(p, n, i, -e[1], str(int(e[0]))) for n, (i, heap) in enumerate(zip(best.ids, best.heaps, strict=True)) for e in heap]
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield from pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["block", "number", "query_id", "vec_id", "exact"]).to_batches(max_chunksize=50_000)
            trees.clear()

        for b in batches:
            for at in range(0, b.num_rows, SHARD):
                held.append(b.slice(at, SHARD))
                size += held[-1].num_rows
                if size >= SHARD:
                    build()
                    if sum(t.x.nbytes for t in trees) >= HELD:
                        yield from answers()
        if held:
            build()
        yield from answers()

    found = rows.mapInArrow(freeing(scan), "block string, number int, query_id long, vec_id long, exact string")
    # Scores of any size in order: as decimals of 38 digits, which hold products far beyond a long.
    found = found.withColumn("order", F.expr("try_cast(exact as decimal(38, 0))"))
    order = Window.partitionBy("block", "number").orderBy(F.coalesce(F.col("order").cast("double"), F.expr("try_cast(exact as double)")).desc(), F.col("order").desc_nulls_last(), "vec_id")
    score = F.coalesce(F.expr("try_cast(exact as bigint)"), F.when(F.col("exact").startswith("-"), F.lit(_MIN)).otherwise(F.lit(_MAX)))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", score.cast("long").alias("score"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
