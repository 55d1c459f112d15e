"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import kept

#: So few edges are joined up in one task.
FINISH = 20_000


def _union_find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for b in batches:
        for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True):
            u, v = root(u), root(v)
            parent[max(u, v)] = min(u, v)
    nodes = list(parent)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(root, nodes), pa.int64())], names=["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (u, v, both long); nodes have the same label if a path joins them.

    Each round merges every node into its smallest neighbour, or itself if it is smaller, and goes on with the edges
    between what is left. With ids that are hashes a constant part of the nodes goes in each round. Minima are
    summed up before the shuffle, and the joins are of written tables, so that AQE can split a node with many edges.
    """
    e = kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    maps = []
    while n := e.count():
        if n <= FINISH:
            maps.append(kept(e.coalesce(1).mapInArrow(_union_find, "node long, label long")))
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        label = kept(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
        maps.append(label)
        a = label.select(F.col("node").alias("u"), F.col("label").alias("lu"))
        b = label.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        e = e.join(a, "u").join(b, "v").where("lu <> lv")
        e = kept(e.select(F.greatest("lu", "lv").alias("u"), F.least("lu", "lv").alias("v")).distinct())
    if not maps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out = maps[0]
    for m in maps[1:]:
        m = m.select(F.col("node").alias("label"), F.col("label").alias("next"))
        out = out.join(m, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return kept(out)
