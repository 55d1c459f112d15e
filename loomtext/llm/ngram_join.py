"""Jaccard self-join of word n-gram sets through R-trees over count vectors.

A document's set holds 64-bit hashes of its distinct shingles. Equal sets are one class, with a hash of the set as
its key. Points are classes: the shingles fall by their upper bits into groups, and the counts by group are the
coordinates. The overlap of two sets is at most the sum of the smaller of each coordinate, and so a tree node whose
largest coordinates give less than a link needs is left out. What survives is verified on the sets themselves.

Such trees prune little among unrelated documents of like sizes, so they are built within clusters that provably
hold all links. For a range of sizes, two linked sets differ by at most d shingles, so of d + 1 + spare groups more
than `spare` hold the same shingles in both. A class sends a signature of the content of each group; classes that
share a signature of one range of sizes fall in one cluster of that range, and links lie within clusters. Two kinds
of groups would tie unrelated classes together, and both can be left out without loss:

* Shingles that are frequent in a bounded sample are left out before grouping. Sets that differ by d shingles differ
  by at most d without them, whichever they are.
* Empty groups send no signature. If a class has more than `spare` of them, all groups that it shares with another
  one may be empty in both; such a class sends the signatures of the fullest groups of its whole set besides, empty
  ones among them if there are again more than `spare`. A class with fewer shares a full group with whatever links to it.

Copies of one text are one class, sent once by a task; classes of a task that share a signature are tied there, and one
of them goes on, so a signature that very many share comes once from each task.

Of the groups as many are left out as are spare, the emptiest first: equal groups are left out in both sets, so the
fullest of those that two linked sets share is left. Groups of a single shingle tie unrelated classes by chance, and in
a larger table more of them, so clusters of more than FINER classes are cut up: linked classes share a signature
whatever the groups are, so they do by other groups, within their cluster, without what is frequent there.

Clusters above TILE classes or TILE_BYTES of shingles are then cut into tiles of two blocks each, so no task holds a
whole cluster; the tiles are dealt out in rounds of ROUND bytes, so disk does not grow with their number. A tile
reports a spanning forest of its links; only pairs that it has not yet joined are verified, so a group of m copies
costs about m verifications, not m squared. No link between two classes goes unseen.

Defined results: null and empty texts and texts without words have no shingles, n_shingles 0, and stand alone
(component_id is their own doc_id); repeated rows and texts with equal sets are linked; null doc_ids are never a
component's name unless all of its members have null; other columns, whatever their names, are ignored by `linked` and
kept by `one_of_each`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import column_bytes, freeing, mix64, packed, text_chunks, unpacked, word_hashes
from loomtext.llm.graph import components
from loomtext.llm.kneser_ney import SENT_DDL, by_bucket, counted, gathered, sent_batch, split_rows, word_bucket
from loomtext.session import kept, stored, stores_removed

SPARE, SPARE_SHARE, TILE, DIMENSIONS, FANOUT = 3, 0.1, 1024, 64, 16
#: Distinct texts whose shingles are counted for the frequent ones, the count from which they are, and how many there are at most.
SAMPLE, FREQUENT, MOST = 16_000, 4, 1 << 17
#: Bits for each candidate class in the filter of them, and its bits at most (32 MB); a class that is none passes it by chance alone.
FILTER_EACH, FILTER_BITS = 16, 1 << 28
GATHER, TILE_BYTES = 8 << 20, 16 << 20
#: Clusters of several tiles whose numbers are broadcast at most, and partitions of the verification at most.
LARGE, TASKS = 200_000, 100_000
#: Clusters of more classes are cut up by further groups, in so many turns at most.
FINER, TURNS = 128, 3
#: Bytes of sets that the tiles of large clusters may have in one round of the verification, or as many as all sets have.
ROUND = 1 << 30
#: Classes that a task remembers to have sent.
SEEN = 1 << 20
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Similarity:
    """Links are pairs of sets with den * intersection >= num * union, over shingles of `words` words."""

    words: int = 4
    num: int = 85
    den: int = 100

    def need(self, sizes):
        """The least overlap of linked sets whose sizes sum to `sizes`."""
        return -(-self.num * sizes // (self.den + self.num))

    def bands(self, top: int) -> np.ndarray:
        """First sizes of the bands: linked sets are in the same band or in neighbours."""
        out = [1]
        while out[-1] <= top:
            out.append(out[-1] * self.den // self.num + 1)
        return np.array(out, np.int64)


def shingle_sets(col: pa.ChunkedArray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, offsets = word_hashes(*column_bytes(col))
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        rolled = h[: max(0, len(h) - words + 1)].copy()
        for j in range(1, words):
            rolled = mix64(rolled * _STEP + h[j : j + len(rolled)])
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif b > a:
                one = h[a : a + 1] + np.uint64(b - a)
                for j in range(a + 1, b):
                    one = mix64(one * _STEP + h[j])
                out.append(one)
            else:
                out.append(h[:0])
    return out


def set_key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def ranges(n: int, bands: np.ndarray, sim: Similarity) -> list[tuple[int, int]]:
    """The two ranges of sizes that a set of n shingles belongs to, and by how many shingles linked sets there differ at most; ranges of equal sets alone are left out."""
    band, out = int(np.searchsorted(bands, n, side="right")) - 1, []
    for tag in (band, band + 1):
        largest = int(bands[tag] * sim.den // sim.num) if tag + 1 >= len(bands) else int(bands[tag + 1]) - 1
        differ = 2 * largest - 2 * int(sim.need(2 * largest)) + 1
        if differ > 0:
            out.append((tag, differ))
    return out


def node(key: int, tag: int) -> int:
    """The number of a class in a range of sizes."""
    x = mix64(np.array([key], np.int64).view(np.uint64) ^ mix64(np.array([tag + 1], np.uint64)))
    return int(x.view(np.int64)[0])


def group_contents(s: np.ndarray, groups: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """A signature of the content of each group of a set, and how many shingles the group holds."""
    at = np.searchsorted(s, (np.arange(1, groups, dtype=np.float64) * (2.0**64 / groups)).astype(np.uint64))
    at = np.concatenate([[0], at, [len(s)]])
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(s))])
        sig = mix64(sums[at[1:]] - sums[at[:-1]] + mix64(np.arange(groups, dtype=np.uint64) + np.uint64(salt << 32)))
    return sig, at[1:] - at[:-1]


def fullest(sig: np.ndarray, held: np.ndarray, n: int) -> np.ndarray:
    """The n groups that hold most shingles, in an order that only their content decides."""
    return np.lexsort((sig, held))[len(sig) - n :]


def without(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    return s[frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] != s] if len(frequent) else s


def in_range(s: np.ndarray, rest: np.ndarray, tag: int, differ: int) -> np.ndarray:
    """Signatures of a set in a range of sizes; rest: the set without frequent shingles."""
    groups = differ + 1 + SPARE + int(SPARE_SHARE * (differ + 1))
    sig, held = group_contents(rest, groups, 2 * tag)
    top = fullest(sig, held, differ + 1)
    out = sig[top[held[top] > 0]]
    if len(out) <= differ:
        sig, held = group_contents(s, groups, 2 * tag + 1)
        out = np.concatenate([out, sig[fullest(sig, held, differ + 1)]])
    return out


def signatures(keys: list[int], sets: list[np.ndarray], sim: Similarity, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets (none empty), and the node that each is of."""
    bands = sim.bands(max(map(len, sets), default=1))
    sigs, nodes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for key, s in zip(keys, sets, strict=True):
        rest = without(s, frequent)
        for tag, differ in ranges(len(s), bands, sim):
            sigs.append(in_range(s, rest, tag, differ))
            nodes.append(np.full(len(sigs[-1]), node(key, tag), np.int64))
    return np.concatenate(sigs), np.concatenate(nodes)


def finer_signatures(rows: list[tuple[int, int, int, np.ndarray]], sim: Similarity, frequent: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures that only nodes of one cluster share, by other groups in each turn, and the node that each is of. rows: label, node, key and set."""
    bands = sim.bands(max((len(s) for *_, s in rows), default=1))
    salt = mix64(np.array([turn], np.uint64))
    sigs, nodes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for label, own, key, s in rows:
        rest, whole = (np.sort(mix64(x ^ salt)) for x in (without(s, frequent), s))
        for tag, differ in ranges(len(s), bands, sim):
            if node(key, tag) == own:
                sigs.append(mix64(in_range(whole, rest, tag, differ) ^ mix64(np.array([label], np.int64).view(np.uint64))))
                nodes.append(np.full(len(sigs[-1]), own, np.int64))
    return np.concatenate(sigs), np.concatenate(nodes)


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node that edges (a, b) join each to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            return label
        label = new


class RTree:
    """Bulk-loaded over count vectors sorted by size; a node has the largest of each coordinate, and its range of sizes."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray):
        self.levels = [(counts, sizes, sizes)]
        while len(self.levels[-1][1]) > FANOUT:
            c, lo, hi = self.levels[-1]
            cut = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.maximum.reduceat(c, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)))

    def search(self, size: int, counts: np.ndarray, sim: Similarity) -> np.ndarray:
        """Entries whose bound on the overlap reaches what a link needs."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            c, lo, hi = self.levels[depth]
            at = at[(sim.den * np.minimum(hi[at], size) >= sim.num * np.maximum(lo[at], size))]
            at = at[np.minimum(c[at], counts).sum(1) >= sim.need(lo[at] + size)]
            if depth:
                below = len(self.levels[depth - 1][1])
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < below]
        return at


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def forest(sets: list[np.ndarray], block: np.ndarray, sim: Similarity) -> list[tuple[int, int]]:
    """Links that join what the links between different blocks (or any, if there is one block) join."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(sizes, kind="stable")
    sizes, block = sizes[order], block[order]
    flat = np.concatenate([np.full(len(sets[o]), i) for i, o in enumerate(order)])
    group = (np.concatenate([sets[o] for o in order]) >> np.uint64(58)).astype(np.int64)
    counts = np.bincount(flat * DIMENSIONS + group, minlength=len(sets) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.int32)
    tree, one = RTree(sizes, counts), bool((block == block[0]).all())
    comp, out = np.arange(len(sets)), []
    for i in range(len(sets)):
        near = tree.search(int(sizes[i]), counts[i], sim)
        near = near[near > i]
        if not one:
            near = near[block[near] != block[i]]
        for j in near.tolist():
            if comp[j] != comp[i] and overlap(sets[order[i]], sets[order[j]]) >= sim.need(int(sizes[i] + sizes[j])):
                comp[comp == comp[j]] = comp[i]
                out.append((int(order[i]), int(order[j])))
    return out


def profiles(docs: DataFrame, sim: Similarity) -> DataFrame:
    """doc_id, n_shingles and the key of the set of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_chunks(batches):
            sets = shingle_sets(t["text"], sim.words)
            yield from pa.table({"doc_id": t["doc_id"], "n_shingles": pa.array(map(len, sets), pa.int64()), "key": pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())}).to_batches()

    return docs.select("doc_id", "text").mapInArrow(freeing(run), "doc_id long, n_shingles long, key long")


def most_frequent(sample: DataFrame, sets_of: Callable[[pa.RecordBatch], Iterator[list[np.ndarray]]]) -> np.ndarray:
    """Shingles that FREQUENT or more of the sets of the sample have, sorted; the MOST most frequent at most.

    Which ones does not change what is found, only how much is compared."""
    buckets = 16

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in sets_of(batches):
            w, c = counted(np.concatenate(sets))
            yield sent_batch(list(split_rows("shingle", w, [c], word_bucket(w >> np.uint64(32), buckets), 8)))

    def most(key: tuple, t: pa.Table) -> pa.Table:
        w, c = gathered(t, "shingle", 1, 8)
        w, c = w[c >= FREQUENT], c[c >= FREQUENT]
        return pa.table({"shingles": pa.array([w[np.argsort(-c, kind="stable")[: MOST // buckets]].tobytes()], pa.binary())})

    found = sample.mapInArrow(freeing(count), SENT_DDL).groupBy("bucket").applyInArrow(freeing(most), "shingles binary").collect()  # MOST longs in all
    return np.sort(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r.shingles, np.uint64) for r in found)]))


def frequent_shingles(docs: DataFrame, sim: Similarity) -> np.ndarray:
    """Those of about SAMPLE distinct texts."""
    every = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").distinct()
    return most_frequent(sample, lambda batches: (shingle_sets(t["text"], sim.words) for t in text_chunks(batches, "text", 8 << 20)))


def signature_rows(sig: np.ndarray, owner: np.ndarray, n: int) -> pa.RecordBatch:
    """Signatures and the nodes that they are of, by bucket; nodes that share one are tied here."""
    order = np.argsort(sig, kind="stable")
    sig, owner = sig[order], owner[order]
    start = np.concatenate([[True], sig[1:] != sig[:-1]])[: len(sig)]
    bucket = (sig >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)  # ranges, so sorted signatures are sorted by bucket
    # One class goes on for each signature; the others are tied to it here.
    first = owner[np.flatnonzero(start)[np.cumsum(start) - 1]] if len(sig) else owner
    tied = ~start & (owner != first)
    ties, ties_at = np.stack([owner[tied], first[tied]], 1), np.searchsorted(bucket[tied], np.arange(n + 1, dtype=np.uint64))
    sig, owner, bucket = sig[start], owner[start], bucket[start]
    cut = np.searchsorted(bucket, np.arange(n + 1, dtype=np.uint64))
    rows = [(b, packed(sig[i:j]), owner[i:j].tobytes(), ties[ties_at[b] : ties_at[b + 1]].tobytes()) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "signatures", "keys", "ties"])


def sharing(sent: DataFrame, n: int) -> DataFrame:
    """(node, label) of the nodes that shared signatures join, from signature_rows in n buckets."""

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        sig = np.concatenate([unpacked(x) for x in t["signatures"].to_pylist()])
        owner = np.concatenate([np.frombuffer(x, np.int64) for x in t["keys"].to_pylist()])
        ties = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in t["ties"].to_pylist()])
        order = np.argsort(sig, kind="stable")
        sig, owner = sig[order], owner[order]
        start = np.concatenate([[True], sig[1:] != sig[:-1]])
        first = owner[np.flatnonzero(start)[np.cumsum(start) - 1]]
        u, v = np.concatenate([owner[~start], ties[:, 0]]), np.concatenate([first[~start], ties[:, 1]])
        nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = nodes[joined(index[: len(u)], index[len(u) :], len(nodes))] if len(nodes) else nodes
        more = label != nodes
        return pa.table({"u": pa.array(nodes[more], pa.int64()), "v": pa.array(label[more], pa.int64())})

    return components(by_bucket(sent, n).applyInArrow(freeing(meet), "u long, v long"))


SENT_SIGNATURES = "bucket int, signatures binary, keys binary, ties binary"


def clusters(docs: DataFrame, sim: Similarity) -> DataFrame:
    """(node, label) of the classes in ranges of sizes that share a signature with another one."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(48, -(-size // GATHER))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, sim))

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = {}, 0, set()
        for t in text_chunks(batches):
            for s in shingle_sets(t["text"], sim.words):
                if len(s) and (k := set_key(s)) not in seen:
                    held[k] = s
                    if len(seen) < SEEN:
                        seen.add(k)
            size += t["text"].nbytes
            if size >= GATHER:
                yield signature_rows(*signatures(list(held), list(held.values()), sim, frequent.value), n)
                held, size = {}, 0
        if held:
            yield signature_rows(*signatures(list(held), list(held.values()), sim, frequent.value), n)

    return sharing(docs.select("text").mapInArrow(freeing(send), SENT_SIGNATURES), n)


def set_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    return text_chunks(batches, "members", GATHER)


def finer(sets: DataFrame, sim: Similarity, turn: int) -> DataFrame:
    """(node, label) of the nodes of sets (label, node, key, members) that share a signature of the turn with another one of their cluster."""
    total = sets.agg(F.count("*").alias("n"), F.sum(F.octet_length("members")).alias("bytes")).first()
    n = max(48, -(-(total.bytes or 0) // GATHER))
    sample = sets.where(F.pmod(F.xxhash64("node"), F.lit(max(1, total.n // SAMPLE))) == 0).select("members")
    found = most_frequent(sample, lambda batches: ([np.frombuffer(x, np.uint64) for x in t["members"].to_pylist()] for t in set_chunks(batches)))
    frequent = sets.sparkSession.sparkContext.broadcast(found)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in set_chunks(batches):
            rows = [(*x, np.frombuffer(m, np.uint64)) for *x, m in zip(*(t[c].to_pylist() for c in ("label", "node", "key", "members")), strict=True)]
            yield signature_rows(*finer_signatures(rows, sim, frequent.value, turn), n)

    return sharing(sets.select("label", "node", "key", "members").mapInArrow(freeing(send), SENT_SIGNATURES), n)


def cut_finer(sets: DataFrame, sim: Similarity) -> DataFrame:
    """sets (label, node, key, members) with clusters of more than FINER classes cut up by the signatures of further turns; classes that are then alone go."""
    done = []
    for turn in range(1, TURNS + 1):
        big = kept(sets.groupBy("label").count().where(F.col("count") > FINER).select("label"))
        count = big.count()
        if not count:
            break
        big = F.broadcast(big) if count <= LARGE else big
        done.append(sets.join(big, "label", "left_anti"))
        part = sets.join(big, "label", "left_semi")
        # A label is the smallest node of its component; it may be missing among the nodes.
        parts = finer(part, sim, turn)
        parts = kept(parts.unionByName(parts.select(F.col("label").alias("node"), "label")).distinct())
        sets = stored(part.drop("label").join(parts, "node").select("label", "node", "key", "members"), f"class-sets-{turn}")
    for d in done:
        sets = sets.unionByName(d.select("label", "node", "key", "members"))
    return sets


def filter_place(nodes: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each node, by its upper bits: nodes are hashes themselves."""
    return nodes.view(np.uint64) >> np.uint64(64 - bits)


def class_filter(nodes: DataFrame, total: int) -> np.ndarray:
    """A bit set of the nodes, as bytes: what is in nodes is in it. It grows with their number, up to FILTER_BITS."""
    bits = min(max(12, (max(1, total) * FILTER_EACH - 1).bit_length()), FILTER_BITS.bit_length() - 1)
    parts = 1 << max(0, bits - 18)  # 32 KB each

    def build(key: tuple, t: pa.Table) -> pa.Table:
        part = np.zeros(1 << bits >> parts.bit_length() - 1, bool)
        part[filter_place(t["node"].to_numpy(), bits) & np.uint64(len(part) - 1)] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([np.packbits(part).tobytes()], pa.binary())})

    part = F.shiftrightunsigned("node", 64 - (parts.bit_length() - 1)).cast("int") if parts > 1 else F.lit(0)
    out = np.zeros((parts, (1 << bits) // parts // 8), np.uint8)
    for r in nodes.select(part.alias("part"), "node").groupBy("part").applyInArrow(build, "part int, data binary").toLocalIterator():  # FILTER_BITS at most
        out[r.part] = np.frombuffer(r.data, np.uint8)
    return out.ravel()


def class_sets(docs: DataFrame, nodes: DataFrame, total: int, sim: Similarity) -> DataFrame:
    """(node, key, members): the sets of the classes in nodes (node), which are `total`, and few others."""
    bits = docs.sparkSession.sparkContext.broadcast(class_filter(nodes, total))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = bits.value, set()
        size = (len(table) * 8).bit_length() - 1
        for t in text_chunks(batches):
            found = {}
            sets = shingle_sets(t["text"], sim.words)
            bands = sim.bands(max(map(len, sets), default=1))
            for s in sets:
                if not len(s) or (k := set_key(s)) in seen:
                    continue
                own = np.array([node(k, tag) for tag, _ in ranges(len(s), bands, sim)], np.int64)
                at = filter_place(own, size)
                hit = table[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1
                found |= {x: (k, s) for x in own[hit > 0].tolist()}
                if len(seen) < SEEN:
                    seen.add(k)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([k for k, _ in found.values()], pa.int64()), pa.array([s.tobytes() for _, s in found.values()], pa.binary())], names=["node", "key", "members"])

    return docs.select("text").mapInArrow(freeing(run), "node long, key long, members binary").dropDuplicates(["node"])


def links(docs: DataFrame, sim: Similarity) -> DataFrame:
    """(u, v): pairs of keys of linked classes; they join all that links join."""
    cl = clusters(docs, sim)
    # The smallest node of a cluster labels it; it may be missing among the nodes.
    keys = kept(cl.select("node", "label").unionByName(cl.select(F.col("label").alias("node"), "label").distinct()).distinct())
    sets = stored(class_sets(docs, keys, keys.count(), sim).join(keys, "node").select("label", "node", "key", "members"), "class-sets")
    sets = cut_finer(sets, sim)
    blocks = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum(F.octet_length("members")) / TILE_BYTES)).cast("int")
    sizes = kept(sets.groupBy("label").agg(blocks.alias("blocks"), F.sum(F.octet_length("members")).alias("bytes")).where(F.col("blocks") > 1))
    large = sizes.agg(F.count("*").alias("n"), F.sum(F.col("blocks").cast("long") * (F.col("blocks") + 1) / 2).cast("long").alias("tiles"), F.sum(F.col("blocks") * F.col("bytes")).alias("bytes")).first()
    total = sets.agg(F.count("*").alias("n"), F.sum(F.octet_length("members")).alias("bytes")).first()
    groups = max(1, total.n // 500, (total.bytes or 0) // TILE_BYTES)
    rows = sets.join(F.broadcast(sizes) if large.n <= LARGE else sizes, "label", "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(groups))).otherwise(F.xxhash64("label", "i", "j"))

    def verify(t: pa.Table) -> pa.Table:
        tiles: dict[tuple, dict[int, tuple[int, bytes]]] = {}
        for r in zip(*(t[c].to_pylist() for c in ("label", "i", "j", "block", "key", "members")), strict=True):
            tiles.setdefault(r[:3], {})[r[4]] = r[3], r[5]
        out: list[tuple[int, int]] = []
        for members in tiles.values():
            nodes = list(members)
            sets = [np.frombuffer(s, np.uint64) for _, s in members.values()]
            if len(nodes) > 1:
                out += [(nodes[a], nodes[b]) for a, b in forest(sets, np.array([b for b, _ in members.values()]), sim)]
        return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})

    # A class goes to as many tiles as its cluster has blocks: they are dealt out in rounds, and each leaves no shuffle files.
    rounds = max(1, -(-(large.bytes or 0) // max(ROUND, total.bytes or 0)))
    rows = rows.select(task.alias("task"), "label", "i", "j", "block", "key", "members")
    tasks = max(1, min(groups + (large.tiles or 0) // rounds, TASKS))
    out = []
    for k in range(rounds):
        dealt = rows.where(F.pmod("task", F.lit(rounds)) == k) if rounds > 1 else rows
        out.append(kept(dealt.repartition(tasks, "task").groupBy("task").applyInArrow(freeing(verify), "u long, v long")))
    return reduce(DataFrame.unionByName, out)


def _with_labels(docs: DataFrame, sim: Similarity) -> tuple[DataFrame, DataFrame]:
    p = stored(profiles(docs, sim), "profiles")
    with stores_removed(docs.sparkSession):
        found = links(docs, sim)
    c = components(found).select(F.col("node").alias("key"), "label")
    return p.join(c, "key", "left").withColumn("label", F.coalesce("label", "key")), c


def linked(docs: DataFrame, sim: Similarity = Similarity(), *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """For each document doc_id, n_shingles, component_id (the smallest doc_id that links reach) and class_id (of equal sets)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    p, _ = _with_labels(rows, sim)
    p = stored(p, "labels")
    least = kept(p.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")))
    return p.join(least, "label", "left").select("doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), F.col("key").alias("class_id"))


def one_of_each(docs: DataFrame, sim: Similarity, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without those that a link path joins to one with a smaller doc_id (null last; then by the key of the set); of rows alike in both, one stays. Texts without words all stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at, id_at = names[docs.columns.index(text)], names[docs.columns.index(doc_id)]
    inner = docs.toDF(*names)
    p, _ = _with_labels(inner.select(F.col(id_at).cast("long").alias("doc_id"), F.col(at).alias("text")), sim)
    best = p.where("key is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("b"))
    best = kept(best.select(F.col("b.key").alias("_key"), F.col("b.doc_id").alias("_id")))
    schema = T.StructType([*inner.schema.fields, T.StructField("_set", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_chunks(batches, at):
            keys = [set_key(s) if len(s) else None for s in shingle_sets(t[at], sim.words)]
            yield from t.append_column("_set", pa.array(keys, pa.int64())).to_batches()

    own = inner.mapInArrow(freeing(run), schema)
    stay = own.join(best, (own["_set"] == best["_key"]) & own[id_at].cast("long").eqNullSafe(best["_id"]), "left_semi")
    return stay.dropDuplicates(["_set", id_at]).unionByName(own.where("_set is null")).drop("_set").toDF(*docs.columns)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
"""
