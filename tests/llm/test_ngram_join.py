"""The join against all pairs."""

import random
import re

import numpy as np
import pytest

from loomtext.llm import ngram_join as nj
from loomtext.llm.graph import components


def shingles(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute(rows, sim):
    sets = [shingles(t, sim.words) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and sim.den * len(sets[i] & sets[j]) >= sim.num * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {}
    for (d, _), c in zip(rows, comp):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return sorted(((d, len(s), least.get(c)) for (d, _), s, c in zip(rows, sets, comp)), key=repr)


def corpus(seed, n=160):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    base = [[r.choice(vocab) for _ in range(r.choice([1, 2, 3, 4, 5, 7, 9, 12, 20, 40, 90, 200]))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            if w:
                k = r.randrange(len(w))
                r.choice([lambda: w.__setitem__(k, r.choice(vocab)), lambda: w.pop(k), lambda: w.insert(k, r.choice(vocab))])()
        rows.append((i, " ".join(w)))
    return rows


EDGE = [(900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a  B"), (None, "a b"), (None, "lone words here now"), (905, "same id"), (905, "other text"), (906, "x " * 20000), (907, "x " * 20000 + "y")]


@pytest.mark.parametrize(("seed", "sim"), [(1, nj.Similarity()), (2, nj.Similarity(5, 80, 100)), (3, nj.Similarity())])
def test_components_equal_all_pairs(spark, seed, sim, monkeypatch):
    monkeypatch.setattr(nj, "TILE", 7 if seed == 3 else nj.TILE)
    monkeypatch.setattr(nj, "FREQUENT", 9 if seed == 1 else nj.FREQUENT)
    rows = corpus(seed) + EDGE
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, key int, label string").repartition(3)
    got = nj.linked(df, sim).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, sim)


def test_one_of_each(spark):
    sim = nj.Similarity(5, 80, 100)
    rows = corpus(4, 80) + EDGE + [(0, "again"), (0, "again")]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, _n int")
    out = nj.one_of_each(df, sim)
    assert out.columns == df.columns
    stay = out.collect()
    with_words = [r for r in stay if shingles(r.text, 5)]
    sets = [shingles(r.text, 5) for r in with_words]
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    labels = {(d, c) for d, n, c in brute(rows, sim) if n and c is not None}
    assert {r.doc_id for r in with_words if r.doc_id is not None} == {c for _, c in labels}
    assert sum(1 for r in stay if not shingles(r.text, 5)) == sum(1 for _, t in rows if not shingles(t, 5))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nj.linked(df).count() == 0 and nj.one_of_each(df, nj.Similarity()).count() == 0


def test_signatures_never_miss():
    r = np.random.default_rng(5)
    for sim in (nj.Similarity(), nj.Similarity(5, 80, 100)):
        for n in (1, 2, 5, 6, 7, 12, 13, 30, 100, 400):
            for _ in range(30):
                a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
                keep = a[r.permutation(len(a))[: max(1, len(a) - r.integers(0, n // 5 + 1))]]
                b = np.unique(np.concatenate([keep, r.integers(0, 1 << 63, r.integers(0, n // 5 + 1), dtype=np.uint64)]))
                both = nj.overlap(a, b)
                if both >= sim.need(len(a) + len(b)) and not np.array_equal(a, b):
                    for frequent in (a[:0], a[::3], a[: len(a) * 9 // 10], a):
                        sig, owner = nj.signatures([1, 2], [a, b], sim, np.sort(frequent))
                        mine = [set(sig[np.isin(owner, [nj.node(k, t) for t in range(99)])].tolist()) for k in (1, 2)]
                        assert mine[0] & mine[1]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(3000), r.randrange(3000)) for _ in range(2200)]
    import loomtext.llm.graph as g

    old, g.FINISH = g.FINISH, 50
    try:
        got = {x.node: x.label for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    finally:
        g.FINISH = old
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            parent[root(u)] = root(v)
    assert set(got) == set(parent)
    pairs = {(got[n], root(n)) for n in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_one_of_each_keeps_values_of_any_column(spark):
    """_set, _key, _id, label, key and c0 are the operator's own names; of rows alike in id and text one stays."""
    inner = ["_set", "_key", "_id", "label", "key", "c0", "node"]
    text = " ".join(f"w{i}" for i in range(40))
    texts = [(3, text), (1, text), (1, text), (7, text + " w1"), (8, "quite other words that link with nothing at all"), (9, None), (9, ""), (None, " "), (None, text), (11, "x")]
    rows = [(d, t, *(100 * k + i for k in range(len(inner)))) for i, (d, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in inner)).repartition(3)
    out = nj.one_of_each(df, nj.Similarity(words=5, num=80, den=100))
    assert out.columns == df.columns
    got = {tuple(r) for r in out.collect()}
    assert got <= set(rows) and len(got) == 6
    assert {r[:2] for r in got} == {(1, text), *((d, t) for d, t in texts[4:] if t != text)}


def phrased(seed, n):
    """Short texts that share phrases of one shingle by chance, and a near copy of every tenth."""
    r = random.Random(seed)
    phrases = [[f"p{k}x{j}" for j in range(4)] for k in range(20)]
    rows = []
    for i in range(n):
        w = [x for k, p in enumerate(r.sample(phrases, 4)) for x in (*p, f"d{i}x{k}", f"e{i}x{k}")]
        rows.append((2 * i, " ".join(w)))
        if i % 10 == 0:
            rows.append((2 * i + 1, " ".join([*w, "more"])))
    return rows


def test_chance_ties_are_not_sent_tile_by_tile(spark, monkeypatch):
    """Clusters that grow with the table, of texts that link with nothing: what is shuffled grows with the table, not with its square."""
    monkeypatch.setattr(nj, "TILE", 8)
    monkeypatch.setattr(nj, "SAMPLE", 1)
    monkeypatch.setattr(nj, "FINER", 8, raising=False)
    store, written = spark.sparkContext._jsc.sc().statusStore(), []
    for n in (200, 1600):
        rows = phrased(6, n)
        before = store.executorList(False).head().totalShuffleWrite()
        got = nj.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        written.append(store.executorList(False).head().totalShuffleWrite() - before)
        assert {r.doc_id: r.component_id for r in got} == {d: d - d % 2 for d, _ in rows}
    assert written[1] < 12 * written[0], written


def test_finer_signatures_never_miss():
    r = np.random.default_rng(6)
    for sim in (nj.Similarity(), nj.Similarity(5, 80, 100)):
        for n in (2, 5, 7, 13, 30, 100, 400):
            for turn in (1, 2, 3):
                a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
                b = np.unique(np.concatenate([a[r.permutation(n)[: n - n // 12]], r.integers(0, 1 << 63, n // 14, dtype=np.uint64)]))
                if nj.overlap(a, b) < sim.need(len(a) + len(b)) or np.array_equal(a, b):
                    continue
                for frequent in (a[:0], a[::3], a[: n * 9 // 10], a):
                    shared = 0
                    for t in range(99):
                        own = [nj.node(k, t) for k in (1, 2)]
                        sig, at = nj.finer_signatures([(7, own[0], 1, a), (7, own[1], 2, b), (8, own[1], 2, b)], sim, np.sort(frequent), turn)
                        shared += len(np.intersect1d(sig[at == own[0]], sig[at == own[1]]))
                    assert shared


def test_tiles_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(nj, "TILE", 5)
    monkeypatch.setattr(nj, "FINER", 6)
    monkeypatch.setattr(nj, "ROUND", 1)
    rows = corpus(8) + [(1000 + i, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3 + f"w{i}") for i in range(40)]
    got = nj.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, nj.Similarity())
