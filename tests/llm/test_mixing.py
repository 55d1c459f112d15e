"""Mixing against plain Python and against its SQL."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from loomtext.llm import mixing


def brute(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    h = lambda d: int(hashlib.md5(str("" if d is None else d).encode()).hexdigest()[:15], 16)
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    # Share out, cap, share the excess out again among those below their caps.
    target, open_ = dict.fromkeys(sources, 0.0), set(sources)
    left = float(sum(total.values()))
    while open_ and left > 1e-9:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if target[s] + weight[s] * unit >= 3 * total[s]}
        if not over:
            for s in open_:
                target[s] += weight[s] * unit
            break
        for s in over:
            left -= 3 * total[s] - target[s]
            target[s] = 3.0 * total[s]
        open_ -= over
    out = []
    for s in sources:
        own = [(h(d), d, size(t)) for d, t, x in rows if x == s]
        times = min(3, int(target[s] / total[s] + 1e-12)) if total[s] else 0
        rest, upto, more = target[s] - times * total[s], 0, set()
        for key in sorted({k for k, _, _ in own}):
            n = sum(z for k, _, z in own if k == key)
            if times < 3 and 2 * upto + n <= 2 * rest + 1e-9:
                more.add(key)
            upto += n
        out += [(d, z, total[s], target[s], z * (times + (k in more))) for k, d, z in own]
    return sorted(out, key=repr)


def rows(seed, n=300):
    r = random.Random(seed)
    names = ["a", "b", "Z", "é", None, "tiny", "empty"]
    made = []
    for i in range(n):
        s = r.choices(names, [60, 10, 5, 5, 8, 1, 2])[0]
        made.append((i, "" if s == "empty" else "w " * r.choice([0, 1, 3, 8, 30, 400]), s))
    return [*made, (5, "again twice", "a"), (5, "again twice", "a"), (None, "no id", "b"), (None, None, "b"), (n + 1, None, "empty")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain_python(spark, seed):
    data = rows(seed)
    df = spark.createDataFrame([(d, t, s, 1, "x") for d, t, s in data], "doc_id long, text string, source string, size int, _hash string").repartition(3)
    got = sorted((tuple(r) for r in mixing.mix(df).collect()), key=repr)
    for a, b in zip(got, brute(data), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3]) and a[4] == b[4]
    by = {}
    for d, size, whole, target, taken in got:
        by.setdefault((whole, target), []).append((size, taken))
        assert taken <= 3 * size
    for (_, target), docs in by.items():
        assert abs(sum(t for _, t in docs) - target) <= max(s for s, _ in docs)


def test_equals_sql(spark):
    data = rows(4)
    con = duckdb.connect()
    documents = pa.table({"doc_id": [d for d, _, _ in data], "text": [t for _, t, _ in data], "source": [s for _, _, s in data]})  # noqa: F841
    want = con.execute(mixing.SQL).fetchall()
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


INNER = ["_n", "_hash", "_edge", "_s", "_source", "_times", "_salt", "c0"]


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_mixed_documents_follow_the_mix(spark, monkeypatch, broadcast):
    """Each row as often as the mix says, with the values of all columns, also those that are named like inner ones."""
    monkeypatch.setattr(mixing, "SOURCE_BYTES", broadcast)
    data = [(*x, *(1000 * k + i for k in range(len(INNER)))) for i, x in enumerate(rows(5))]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in INNER)).repartition(3)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = Counter(map(tuple, out.collect()))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = {(d, z, s): t // z for d, z, s, _, t in brute([x[:3] for x in data]) if z}
    whole = {s: sum(size(x[1]) for x in data if x[2] == s) for s in {x[2] for x in data}}
    for x in data:
        if size(x[1]):
            assert got[x] == taken[x[0], size(x[1]), whole[x[2]]]
    assert set(got) <= set(data)


def test_few_or_many_sources_alike(spark, monkeypatch):
    df = spark.createDataFrame(rows(7), "doc_id long, text string, source string").repartition(3)
    want = sorted(map(repr, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "SOURCE_BYTES", 0)
    assert sorted(map(repr, mixing.mix(df).collect())) == want


def test_documents_are_neither_broadcast_nor_shuffled(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = mixing.mixed_documents(spark.createDataFrame(rows(8), "doc_id long, text string, source string"))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "BuildRight" in plan and "BuildLeft" not in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0 and mixing.mixed_documents(df).count() == 0
    out = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in out) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_plan_has_no_python(spark):
    df = spark.createDataFrame(rows(6), "doc_id long, text string, source string")
    plan = mixing.mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
