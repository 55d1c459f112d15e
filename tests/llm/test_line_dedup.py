"""Line deduplication against all pairs of runs."""

import random

import pytest

from loomtext.llm import line_dedup as ld


def brute(rows, least):
    """Lines that lie in a run of `least` words of which an earlier copy exists, by comparing all places."""
    import xxhash

    def h(t):
        x = 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)
        return x - (1 << 64) if x >> 63 else x

    docs = {}
    for d, t in rows:
        key = ((d is not None, d or 0), h(t))
        docs[key] = [(x.strip(" \t\r\v\f"), len(x.split())) for x in (t or "").split("\n") if x.split()]
    places = sorted((k, p) for k, ls in docs.items() for p in range(len(ls)))
    gone = {k: set() for k in docs}
    for n, (k, p) in enumerate(places):
        for k2, q in places[:n]:
            m = words = 0
            a, b = docs[k], docs[k2]
            while p + m < len(a) and q + m < len(b) and a[p + m][0] == b[q + m][0]:
                words += a[p + m][1]
                m += 1
            if m and words >= least:
                gone[k].update(range(p, p + m))
    out = []
    for d, t in rows:
        g, stay, n, cut = gone[(d is not None, d or 0), h(t)], [], 0, False
        for line in (t or "").split("\n"):
            if line.split():
                cut, n = n in g, n + 1
            if not cut:
                stay.append(line)
        out.append((d, None if t is None else "\n".join(stay), n, sorted(g)))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    pool = [" ".join(f"{r.choice('abc')}{r.randrange(6)}" for _ in range(r.choice([1, 1, 2, 3, 5, 8]))) for _ in range(14)]
    blocks = [[r.choice(pool) for _ in range(r.randint(1, 9))] for _ in range(6)]
    rows = []
    for i in range(26):
        text = []
        for _ in range(r.randint(0, 4)):
            text += r.choice([r.choice(blocks), [f"own {i} {r.random()}"], ["", "  "], [r.choice(pool)], r.choice(blocks)[: r.randint(1, 4)]])
        rows.append((i, "\n".join(text)))
    return [*rows, rows[3], (3, "other\n" + rows[5][1]), (None, rows[4][1]), (90, None), (91, ""), (92, "\n\n"), (93, "w " * 3000), (94, "x\nw " + "w " * 2999)]


@pytest.mark.parametrize(("seed", "least"), [(1, 6), (2, 12), (3, 1), (4, 25)])
def test_equals_all_pairs(spark, seed, least):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, removed string, p int").repartition(3)
    out = ld.deduplicated(df, min_words=least)
    assert out.columns == ["doc_id", "text", "p", "n_lines", "n_removed", "removed"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.removed) for r in out.collect()), key=repr)
    assert got == brute(rows, least)


def test_without_repeats_keeps_columns_and_drops_copies(spark):
    text = "\n".join(f"line {i} with a few words" for i in range(10))
    rows = [(1, text, "en"), (2, text, None), (3, text + "\nown words", "en"), (4, None, "en"), (5, "short", "en")]
    out = ld.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert out.columns == ["doc_id", "text", "lang"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: text, 3: "own words", 4: None, 5: "short"}


def test_empty_table(spark):
    assert ld.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_named_like_inner_ones_keep_their_values(spark):
    """_id, _hash, _gone, gone, text_hash, p and c0 are the operator's own names; an input's n_lines is replaced."""
    inner = ["_id", "_hash", "_gone", "gone", "text_hash", "p", "c0", "c1"]
    text = "\n".join(f"line {i} with a few words" for i in range(10))
    rows = [(i, t, *(100 * k + i for k in range(len(inner))), -1) for i, t in enumerate([text, text, None, "", "short", text + "\nmore"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in inner) + ", n_lines int")
    out = ld.deduplicated(df)
    assert out.columns == ["doc_id", "text", *inner, "n_lines", "n_removed", "removed"]
    got = {r[0]: r for r in out.collect()}
    for x in rows:
        assert tuple(got[x[0]][2:-3]) == x[2:-1]
    assert [got[i]["n_lines"] for i in range(6)] == [10, 10, 0, 0, 1, 11]
    kept = {tuple(r) for r in ld.without_repeats(df).collect()}
    assert kept == {rows[0], rows[2], rows[3], rows[4], (5, "more", *rows[5][2:])}
