"""The pipeline: each stage against plain Python on what the stage before kept."""

import random
import re

import public_tokenizers
import pytest

import corpus_pipeline as cp
from loomtext.llm.tokens import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    r = random.Random(8)
    words = {"en": "the and of to is that with thing other land", "de": "der die und nicht ist auf mit haus baum"}
    line = lambda k: " ".join(r.choices(words[k].split(), k=35))
    shared = line("en")
    rows = []
    for i in range(60):
        k = r.choice(["en", "de"])
        rows.append((i, "\n".join(line(k) for _ in range(4)), k, f"src{i % 3}", 1))
    rows[10] = (10, rows[2][1], "en", "src0", 1)  # a copy
    near = rows[3][1].split()
    near[5] = "otherword"
    rows[11] = (11, " ".join(near), rows[3][2], "src0", 1)  # near, in one line
    rows[12] = (12, shared + "\n" + rows[12][1], "en", "src1", 1)
    rows[13] = (13, rows[13][1] + "\n" + shared, "en", "src1", 1)
    rows += [(60, None, "en", "src1", 0), (61, "12 34 !!", None, None, 8), (62, line("en"), "en", None, 1)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    out, docs = [rows], spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, f) in enumerate(cp.STAGES):
        f(spark, docs, str(folder)).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if i < 4:
            assert docs.columns == COLUMNS
        out.append([tuple(x) for x in docs.collect()])
    return str(folder), out


def test_language_stage(stages):
    _, out = stages
    assert sorted(out[1]) == sorted(x for x in out[0] if x[0] not in (60, 61))


def test_line_stage(stages):
    _, out = stages
    seen, want = set(), {}
    for d, text, *_ in sorted(out[1]):
        kept = [x for x in text.split("\n") if x not in seen]
        seen.update(text.split("\n"))
        if kept:
            want[d] = "\n".join(kept)
    assert {x[0]: x[1] for x in out[2]} == want and 10 not in want and all(x[4] == len(x[1]) for x in out[2])


def test_near_duplicate_stage(stages):
    _, out = stages
    sets = {}
    for d, text, *_ in out[2]:
        w = text.lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    stay = {d for d in sets if not any(e < d and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]) for e in sets)}
    assert {x[0] for x in out[3]} == stay and 11 not in stay


def test_mixing_stage(stages):
    _, out = stages
    n = lambda rows, s: sum(len(re.findall(r"\S+", x[1])) for x in rows if x[3] == s)
    total = sum(n(out[3], s) for s in ("src0", "src1", "src2", None))
    for s, w in (("src0", 1), ("src1", 2), ("src2", 3)):
        assert n(out[4], s) <= 3 * n(out[3], s)
        assert w < 3 or n(out[4], s) > 0.3 * total
    assert set(out[4]) <= set(out[3])


def test_token_stage(stages):
    _, out = stages
    t = tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((d, s, len(i := t.encode(x, add_special_tokens=False).ids), i) for d, x, _, s, _ in out[4])
    assert sorted((d, s, n, list(i)) for d, s, n, i in out[5]) == sorted(want, key=lambda x: (x[0], str(x[1]), x[2]))


def test_run_equals_the_stages(spark, stages):
    folder, out = stages
    assert sorted(map(repr, (tuple(x) for x in cp.run(spark, folder).collect()))) == sorted(map(repr, out[5]))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


INNER = ["_n", "_hash", "_set", "_id", "c0", "_text", "key"]
LONG = "\n".join(f"the land of thing number {i} and the other place" for i in range(20_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, null ids, null, empty, blank and very long texts, and columns named like inner ones."""
    texts = [(1, "the thing of the other land"), (1, "the thing of the other land"), (None, "the other place and land of the thing"), (2, None), (3, ""), (4, " \n "), (5, LONG), (6, "12 !"), (7, "the thing of the other land"), (8, LONG + "\nand one more line of the land")]
    rows = [(d, t, "en", None if i % 2 else "s", len(t or ""), *(100 * k + (0 if i == 1 else i) for k in range(len(INNER)))) for i, (d, t) in enumerate(texts)]
    rows[1] = rows[0]  # a whole row twice
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in INNER)
    return spark.createDataFrame(rows, ddl).repartition(3), rows


def run_stage(spark, name, df):
    out = dict(cp.STAGES)[name](spark, df, "")
    return out, sorted(map(tuple, out.collect()), key=repr)


def test_odd_rows_in_language_stage(spark, odd):
    df, rows = odd
    out, got = run_stage(spark, "language_id", df)
    assert out.columns == df.columns and got == sorted((r for r in rows if r[1] and "the" in r[1]), key=repr)
    assert run_stage(spark, "language_id", df.limit(0))[1] == []


def test_odd_rows_in_line_stage(spark, odd):
    df, rows = odd
    out, got = run_stage(spark, "line_dedup", df)
    # The lines of LONG in document 8 are later copies of those in document 5; short lines are no run of 30 words.
    want = [(*r[:1], "and one more line of the land", *r[2:4], 29, *r[5:]) if r[0] == 8 else (*r[:4], None if r[1] is None else len(r[1]), *r[5:]) for r in rows]
    assert out.columns == df.columns and got == sorted(want, key=repr)
    assert run_stage(spark, "line_dedup", df.limit(0))[1] == []


def test_odd_rows_in_near_duplicate_stage(spark, odd):
    df, rows = odd
    out, got = run_stage(spark, "near_duplicates", df)
    want = [r for i, r in enumerate(rows) if i not in (1, 8, 9)]  # a repeated row, a copy of document 1, and 8 beside 5
    assert out.columns == df.columns and got == sorted(want, key=repr)
    assert run_stage(spark, "near_duplicates", df.limit(0))[1] == []


def test_odd_rows_in_mixing_stage(spark, odd):
    from loomtext.llm import mixing

    df, rows = odd
    out, got = run_stage(spark, "mixing", df)
    assert out.columns == df.columns and set(got) <= set(rows)
    words = lambda rs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rs)
    taken = mixing.mix(df).collect()
    assert words(got) == sum(r.taken for r in taken) and run_stage(spark, "mixing", df.limit(0))[1] == []


def test_odd_rows_in_token_stage(spark, odd):
    df, rows = odd
    t = tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    got = run_stage(spark, "bpe", df)[1]
    want = [(r[0], r[3], len(i := t.encode(r[1] or "", add_special_tokens=False).ids), i) for r in rows]
    assert sorted(((a, b, n, list(i)) for a, b, n, i in got), key=repr) == sorted(want, key=repr)
    assert run_stage(spark, "bpe", df.limit(0))[1] == []
