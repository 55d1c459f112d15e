"""The Kneser-Ney model against one with dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomtext.llm import kneser_ney as kn
from loomtext.llm.common import column_bytes, word_hashes


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s> end"]


def brute(rows):
    train = [tokens(t) for d, t in rows if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2]
    uni = Counter(w for x in train for w in x)
    bi = Counter(p for x in train for p in zip(["<s> begin", *x], x))
    n, v = sum(uni.values()), len(uni)
    types = Counter(w for _, w in bi)
    cc = lambda c: [sum(x == k for x in c.values()) for k in range(1, 5)]
    d, e = kn.discounts(cc(bi)), kn.discounts(cc(types))
    cut = lambda c, d: c - [0, *d][min(c, 3)]
    total, after = Counter(), {}
    for (h, _), c in bi.items():
        total[h] += c
        after.setdefault(h, []).append(c)
    t = len(bi)
    gamma = sum([0, *e][min(c, 3)] for c in types.values()) / t if t else 1.0
    left = {h: sum([0, *d][min(c, 3)] for c in cs) / total[h] for h, cs in after.items()}

    def p(h, w):
        low = (cut(types[w], e) / t if t else 0) + gamma / (v + 1)
        return cut(bi[h, w], d) / total[h] + left[h] * low if total[h] else low

    out = []
    for i, text in rows:
        x = tokens(text)
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in x)
        own = sum(math.log10(p(h, w)) for h, w in zip(["<s> begin", *x], x))
        out.append((i, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, len(x), sum(uni[w] > 0 for w in x), n, base, own))
    return out, p, uni, total


def rows():
    r = random.Random(3)
    words = ["the", "The", "of", "Größe", "a", "zebra", "x1", "é", "#", "🙂"]
    made = [(i, " ".join(r.choices(words, [30, 5, 20, 3, 9, 1, 1, 1, 1, 1], k=r.randint(0, 30)))) for i in range(120)]
    return [*made, (None, "the a"), (5, None), (7, ""), (7, ""), (8, " \t\n"), (9, "the " * 4000), (9, "a\x0bb\xa0c")]


def test_scores_equal_dictionaries(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, 0.5) for i, t in data], "doc_id long, text string, score double").repartition(3)
    got = sorted((tuple(r)[:7] for r in kn.train_and_score(df).collect()), key=repr)
    want = sorted(brute(data)[0], key=repr)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_words_that_share_half_of_their_hash_are_told_apart(spark):
    """Two words whose hashes have the upper 32 bits in common (some do among 300,000) have pairs of their own."""
    words = [f"w{i}" for i in range(300_000)]
    h, _ = word_hashes(*column_bytes(pa.array([" ".join(words)])))
    half = h >> np.uint64(32)
    order = np.argsort(half)
    twins = [(words[a], words[b]) for a, b in zip(order[:-1], order[1:]) if half[a] == half[b]]
    assert twins
    a, b = twins[0]
    r = random.Random(1)
    data = [(i, " ".join(r.choices([a, b, "the", "of"], [5, 1, 3, 3], k=20))) for i in range(60)]
    got = sorted((tuple(x)[:7] for x in kn.train_and_score(spark.createDataFrame(data, "doc_id long, text string")).collect()))
    for x, y in zip(got, sorted(brute(data)[0]), strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-9)


def test_replies_equal_lookups(spark):
    """What the buckets send to a chunk is what the chunk finds by itself, and every chunk has a reply."""
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    model = kn.train(df.where("doc_id < 100"))
    folder = kn.ask(df.coalesce(1), model)
    col = pa.chunked_array([[r.text for r in df.coalesce(1).collect()]])
    s = kn.Scorer(model)
    number, _, before, _ = model.vocabulary.tokens_of(col)
    _, keys, _ = s.asked(before, number)
    assert kn.load_arrays(kn.reply_path(folder, kn.chunk_name(keys)))["counts"].sum() > 0
    assert (s.pairs(keys, folder) == s.pairs(keys)).all() and (s.pairs(keys[::2], folder) == s.pairs(keys)[::2]).all()
    for a, b in zip(s.texts(col, folder), s.texts(col), strict=True):
        assert (a == b).all()


def test_probabilities_sum_to_one():
    _, p, uni, total = brute(rows())
    for h in total:
        assert sum(p(h, w) for w in [*uni, "unseen word"]) == pytest.approx(1)


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert kn.train_and_score(df).count() == 0
    alone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = kn.train_and_score(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0, 0)
