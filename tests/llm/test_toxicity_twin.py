"""Scores against counting, choosing and fitting in plain Python."""

import math
import random
import zlib

import numpy as np
import pytest

from loomtext.llm import toxicity as tx


def words_of(text, decoder):
    """Distinct restored words of a text; the decoder has its own test against all paths."""
    ascii_white = [x.decode() for x in (text or "").encode().split()]
    return {w for x in ascii_white for w in decoder.restore(x)} | set(decoder.spaced(text or ""))


def logit_fit(x, y):
    """Dense Newton steps on the ridge-penalised likelihood; the intercept has next to no penalty."""
    a = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([1e-6] + [tx.RIDGE] * x.shape[1])
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w += np.linalg.solve((a.T * (p * (1 - p))) @ a + ridge, a.T @ (y - p) - ridge @ w)
    return w


def brute(rows, labels, decoder):
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5
    toxic = {}
    for d, t in labels:
        if d is not None and t is not None and fold(d):
            toxic[d] = max(t, toxic.get(d, 0))
    train = [(words_of(t, decoder), int(toxic[d] > 0)) for d, t in rows if d in toxic]
    n1, n0 = sum(y for _, y in train), sum(1 - y for _, y in train)
    stat = {}
    for w in set().union(*(s for s, _ in train)):
        a, b = sum(w in s and y for s, y in train), sum(w in s and not y for s, y in train)
        if a + b >= tx.LEAST_COUNT:
            cells = [(a, a + b, n1), (b, a + b, n0), (n1 - a, n1 + n0 - a - b, n1), (n0 - b, n1 + n0 - a - b, n0)]
            stat[w] = sum(2 * o * math.log(o * (n1 + n0) / (r * c)) for o, r, c in cells if o)
    # Benjamini and Hochberg: the largest k whose k-th smallest p is at most FALSE * k / m.
    p = sorted(math.erfc(math.sqrt(max(s, 0) / 2)) for s in stat.values())
    most = max((k + 1 for k, x in enumerate(p) if x <= tx.FALSE * (k + 1) / len(p)), default=0)
    chosen = sorted(w for w, s in stat.items() if most and math.erfc(math.sqrt(max(s, 0) / 2)) <= p[most - 1] * (1 + 1e-9))
    w = logit_fit(np.array([[float(c in s) for c in chosen] for s, _ in train]).reshape(len(train), -1), np.array([float(y) for _, y in train]))
    out = []
    for d, t in rows:
        own = words_of(t, decoder)
        out.append((d, fold(d) == 0, 1 / (1 + math.exp(-(w[0] + sum(x for c, x in zip(chosen, w[1:]) if c in own)))), sorted(own & set(chosen))))
    return out


def test_scores_equal_plain_python(spark):
    r = random.Random(6)
    plain = [f"{a}{b}" for a in ("lo", "ma", "ri", "te", "su") for b in ("ren", "dal", "kin", "mo", "pes")]
    hidden = ["idiot", "1d10t", "IDIOT!", "i.d.i.o.t", "idiiiiot", "i d i o t", "scum", "$cum", "vermin"]
    rows, labels = [], []
    for i in range(500):
        bad = r.random() < 0.2
        text = r.choices(plain, k=r.randint(0, 25)) + ([r.choice(hidden)] if bad and r.random() < 0.9 else []) + (["scum"] if not bad and r.random() < 0.02 else [])
        r.shuffle(text)
        rows.append((i, " ".join(text)))
        if r.random() < 0.8:
            labels.append((i, int(bad)))
    labels += [(3, 1), (3, 0), (None, 1), (7, None), (4242, 1)]
    rows += [(None, "idiot"), (500, None), (501, ""), (502, "scum " * 3000)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    decoder = tx.Decoder(tx.trigrams(docs))
    got = sorted(((x.doc_id, x.held_out, x.score, x.hits, x.predicted) for x in tx.train_and_score(docs, marks).collect()), key=lambda x: (x[0] is None, x[0]))
    want = sorted(brute(rows, labels, decoder), key=lambda x: (x[0] is None, x[0]))
    assert any(h for *_, h in want)
    for g, b in zip(got, want, strict=True):
        assert g[:2] == b[:2] and g[2] == pytest.approx(b[2], abs=1e-6) and g[3] == b[3] and g[4] == int(g[2] >= 0.5)
