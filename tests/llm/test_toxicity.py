"""The decoder against all paths, and held-out accuracy of the scores."""

import itertools
import math
import zlib

import numpy as np
import pytest

from loomtext.catalog import table
from loomtext.llm import toxicity as tx

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def decoder(spark):
    return tx.Decoder(tx.trigrams(table(spark, SF, "documents")))


def path_score(logp, parts):
    a = b = 0
    total = 0.0
    for text, cost in [*parts, (" ", 0.0)]:
        total += cost
        for c in text:
            k = tx.letter(c)
            if k or b:
                total += logp[a][b][k]
                a, b = b, k
    return total


@pytest.mark.parametrize("s", ["1d10t", "m0r0n!", "st00p1d", "l 0 s e r", "cl0wn", "trraaash", "a1$b"])
def test_viterbi_equals_all_paths(decoder, s):
    best = max(itertools.product(*tx.Decoder.lattice(s)), key=lambda p: path_score(decoder.logp, p))
    got = decoder.decode(s)
    assert path_score(decoder.logp, best) == pytest.approx(max(path_score(decoder.logp, p) for p in itertools.product(*tx.Decoder.lattice(s)) if "".join(x for x, _ in p).strip() == got))


def test_restores_hidden_words(decoder):
    for hidden in ("1d10t", "IDIOT!!", "i.d.i.o.t", "idiiiiot", "id1ot,", '"idiot"', "!d!ot?"):
        assert decoder.restore(hidden) == ["idiot"], hidden
    assert "idiot" in decoder.restore_text("such an i d i o t here")
    assert decoder.restore("thing") == ["thing"] and decoder.restore("###") == [] and decoder.restore("1234") == []
    assert decoder.restore("l'Été") == ["l", "été"]


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = {r.doc_id: r for r in tx.train_and_score(docs, labels).collect()}
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in out.items())
    held = [(out[r.doc_id].score, r.toxic) for r in labels.collect() if out[r.doc_id].held_out]
    toxic, other = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([(a > b) + (a == b) / 2 for a in toxic for b in other])
    assert auc > 0.7 and sum(s >= 0.5 for s in other) <= 0.02 * len(other)


def test_odd_rows(spark):
    rows = [(i, f"plain words {i % 7} here" + (" 1d10t" if i % 3 == 0 else ""), "x") for i in range(300)] + [(None, "idiot", "x"), (301, None, "x"), (302, "", "x"), (302, "", "x"), (303, "idiot " + "word " * 20000, "x"), (304, "! i d i o t !", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(300)] + [(None, 1, 1), (5, None, 1), (9999, 1, 1)], "doc_id long, toxic int, text int")
    out = tx.train_and_score(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[None].predicted == by[303].predicted == by[304].predicted == 1 and by[303].hits == ["idiot"]
    assert by[301].score == by[302].score < 0.1
    assert all(by[i].predicted == int(i % 3 == 0) for i in range(300))
    none = tx.train_and_score(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert tx.train_and_score(docs.limit(0), labels).count() == 0


def test_g2_matches_the_column_form():
    assert tx.g2(10, 0, 20, 80) == pytest.approx(2 * (10 * math.log(10 * 100 / (10 * 20)) + 10 * math.log(10 * 100 / (90 * 20)) + 80 * math.log(80 * 100 / (90 * 80))))
