"""Words of languages with few labels, and hidden words of any letters."""

import zlib

import numpy as np
import pytest

from loomtext.catalog import table
from loomtext.llm import toxicity as tx


def test_words_of_a_language_with_few_labels_count(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    ids = [i for i in range(1000) if not held(i)][:600]
    last = next(i for i in range(1000, 2000) if held(i))
    toxic, rare = set(ids[:66]), set(ids[60:66])
    word = lambda i: "aeiou"[i % 5] + "klmnp"[i // 5 % 5] + "aeiou"[i // 25 % 5]
    rows = [(i, f"{word(i)} {word(7 * i)} " + ("bomente" if i in rare else "idiot" if i in toxic else "")) for i in ids] + [(last, "ame bomente")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in ids], "doc_id long, toxic int")
    out = {r.doc_id: r for r in tx.train_and_score(docs, labels).collect()}
    assert out[last].held_out and out[last].predicted == 1 and out[last].hits == ["bomente"]


def test_threshold_is_that_of_all_words():
    assert tx.threshold([(30.0, 1), (20.0, 2), (1.0, 997)]) == 20.0
    assert tx.threshold([(1.0, 10)]) == tx.threshold([]) == float("inf")


def test_sparse_newton_is_at_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.random((50, 6)) < 0.3
    y, n = (rng.random(50) < 0.4).astype(float), rng.integers(1, 4, 50).astype(float)
    row, col = np.nonzero(x)
    w = tx.logistic(row, col, 6, y, n)
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert np.abs(x.T @ (n * (y - p)) - tx.RIDGE * w[1:]).max() < 1e-6 and abs((n * (y - p)).sum()) < 1e-4


@pytest.fixture(scope="module")
def decoder(spark):
    return tx.Decoder(tx.trigrams(table(spark, "/root/testdata/sf0.01", "documents")))


@pytest.mark.parametrize("gap", [" ", "  ", "\n", "\r\n", "\u00a0", "\t "])
@pytest.mark.parametrize("word", ["réeuxment", "idiot"])
def test_spaced_words_of_any_letters_and_gaps(decoder, word, gap):
    assert decoder.spaced(f"before {gap.join(word)} after") == [word]
    assert word in decoder.restore_text(f"before {gap.join(word)} after").split()


def test_digits_that_all_stand_for_letters(decoder):
    assert "".join(decoder.restore("1337")).isalpha()
    assert decoder.restore("2026") == []


def test_letters_at_the_ends_of_a_run_are_kept(decoder):
    assert "".join(decoder.spaced("! é t é !")) == "été"
