"""BPE encoding and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import bpe, rans
from loomtext.llm.tokens import encode_texts, tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", " ", "Hello  wörld's 123 don't ### $$$ x 日本\x00", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", " x  y\x1cz", "é ́e İI ΟΔΟΣ ΣΣ", "aaaaaaa aaaa banana ananas", "x" * 3000, "🙂🙂👩‍👩‍👧 ﬁ", "'s't're've'm'll'd", "\n\n\t\r\x0b\x0c", "a" * 5 + "　" + "b"]


def expected(texts):
    return [tokenizer(PATH).encode(x, add_special_tokens=False).ids for x in texts]


def test_pair_index_equals_library_on_hard_texts():
    got, _ = bpe.encode_column([x.encode() for x in HARD], PATH)
    assert [g.tolist() for g in got] == expected(HARD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_pair_index_equals_library(texts):
    got, _ = bpe.encode_column([x.encode() for x in texts], PATH)
    assert [g.tolist() for g in got] == expected(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abinth e'", max_size=60), max_size=6))
def test_pair_index_on_overlapping_pairs(texts):
    got, _ = bpe.encode_column([x.encode() for x in texts], PATH)
    assert [g.tolist() for g in got] == expected(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=6))
def test_library_by_word_equals_whole_texts(texts):
    ids, n = encode_texts(pa.chunked_array([pa.array(texts, pa.string())]), PATH)
    want = expected([x or "" for x in texts])
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_decode_equals_library():
    v = bpe.vocabulary(PATH)
    for ids in [*expected(HARD), [49406, 5, 49407]]:
        assert bpe.decode(ids, v) == tokenizer(PATH).decode(ids, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), min_size=1, max_size=3000), st.integers(1, 40))
def test_token_file_round_trip(ids, spread):
    ids = np.array([i % spread if spread < 30 else i for i in ids], np.uint32)
    f = rans.TokenFile(rans.encode_file([None, 7], np.array([1, len(ids) - 1]), ids))
    assert f.ids().tolist() == ids.tolist() and f.doc_ids == [None, 7] and f.lengths.tolist() == [1, len(ids) - 1]


def test_blocks_decode_apart_and_damage_is_found():
    ids = np.random.default_rng(1).zipf(1.3, 600_000).astype(np.uint32) % 49_000
    data = rans.encode_file([1], np.array([len(ids)]), ids)
    f = rans.TokenFile(data)
    assert len(f.meta["checkpoints"]) == 3
    assert f.block(1).tolist() == ids[rans.BLOCK : 2 * rans.BLOCK].tolist()
    at = f.meta["checkpoints"][2][0]
    bad = data[: at + 9000] + bytes([data[at + 9000] ^ 1]) + data[at + 9001 :]
    with pytest.raises(ValueError, match="have changed"):
        rans.TokenFile(bad).block(2)
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids) / 8
    assert len(data) < 1.12 * entropy + 30_000


ROWS = [(3, "the cat sat", "x"), (1, None, "y"), (1, "", "y"), (None, "a b", None), (2, "the the", "z"), (2, "the the", "z"), (9, "w " * 5000, "x")]


def test_queries_on_rows(spark):
    df = spark.createDataFrame([(d, t, s, 1) for d, t, s in ROWS], "doc_id long, text string, ids string, n_tokens int")
    want = sorted(((d, expected([t or ""])[0]) for d, t, _ in ROWS), key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted(rans.token_files(df, PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in want]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=key) == sorted([(d, len(i) + 1, zlib.crc32(np.array([*i, 2], "<u4").tobytes())) for d, i in want], key=key)
    digests = bpe.digests(df, PATH).collect()
    by_id = {(r.doc_id, r.n_tokens): (r.ids_sha256, r.decoded_sha256) for r in digests}
    assert len(digests) == len(ROWS)
    for d, i in want:
        assert by_id[d, len(i)] == (hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(tokenizer(PATH).decode(i, skip_special_tokens=False).encode()).hexdigest())
    enc = bpe.decode_ids(bpe.encode(df, PATH), PATH)
    assert enc.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    assert {r.decoded for r in enc.collect() if r.doc_id == 3} == {"the</w> cat</w> sat</w>"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rans.token_files(df, PATH).count() == 0 and bpe.digests(df, PATH).count() == 0
