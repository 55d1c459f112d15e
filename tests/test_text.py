"""Text functions: golden facts and properties."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.functions import language, sentences, stem, text, transform


def col(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def one(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_tokens(spark):
    df = col(spark, ["Hello, World!", "Größe Straße", "", None, "a_b c-d 12x"])
    assert one(df, text.tokens(F.col("x"))) == [["hello", "world"], ["größe", "straße"], [], None, ["a", "b", "c", "d", "12x"]]
    df = col(spark, ["the quick and the brown fox"])
    assert one(df, text.tokens_with_stopwords(F.col("x"))) == [["quick", "brown", "fox"]]
    assert len(text.STEM_STOPWORDS) == 36 and text.SEARCH_STOPWORDS == sorted(text.SEARCH_STOPWORDS)


def test_fixed_chunks(spark):
    df = col(spark, ["abcdefghij", "", None, "abc"])
    assert one(df, text.fixed_chunks(F.col("x"), 4, 1)) == [["abcd", "defg", "ghij"], [], None, ["abc"]]
    with pytest.raises(ValueError):
        text.fixed_chunks(F.col("x"), 4, 4)


SENTENCES = [
    ("Hello world. How are you?", {}, 2), ("Mr. Smith went home. He was tired.", {}, 2), ("The value is 3.14 here.", {}, 1), ("He said... Go away.", {}, 2), ("", {}, 0),
    ("no terminator here", {}, 1), ('"Why?" she asked. He left.', {}, 2), ("para one\n\npara two", {"newline_boundaries": True}, 2), ("Das ist z.B. gut. Super.", {"language": "de"}, 2),
    ("Foo LLC. continues here.", {"abbreviations": ("llc",)}, 1), ("A.\r\nB", {}, 1), ("Go home.\r\nNow.", {}, 1),
]


@pytest.mark.parametrize(("s", "options", "n"), SENTENCES)
def test_sentence_counts(s, options, n):
    assert len(sentences.split_text(s, sentences.Options(**options))) == n


def test_sentences_in_columns(spark):
    assert sentences.split_text("Run! Now!") == ["Run!", "Now!"]
    df = col(spark, ["É one. Two.", None])
    spans = one(df, sentences.sentence_spans(F.col("x")))
    assert [tuple(s) for s in spans[0]] == [(0, 7), (8, 12)] and spans[1] is None
    assert one(df, sentences.sentences(F.col("x")))[0] == ["É one.", "Two."]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB .!?\"()[]\n1é", max_size=60))
def test_sentence_spans_ascend(s):
    data, at = s.encode(), 0
    for a, z in sentences.spans(data):
        assert at <= a < z <= len(data)
        data[a:z].decode()
        at = z
    kept = sentences.spans(data, sentences.Options(preserve_whitespace=True))
    assert b"".join(data[a:z] for a, z in kept) == data


STEMS = {"running": "run", "consist": "consist", "consistency": "consist", "consisting": "consist", "knightly": "knight", "generate": "generat", "communism": "communism", "happy": "happi", "skies": "sky", "dying": "die", "hopping": "hop", "hoping": "hope", "nationality": "nation", "relational": "relat", "electricity": "electr", "formally": "formal", "cats": "cat", "gas": "gas", "this": "this", "agreed": "agre", "luxuriated": "luxuri", "falling": "fall", "kneeling": "kneel", "inning": "inning", "cry": "cri", "by": "by", "say": "say"}


def test_stems(spark):
    for w, s in STEMS.items():
        assert stem.english(w) == s, w
    for w, s in {"läuft": "lauft", "häuser": "haus", "kategorischen": "kategor", "aufgaben": "aufgab", "möglichkeit": "moglich", "jähriges": "jahrig", "katers": "kat", "straße": "strass"}.items():
        assert stem.german(w) == s, w
    for fn, words in ((stem.swedish, {"jaktkarlarne": "jaktkarl", "klostergården": "klostergård", "kristligt": "krist", "friheten": "frihet", "hus": "hus"}), (stem.norwegian, {"havnene": "havn", "opning": "opning", "vakre": "vakr", "friheten": "frihet", "vesentlig": "vesent"}), (stem.danish, {"undersøgelser": "undersøg", "indtil": "indtil", "underligt": "under", "husene": "hus", "venlig": "ven"})):
        for w, s in words.items():
            assert fn(w) == s, w
    with pytest.raises(ValueError, match="unknown stemmer language: klingon"):
        stem.stemmer("klingon")
    df = col(spark, ["a quick runs", None])
    assert one(df, stem.tokenize_and_stem(F.col("x"), "english", min_token_bytes=3)) == [["quick", "run"], None]


def test_language(spark):
    assert language.detect_text("The quick brown fox jumps over the lazy dog and they were there") == "eng"
    assert language.detect_text("Der schnelle braune Fuchs springt über den faulen Hund") == "deu"
    assert language.detect_text("hi") == "und" and language.detect_text("Привет, как дела сегодня") == "rus" and language.detect_text("これは日本語の文章です") == "jpn"
    assert language.detect_text("The quick and the dead of night", only=["FRA", "zzz"]) in ("fra", "und")
    assert language.detect_text("The quick and the dead of night", ignore=["eng"]) != "eng"
    df = col(spark, ["the people and the water of this", "hi", None])
    assert one(df, language.detect_if_long(F.col("x"))) == ["eng", None, None]
    assert [len(x) if x is not None else None for x in one(df, language.detect_all(F.col("x")))] == [1, 0, None]
    assert one(col(spark, ["ENG", "zzz"]), language.language_exists(F.col("x"))) == [True, False]


@pytest.mark.parametrize(("s", "slug"), [("Hello World", "hello-world"), ("Ärger über Übel", "arger-uber-ubel"), ("foo@bar#baz!", "foo-bar-baz"), ("a   b   c", "a-b-c"), ("ES2024 rocks", "es2024-rocks"), ("", ""), ("Œuvre Straße", "oeuvre-strasse")])
def test_slugs(s, slug):
    assert transform.slug_text(s) == slug
    assert transform.slug_text("Hello World", "_") == "hello_world"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc .\n#é", max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_chunks_fit_and_lose_nothing(s, size, overlap):
    for markdown in (False, True):
        chunks = transform.chunk_text(s, size, overlap, markdown)
        assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
        if not overlap:
            assert re.sub(r"\s", "", "".join(chunks)) == re.sub(r"\s", "", s)


def test_chunks():
    assert transform.chunk_text("short") == ["short"]
    assert transform.chunk_text("One two. Three four.", 10) == ["One two.", "Three", "four."] or transform.chunk_text("One two. Three four.", 11) == ["One two.", "Three four."]
    with pytest.raises(ValueError):
        transform.chunk_text("x", 100, 100)


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last if x == y else 10**9)
    return d[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\nc ", max_size=30), st.text(alphabet="ab\nc ", max_size=30))
def test_diffs_restore_both_sides(a, b):
    for kind in ("chars", "words", "lines"):
        h = transform.hunks(kind, a, b)
        assert "".join(x["value"] for x in h if not x["removed"]) == b and "".join(x["value"] for x in h if not x["added"]) == a
        assert all((x["added"], x["removed"]) != (y["added"], y["removed"]) for x, y in zip(h, h[1:]))
        o = transform.offsets(kind, a, b)
        assert not o or (o[-1]["old_end"], o[-1]["new_end"]) == (len(a.encode()), len(b.encode()))
    script = transform.edit_script(list(a), list(b))
    assert sum(x2 - x1 + y2 - y1 for op, x1, x2, y1, y2 in script if op != "=") == distance(a, b)


def test_diff_facts():
    assert transform.hunks("chars", "cat", "cats")[-1] == {"value": "s", "added": True, "removed": False}
    assert transform.hunks("lines", "", "") == [] and not any(h["added"] or h["removed"] for h in transform.hunks("lines", "a\nb", "a\nb"))
    assert transform.patch_text("f", "a\nb\nc\n", "a\nx\nc\n") == "--- f\n+++ f\n@@ -1,3 +1,3 @@\n a\n-b\n+x\n c\n"
    assert transform.hunks("trimmed", "a  \nb", "a\nb") == [{"value": "a\nb", "added": False, "removed": False}]


def test_merge():
    m = transform.merge_values
    assert m({"a": 1, "b": 2}, {"b": 3, "c": 4}) == {"a": 1, "b": 3, "c": 4}
    assert m([1, 2], [3, 4]) == [1, 2, 3, 4] and m([1, 2], [3, 4], "overwrite") == [3, 4]
    assert m({"a": {"x": 1}}, {"a": {"y": None}, "__proto__": 1}) == {"a": {"x": 1, "y": None}} and m({"a": {}}, {"a": None}) == {"a": None}


def test_links(spark):
    df = col(spark, ["See http://a.com/x?y=1, and (https://b.org). ftp://no a@b.co", "none", None])
    assert one(df, text.links(F.col("x"))) == [["http://a.com/x?y=1", "https://b.org"], [], None]
    assert [tuple(x) for x in one(df, text.link_spans(F.col("x")))[0]] == [(4, 22), (29, 42)]
    assert one(df, text.emails(F.col("x")))[0] == ["a@b.co"] and one(df, text.has_link(F.col("x"))) == [True, False, None]


def test_every_quote_opens_or_closes():
    split = sentences.split_text
    assert split('Stop!" Go on. Yes.') == ['Stop!" Go on. Yes.']
    assert split('Wait..." She ran. Ok.') == ["Wait...", '" She ran. Ok.']
    assert split('He said "Stay." Then left. Bye.') == ['He said "Stay."', "Then left.", "Bye."]
    assert split("a (b. C) done. End") == ["a (b. C) done.", "End"] and split("at d. E") == ["at d. E"] and split("A word.b Next") == ["A word.b Next"] and split("It ends.Now it goes.") == ["It ends.", "Now it goes."]
    assert split("x" * 40 + ". Next one") == ["x" * 40 + ".", "Next one"] and split("one\n\n\n\ntwo", sentences.Options(newline_boundaries=True)) == ["one", "two"]
