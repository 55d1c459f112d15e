"""Evidence fusion against plain Python."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.catalog import table
from loomtext.llm import language_id as li

SF = "/root/testdata/sf0.001"
L = li.LANGUAGES


def trigrams(text):
    c = [int(li.CLASS[b]) for b in text.encode()]
    return [((((a << 16 | b << 8 | d) * 0x9E3779B1) & 0xFFFFFFFF) >> 18) for a, b, d in zip(c, c[1:], c[2:]) if (a, b, d) != (32, 32, 32)]


def brute(rows):
    """rows: (text, declared, host, suffix)."""
    n = np.full((len(L), li.FEATURES), 0.5)
    for text, d, _, _ in rows:
        if d in L:
            for f in trigrams(text or ""):
                n[L.index(d), f] += 1
    logp = np.log((1 - li.EVEN) * n / n.sum(1, keepdims=True) + li.EVEN / li.FEATURES)
    ps, count, known = [], [], []
    both = [*logp, np.log(np.exp(logp).mean(0))]
    for text, *_ in rows:
        f = trigrams(text or "")
        share = min(len(f), li.EVIDENCE) / max(1, len(f))
        odds = share * (max(sum(m[x] for x in f) for m in both) + len(f) * math.log(li.FEATURES)) + math.log(1 / li.FOREIGN - 1)
        known.append(odds >= 0)
        s = sum((logp[:, x] for x in f), np.zeros(len(L))) * min(len(f), li.EVIDENCE) / max(1, len(f))
        p = np.exp(s - s.max())
        ps.append(np.round(p / p.sum(), 9))
        count.append(len(f))
    own = [np.floor(p * li.UNIT + 0.5) if c else np.zeros(len(L)) for p, c in zip(ps, count)]
    hosts, suffixes, declared, every = (defaultdict(lambda: np.zeros(len(L))) for _ in range(4))
    for (_, d, h, s), o in zip(rows, own):
        hosts[h] += o
        suffixes[s] += o
        every[0] += o
        if d in L:
            declared[d] += o
    total = sum(declared.values(), np.zeros(len(L))) / li.UNIT
    smooth = lambda c, t: (np.maximum(c, 0) / li.UNIT + li.SMOOTH * t) / (np.maximum(c, 0).sum() / li.UNIT + li.SMOOTH)
    out = []
    for (_, d, h, s), p, o, c, k in zip(rows, ps, own, count, known):
        prior = smooth(every[0] - o, np.full(len(L), 1 / len(L)))
        prior = smooth(suffixes[s] - o if s else np.zeros(len(L)), prior)
        prior = smooth(hosts[h] - o if h else np.zeros(len(L)), prior)
        score = np.log(np.maximum(p, 1e-9)) + np.log(prior)
        for j, language in enumerate(L):
            if d in L:
                score[j] += math.log((declared[d][j] / li.UNIT + (5 if d == language else 1)) / (total[j] + len(L) + 4))
            if s in li.COUNTRY:
                spoken = li.COUNTRY[s]
                score[j] += math.log(li.SUFFIX_RIGHT / len(spoken) if language in spoken else (1 - li.SUFFIX_RIGHT) / (len(L) - len(spoken)))
        q = np.exp(score - score.max())
        q = q / q.sum()
        out.append((q, c > 0 and q.max() >= li.LEAST and k))
    return out


@pytest.mark.parametrize("few", [100_000, 0])
def test_posteriors_equal_plain_python(spark, monkeypatch, few):
    """Whether the sums of hosts and suffixes are broadcast or meet the rows by salted shuffles."""
    monkeypatch.setattr(li, "BROADCAST_ROWS", few)
    r = random.Random(4)
    words = {"en": "the and of to is that with", "de": "der die und nicht ist auf mit", "fr": "le la et que dans sur pour", "es": "el los que por con una del"}
    rows = []
    for i in range(150):
        k = r.choice(L)
        text = " ".join(r.choices(words[k].split(), k=r.choice([1, 2, 30])))
        rows.append((text, r.choice([k, k, k, None, "xx", r.choice(L)]), r.choice(["a.de", "b.fr", "c.com", None, f"h{i % 9}.{k}"]), r.choice(["de", "fr", "com", "ch", None])))
    rows += [(None, "fr", "a.de", "de"), ("", None, None, None), ("12 34", "es", None, None), ("ü" * 4000, "de", None, None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id long, text string, declared string, host string, suffix string").repartition(3)
    source = li.Input("text", declared=F.col("declared"), host=F.col("host"), suffix=F.col("suffix"))
    got = {x.id: x for x in li.identify([(df, source, ["id"])]).collect()}
    for i, (q, ok) in enumerate(brute(rows)):
        assert list(got[i].posteriors) == pytest.approx(list(q), abs=2e-5)
        assert got[i].accepted == ok and got[i].confidence == max(got[i].posteriors)


def test_markup_and_hosts(spark):
    declared, text = li.markup('<!DOCTYPE html><html class="x" lang="FR-ca"><style>p{}</style><p>a &amp; b<script>var t="</p>";</script><!-- no -->')
    assert (declared, text.split()) == ("fr", ["a", "&", "b"])
    assert li.markup("no tags") == (None, "no tags")
    urls = [("http://User@Www.Example.DE:80/x",), ("mailto:x",), (None,), ("https://1.2.3.4/",), ("ftp://host/",)]
    df = spark.createDataFrame(urls, "url string")
    got = [tuple(r) for r in df.select(li.host(F.col("url")), li.suffix(li.host(F.col("url")))).collect()]
    assert got == [("www.example.de", "de"), (None, None), (None, None), ("1.2.3.4", None), ("host", None)]


def test_whole_tables(spark):
    docs, pages = table(spark, SF, "documents"), table(spark, SF, "pages")
    out = li.identify([(docs, li.documents_input(), ["doc_id"]), (pages, li.pages_input(), ["page_id"])]).collect()
    assert len(out) == docs.count() + pages.count()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(r.language == truth[r.doc_id] for r in out if r.doc_id is not None) > 0.97 * len(truth)
    assert sum(not r.accepted for r in out) < 0.02 * len(out)


def test_accepted_keeps_columns(spark):
    df = spark.createDataFrame([(1, "the thing", "en", "s", 1, "x"), (2, None, "en", "s", 1, "x"), (3, "12", None, None, 2, None), (3, "der die", "de", None, 2, None)], "doc_id long, text string, lang string, source string, k0 int, language string")
    out = li.accepted(df, li.documents_input())
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "the thing", "en", "s", 1, "x"), (3, "der die", "de", None, 2, None)], key=repr)
    assert li.accepted(df.limit(0), li.documents_input()).count() == 0


FIFTH = {
    "fi": "kuitenkin yöllä järven yli lensivät hiljaa valkoiset joutsenet ja kylän väki nukkui lämpimissä tuvissaan kunnes aamu koitti",
    "pl": "wczesnym rankiem przyszedł do miasta młody człowiek który szukał swojego brata zaginionego przed wieloma laty wśród obcych ludzi",
    "ru": "рано утром в город пришел молодой человек который искал своего брата пропавшего много лет назад среди чужих людей",
    "zh": "很久以前在一座大山的脚下住着一位老人和他的三个儿子他们每天都到田里去劳动",
}


def test_languages_of_no_profile_are_rejected(spark):
    """Texts of a fifth language, declared as one of the four or as none, go; the documents of the table stay but for wordless ones."""
    docs = table(spark, SF, "documents")
    more = [(10_000 + i, t, d, "web", len(t)) for i, (t, d) in enumerate((t, d) for t in FIFTH.values() for d in (None, "en"))]
    both = docs.unionByName(spark.createDataFrame(more, docs.schema))
    stay = {r.doc_id for r in li.accepted(both, li.documents_input()).collect()}
    assert not stay & {m[0] for m in more}
    with_words = {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert len(with_words - stay) <= 0.01 * len(with_words)


@pytest.mark.parametrize("few", [100_000, 0])
def test_accepted_keeps_repeated_rows_and_columns_of_any_name(spark, monkeypatch, few):
    monkeypatch.setattr(li, "BROADCAST_ROWS", few)
    long = "the thing of the other land " * 3000
    rows = [(1, "the thing", "en", "s", 1, 2, 3), (1, "the thing", "en", "s", 1, 2, 3), (None, "the thing", None, None, 4, 5, 6), (5, long, "en", "s", 7, 8, 9), (6, "", "en", "s", 1, 1, 1), (7, "?!", "en", "s", 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _id0 int, _text int, c0 int")
    assert sorted(map(tuple, li.accepted(df, li.documents_input()).collect()), key=repr) == sorted(rows[:4], key=repr)
