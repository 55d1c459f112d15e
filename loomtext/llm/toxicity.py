"""Toxicity scores of restored text.

Writers hide words by leetspeak (1d10t), spacing (i d i o t, i.d.i.o.t) and repetition (stuuupid). A token that may be
hidden becomes a lattice: each symbol offers the letters it can stand for, nothing (noise) or itself, runs of three
or more of a letter offer one or two, separators offer a gap or nothing, each at the cost that the channel gives it.
Viterbi's algorithm finds the best path under a character trigram model, which is counted over all texts. Tokens of
letters alone without such runs have one path and are left as they are.

A logistic regression scores the restored words. Its words are all those of LEAST_COUNT documents or more whose
presence tells toxic from other documents by the likelihood ratio statistic, at a false discovery rate of FALSE
(Benjamini and Hochberg): the threshold follows from how many words are tested and how many pass, so that words of
languages with few labels count as soon as the labels bear them out. It is fitted on a sample of SAMPLE labelled
documents of the training folds (those with the smallest hashes of doc_id); the labels of held-out documents, lang,
source and doc_id are no inputs. All documents are scored, over their whole texts.

Defined results: null and empty texts have the score of no word; null labels and labels without document are ignored;
a document with two labels is toxic if one is; without labels, or with labels of one kind, the score is the smoothed
share of toxic ones; rows with null doc_id count to fold crc32('') = 0 and are held out; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import column_bytes, freeing, text_chunks

SAMPLE, LEAST_COUNT, FALSE, RIDGE, FOLDS = 20_000, 3, 0.1, 0.5, 5
CHUNK, KNOWN = 8 << 20, 1 << 16

#: Letters that a symbol can stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Costs of the channel, as natural logarithms: a symbol for a letter, a symbol that is noise, a digit that is one, one
#: or two letters for a run, and a gap between spaced letters that is one between words.
AS_LETTER, NOISE, AS_DIGIT, ONE, TWO, GAP = -0.7, -9.0, -9.0, -0.5, -1.5, -5.0

ALPHABET = 28  # no letter, a to z, any other letter
_HIDDEN = re.compile(r"[^a-zÀ-\U0010ffff]|(.)\1\1")
_PARTS = re.compile(r"[-_'’/.,:;~]+")
#: Single symbols with one or two white-space characters between, line breaks and no-break spaces among them.
_SPACED = re.compile(r"(?<!\S)\S(?:\s{1,2}\S){2,}(?!\S)")
_EDGES = re.compile(r"^(?:(?![@$])[\W_])+|[\W_]+$")


def letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def _classes() -> np.ndarray:
    """Classes of bytes; all bytes of other letters count as one each."""
    t = np.zeros(256, np.int32)
    t[97:123] = t[65:91] = np.arange(1, 27)
    t[128:] = 27
    return t


CLASS = _classes()


def trigrams(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) of letter classes over all texts; the sums have one row for each trigram."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(ALPHABET**3, np.int64)
        for t in text_chunks(batches):
            buf, offsets = column_bytes(t["text"])
            c = CLASS[buf]
            # Texts count as parted by a byte that is no letter; runs of these as one.
            c = np.insert(c, offsets, 0)
            c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
            if len(c) > 2:
                n += np.bincount((c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], names=["at", "n"])

    n = np.zeros(ALPHABET**3)
    for r in docs.select("text").mapInArrow(freeing(count), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 28 ** 3 rows
        n[r["at"]] = r["n"]
    n = n.reshape(ALPHABET, ALPHABET, ALPHABET) + 0.05
    return np.log(n / n.sum(2, keepdims=True))


class Decoder:
    def __init__(self, logp: np.ndarray):
        self.logp = logp.tolist()
        self.known: dict[str, str] = {}

    @staticmethod
    def lattice(s: str) -> list[list[tuple[str, float]]]:
        """For each symbol, or run of one letter, what it can be, with its cost."""
        out: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(s):
            c, j = s[i], i
            while j < len(s) and s[j] == c:
                j += 1
            n = j - i
            if c == " ":
                out.append([(" ", GAP), ("", 0.0)])
            elif c in LEET:
                for _ in range(min(n, 2)):
                    keep = [(c, AS_DIGIT)] if c.isdigit() else []
                    out.append([(x, AS_LETTER) for x in LEET[c]] + [("", NOISE)] + keep)
            elif c.isalpha():
                out += [[(c, ONE), (c + c, TWO)]] if n > 2 else [[(c, 0.0)]] * n
            elif c.isdigit():
                out += [[(c, 0.0)]] * n
            else:
                out.append([("", 0.0)])
            i = j
        return out

    def decode(self, s: str) -> str:
        """The best path through the lattice of s; short tokens come again and again, up to KNOWN of them are kept."""
        best = self.known.get(s)
        if best is None:
            best = self.best_path(s)
            if len(self.known) < KNOWN and len(s) < 64:
                self.known[s] = best
        return best

    def best_path(self, s: str) -> str:
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        logp = self.logp
        for options in [*self.lattice(s), [(" ", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, path) in states.items():
                for text, cost in options:
                    x, y, total = a, b, score + cost
                    for c in text:
                        k = letter(c)
                        if k or y:  # a second gap after a gap says nothing
                            total += logp[x][y][k]
                            x, y = y, k
                    if (x, y) not in new or total > new[x, y][0]:
                        new[x, y] = total, (path, text)
            states = new
        _, path = max(states.values(), key=lambda v: v[0])
        out = []
        while path:
            path, text = path
            out.append(text)
        return "".join(reversed(out)).strip()

    def restore(self, token: str) -> list[str]:
        """The words of a token without white space, in lower case."""
        t = token.lower()
        if not _HIDDEN.search(t):
            return [t]
        # Marks around a word say nothing, but for one that may be its first letter.
        i, j = 0, len(t)
        while j > i and not t[j - 1].isalnum():
            j -= 1
        while i < j and not t[i].isalnum() and not (t[i] in "@$!|+(" and i + 1 < j and t[i + 1].isalpha() and (i == 0 or t[i - 1] != t[i])):
            i += 1
        t = t[i:j]
        if not any(c.isalpha() for c in t) and not (len(t) > 2 and (any(c in "@$!|+(" for c in t) or all(c in LEET for c in t))):
            return []
        if not _HIDDEN.search(t):
            return [t]
        parts = [p for p in _PARTS.split(t) if p]
        if len(parts) > 2 and all(len(p) == 1 for p in parts):
            return self.decode(" ".join(parts)).split()
        return [w for p in parts for w in ([p] if not _HIDDEN.search(p) else self.decode(p).split())]

    def spaced(self, text: str) -> list[str]:
        """Words of runs of single symbols with spaces between."""
        out = []
        for m in _SPACED.finditer(text):
            run = _EDGES.sub("", " ".join(m[0].lower().split()))
            if len(run) > 4:
                out += self.decode(run).split()
        return out

    def restore_text(self, text: str) -> str:
        """A whole text with its tokens restored."""
        rest = _SPACED.sub(" ", text)
        return " ".join([*chain.from_iterable(map(self.restore, rest.split())), *self.spaced(text)])


class Restored:
    """Restored words of the distinct tokens of some texts."""

    def __init__(self, d: Decoder):
        self.d, self.known = d, {}

    def words(self, token: bytes) -> list[str]:
        w = self.known.get(token)
        if w is None:
            w = self.known[token] = self.d.restore(token.decode())
        return w


def _texts(t: pa.Table) -> list[bytes]:
    buf, offsets = column_bytes(t["text"])
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def word_sets(docs: DataFrame, decoder: Decoder, extra: str) -> tuple:
    """A function from batches of (text, label) to (label, distinct restored words) of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, set[str]]]:
        for t in text_chunks(batches, "text", CHUNK):
            r = Restored(decoder)
            for text, label in zip(_texts(t), t[extra].to_pylist(), strict=True):
                yield label, {w for x in set(text.split()) for w in r.words(x)}.union(decoder.spaced(text.decode()))

    return (run,)


def g2(a: float, b: float, n1: float, n0: float) -> float:
    """Likelihood ratio statistic of a word that a of n1 toxic and b of n0 other documents have."""
    total, out = n1 + n0, 0.0
    for x, row, col in ((a, a + b, n1), (b, a + b, n0), (n1 - a, total - a - b, n1), (n0 - b, total - a - b, n0)):
        if x > 0:
            out += 2 * x * math.log(x * total / (row * col))
    return out


def threshold(groups: list[tuple[float, int]]) -> float:
    """The least statistic that passes at a false discovery rate of FALSE, of (statistic, number of words with it)."""
    m, k, least = sum(n for _, n in groups), 0, math.inf
    for stat, n in sorted(groups, reverse=True):
        k += n
        if math.erfc(math.sqrt(max(0.0, stat) / 2)) <= FALSE * k / m:
            least = stat
    return least


def logistic(row: np.ndarray, col: np.ndarray, d: int, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights, the first of them the intercept, where x is 1 at (row, col) and has d columns: Newton's method with a
    ridge on all others, its steps by conjugate gradients."""
    times = lambda w: w[0] + np.bincount(row, w[1:][col], len(y))
    back = lambda v: np.concatenate([[v.sum()], np.bincount(col, v[row], d)])
    ridge = np.full(d + 1, RIDGE)
    ridge[0] = 1e-6
    w = np.zeros(d + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        h = n * p * (1 - p)
        left, diagonal, step = back(n * (y - p)) - ridge * w, back(h) + ridge, np.zeros(d + 1)
        to = left / diagonal
        size = left @ to
        for _ in range(500):
            if size < 1e-20:
                break
            moved = back(h * times(to)) + ridge * to
            far = size / (to @ moved)
            step += far * to
            left -= far * moved
            size, before = left @ (left / diagonal), size
            to = left / diagonal + size / before * to
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, decoder: Decoder) -> tuple[float, dict[str, float]]:
    """Intercept and weights of words, from a sample of labelled documents of the training folds."""
    known = labels.where((fold(F.col("doc_id")) != 0) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "label")  # SAMPLE rows
    (sets,) = word_sets(docs, decoder, "label")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = Counter(), Counter()
        for label, words in sets(batches):
            n[label > 0].update(words)
            n[label > 0][""] += 1  # the documents themselves
        words = list(n[0] | n[1])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([n[1][w] for w in words], pa.int64()), pa.array([n[0][w] for w in words], pa.int64())], names=["word", "a", "b"])

    counts = sample.mapInArrow(freeing(count), "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") + F.col("b") >= LEAST_COUNT)
    same = counts.groupBy("a", "b", (F.col("word") == "").alias("all")).agg(F.count("*").alias("n")).collect()  # words of SAMPLE rows, by their counts
    n1, n0 = next(((r.a, r.b) for r in same if r["all"]), (0, 0))
    if not n1 or not n0:
        n1, n0 = n1 + 0.5, n0 + 0.5
        return math.log(n1 / n0), {}
    least = threshold([(g2(r.a, r.b, n1, n0), r.n) for r in same if not r["all"]])
    row, x_log_x = F.col("a") + F.col("b"), lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    cells = (F.col("a"), F.col("b"), n1 - F.col("a"), n0 - F.col("b"), F.lit(float(n1 + n0)))
    margins = (row, n1 + n0 - row, F.lit(float(n1)), F.lit(float(n0)))
    stat = 2 * (sum((x_log_x(x.cast("double")) for x in cells), F.lit(0.0)) - sum((x_log_x(x.cast("double")) for x in margins), F.lit(0.0)))
    best = counts.where("word <> ''").withColumn("g2", stat).where(F.col("g2") >= least - 1e-6).orderBy(F.desc("g2"), "word")
    words = [r.word for r in best.collect()]
    number = {w: i for i, w in enumerate(words)}

    def patterns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Counter((label, tuple(sorted(number[w] for w in found if w in number))) for label, found in sets(batches))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.int32()), pa.array([list(k[1]) for k in n], pa.list_(pa.int32())), pa.array(n.values(), pa.int64())], names=["label", "has", "n"])

    rows = sample.mapInArrow(freeing(patterns), "label int, has array<int>, n long").groupBy("label", "has").agg(F.sum("n").alias("n")).collect()  # SAMPLE rows at most
    at = np.repeat(np.arange(len(rows)), [len(r["has"]) for r in rows])
    has = np.fromiter(chain.from_iterable(r["has"] for r in rows), np.int64)
    w = logistic(at, has, len(words), np.array([float(r["label"] > 0) for r in rows]), np.array([float(r["n"]) for r in rows]))
    return float(w[0]), dict(zip(words, w[1:].tolist(), strict=True))


def score(docs: DataFrame, decoder: Decoder, intercept: float, weights: dict[str, float]) -> DataFrame:
    """doc_id, held_out, score, predicted and hits (the words that count, restored)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_chunks(batches, "text", CHUNK):
            texts = _texts(t)
            split = [x.split() for x in texts]
            hot = {}
            for token in set().union(*split):
                if found := [w for w in decoder.restore(token.decode()) if w in weights]:
                    hot[token] = found
            hits = []
            for text, words in zip(texts, split, strict=True):
                found = {w for x in hot.keys() & words for w in hot[x]} if hot else set()
                found.update(w for w in decoder.spaced(text.decode()) if w in weights)
                hits.append(sorted(found))
            s = [1 / (1 + math.exp(-max(-700.0, min(700.0, intercept + sum(weights[w] for w in h))))) for h in hits]
            out = pa.table({"doc_id": t["doc_id"], "held_out": t["held_out"], "score": pa.array(s, pa.float64()), "predicted": pa.array([int(x >= 0.5) for x in s], pa.int32()), "hits": pa.array(hits, pa.list_(pa.string()))})
            yield from out.to_batches()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    return rows.mapInArrow(freeing(run), "doc_id long, held_out boolean, score double, predicted int, hits array<string>")


def train_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    decoder = Decoder(trigrams(docs))
    return score(docs, decoder, *train(docs, labels, decoder))
