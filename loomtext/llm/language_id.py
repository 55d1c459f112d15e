"""Language by Bayesian evidence fusion.

The posterior of a language is in proportion to the product of
* the likelihood of the text: hashed byte trigrams, counted by declared language over all rows, with a share of EVEN
  for all of them alike; it is tempered to
  EVIDENCE trigrams at most, as neighbouring trigrams are not independent;
* the likelihood of the declared language (a lang attribute or a column): how often each is declared on texts of
  each language, by grouped aggregation;
* the likelihood of a country suffix of the address (SUFFIX_RIGHT for its languages);
* the prior of the host, smoothed towards that of its suffix, which is smoothed towards that of all rows. The counts
  are sums of text posteriors by host and by suffix, without the row's own.

A row is accepted if its text has a trigram with a letter, the best posterior is LEAST or more, and the text is better explained by one
of the languages, or by all of them mixed, than by none: a background in which all trigrams are alike, with a prior of
FOREIGN. Texts go through two passes, for the profiles and for the evidence; all that follows
works on a few numbers for each row, and `accepted` leaves out of the table the rows whose hash is that of a row it
rejects (equal rows have equal results), so texts are never shuffled by host.

Defined results: null and empty texts, and texts without letters, get the language that the other evidence says, and
are not accepted; null, empty or unknown declarations, hosts and suffixes say nothing; equal posteriors go to the
first of `languages`; repeated rows count each time; other columns, whatever their names, are kept by `accepted` and
ignored by `identify`.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import column_bytes, freeing, text_chunks
from loomtext.session import kept, stored

LANGUAGES = ("en", "de", "fr", "es")
FEATURES, EVIDENCE, LEAST, SMOOTH, SUFFIX_RIGHT, UNIT, FOREIGN, EVEN = 1 << 14, 150, 0.5, 20.0, 0.7, 1_000_000, 0.01, 0.02
#: Languages of country suffixes.
COUNTRY = {"de": ("de",), "at": ("de",), "ch": ("de", "fr"), "fr": ("fr",), "be": ("fr",), "es": ("es",), "mx": ("es",), "ar": ("es",), "uk": ("en",), "us": ("en",), "au": ("en",), "ie": ("en",)}

_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]+)", re.I)
_META = re.compile(r"<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([A-Za-z]+)", re.I)
_DROP = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.I | re.S)
_TAG = re.compile(r"<[^>]*>")


def markup(page: str) -> tuple[str | None, str]:
    """The language that a page declares, and its text."""
    m = _LANG.search(page) or _META.search(page)
    return (m[1].lower() if m else None), html.unescape(_TAG.sub(" ", _DROP.sub(" ", page)))


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def suffix(host: Column) -> Column:
    return F.when(host.contains("."), F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lit("")))


def _classes() -> np.ndarray:
    """Letters in lower case, other ASCII as one, bytes of other characters as they are."""
    t = np.arange(256, dtype=np.uint32)
    t[:128] = 32
    t[97:123] = t[65:91] = np.arange(97, 123)
    return t


CLASS = _classes()


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature of the trigram at each byte, and whether there is one: within its text and with a letter."""
    c = CLASS[buf]
    c = np.concatenate([c, np.full(2, 32, np.uint32)])
    a, b, d = c[:-2], c[1:-1], c[2:]
    with np.errstate(over="ignore"):
        f = ((a << np.uint32(16) | b << np.uint32(8) | d) * np.uint32(0x9E3779B1)) >> np.uint32(18)
    ok = (a != 32) | (b != 32) | (d != 32)
    for k in (1, 2):
        at = offsets[1:] - k
        ok[at[at >= offsets[:-1]]] = False
    return f, ok


@dataclass(frozen=True)
class Input:
    """Columns of a table: text (or markup), a declared language, a host and a suffix; None where there is none."""

    text: str
    is_markup: bool = False
    declared: Column | None = None
    host: Column | None = None
    suffix: Column | None = None

    def columns(self) -> dict[str, Column]:
        """What a result follows from, as columns of the table."""
        none = F.lit(None).cast("string")
        pick = lambda c: none if c is None else F.nullif(F.lower(c.cast("string")), F.lit(""))
        return {"_text": F.col(self.text), "_declared": pick(self.declared), "_host": pick(self.host), "_suffix": pick(self.suffix)}

    def rows(self, df: DataFrame, keep: list[str], *more: Column) -> DataFrame:
        own = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
        return df.select(*own, *more, *(c.alias(x) for x, c in self.columns().items()), F.lit(self.is_markup).alias("_markup"))


def _plain(t: pa.Table, languages: tuple[str, ...]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Declared languages (None if not among languages), text bytes and offsets."""
    declared, col = t["_declared"].to_pylist(), t["_text"]
    if any(t["_markup"].to_pylist()):
        out = []
        for i, (page, is_markup) in enumerate(zip(col.to_pylist(), t["_markup"].to_pylist(), strict=True)):
            if is_markup and page is not None:
                declared[i], page = markup(page)
            out.append(page)
        col = pa.array(out, pa.string())
    return [d if d in languages else None for d in declared], *column_bytes(col)


def profiles(rows: list[DataFrame], languages: tuple[str, ...]) -> np.ndarray:
    """log P(feature | language), from the rows that declare it."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(languages), FEATURES), np.int64)
        for t in text_chunks(batches, "_text"):
            declared, buf, offsets = _plain(t, languages)
            f, ok = features(buf, offsets)
            code = np.repeat([languages.index(d) if d else -1 for d in declared], np.diff(offsets))
            ok &= code >= 0
            n += np.bincount(code[ok] * FEATURES + f[ok], minlength=n.size).reshape(n.shape)
        at = np.flatnonzero(n.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n.ravel()[at])], names=["at", "n"])

    n = np.zeros(len(languages) * FEATURES)
    parts = [r.select("_text", "_markup", "_declared").mapInArrow(freeing(count), "at int, n long") for r in rows]
    for r in reduce(DataFrame.unionByName, parts).groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row for each language and feature at most
        n[r["at"]] = r["n"]
    n = n.reshape(len(languages), FEATURES) + 0.5
    # A share goes to all features alike, so that what a profile has not seen costs the same however large the corpus is.
    return np.log((1 - EVEN) * n / n.sum(1, keepdims=True) + EVEN / FEATURES)


def mixed(logp: np.ndarray) -> np.ndarray:
    """log P(feature) for texts in all of the languages."""
    return np.log(np.exp(logp).mean(0))


def text_evidence(t: pa.Table, logp: np.ndarray, languages: tuple[str, ...]) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]:
    """For each text the language that it declares, its trigrams, the posteriors of the text alone, and the probability that it is in one of the languages."""
    declared, buf, offsets = _plain(t, languages)
    f, ok = features(buf, offsets)
    full = np.flatnonzero(np.diff(offsets) > 0)
    n, s = np.zeros(len(declared), np.int64), np.zeros((len(declared), len(languages) + 1))
    if len(full):
        n[full] = np.add.reduceat(ok.astype(np.int64), offsets[full])
        for k, row in enumerate([*logp, mixed(logp)]):
            s[full, k] = np.add.reduceat(np.where(ok, row[f], 0.0), offsets[full])
    s *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
    odds = np.clip(s.max(1) + np.minimum(n, EVIDENCE) * np.log(FEATURES) + np.log(1 / FOREIGN - 1), -700, 700)
    s = s[:, :-1]
    p = np.exp(s - s.max(1, keepdims=True))
    return declared, n, np.round(p / p.sum(1, keepdims=True), 9), np.round(1 / (1 + np.exp(-odds)), 9)


def evidence(rows: DataFrame, logp: np.ndarray, languages: tuple[str, ...]) -> DataFrame:
    """rows without their texts, with _declared among languages, _n (trigrams), _text_p, the posteriors of the text alone, and _known, the probability of any of the languages."""
    fields = [f for f in rows.schema.fields if f.name not in ("_markup", "_text")]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("_n", T.LongType()), T.StructField("_text_p", T.ArrayType(T.DoubleType())), T.StructField("_known", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_chunks(batches, "_text"):
            declared, n, p, known = text_evidence(t, logp, languages)
            out = t.select(names).set_column(names.index("_declared"), "_declared", pa.array(declared, pa.string()))
            yield from out.append_column("_n", pa.array(n)).append_column("_text_p", pa.array(list(p), pa.list_(pa.float64()))).append_column("_known", pa.array(known)).to_batches()

    return rows.mapInArrow(freeing(run), schema)


@dataclass(frozen=True)
class Priors:
    """Sums of text posteriors, in units of 1 / UNIT so that they do not depend on the order of rows."""

    hosts: DataFrame
    suffixes: DataFrame
    every: list[int]
    declared: dict[str, list[int]]

    def joined(self, rows: DataFrame) -> DataFrame:
        """rows (without texts) with _by_host and _by_suffix."""
        return named(named(rows, "_host", self.hosts, "_h"), "_suffix", self.suffixes, "_s")


#: Rows of names or hashes and a few numbers that are broadcast at most; beyond, the join is by a shuffle in which each name has SALTS parts.
BROADCAST_ROWS, SALTS = 100_000, 32


def named(rows: DataFrame, column: str, sums: DataFrame, name: str) -> DataFrame:
    """rows with the columns of the row of sums whose `name` is their `column`, if there is one."""
    if sums.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(sums), rows[column] == sums[name], "left").drop(name)
    # The part goes by the place of the row: rows are of a written table, in which it stays the same.
    rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    sums = sums.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(sums, (rows[column] == sums[name]) & (rows["_salt"] == sums["_part"]), "left").drop(name, "_salt", "_part")


def priors(ev: DataFrame, languages: tuple[str, ...]) -> Priors:
    """Grouped sums of the rows whose text has a trigram."""
    ev = ev.where("_n > 0")
    units = [F.round(F.col("_text_p")[k] * UNIT).cast("long") for k in range(len(languages))]
    sums = [F.sum(u).alias(f"n{k}") for k, u in enumerate(units)]
    pack = lambda name: F.array(*(F.col(f"n{k}") for k in range(len(languages)))).alias(name)
    hosts = kept(ev.where("_host is not null").groupBy(F.col("_host").alias("_h")).agg(*sums).select("_h", pack("_by_host")))
    suffixes = kept(ev.where("_suffix is not null").groupBy(F.col("_suffix").alias("_s")).agg(*sums).select("_s", pack("_by_suffix")))
    every = ev.agg(*sums).first()
    declared = ev.where("_declared is not null").groupBy("_declared").agg(*sums).collect()  # a row for each language
    return Priors(hosts, suffixes, [x or 0 for x in every], {r["_declared"]: [r[f"n{k}"] for k in range(len(languages))] for r in declared})


class Fusion:
    """The posterior of rows from their evidence and the sums."""

    def __init__(self, pr: Priors, languages: tuple[str, ...]):
        size = len(languages)
        self.languages, self.every = languages, np.array(pr.every, float)
        said = np.array([pr.declared.get(d, [0] * size) for d in languages], float) / UNIT
        self.said = {d: np.log((said[i] + np.where(np.arange(size) == i, 5, 1)) / (said.sum(0) + size + 4)) for i, d in enumerate(languages)}
        self.where = {}
        for s, spoken in COUNTRY.items():
            known = [x for x in spoken if x in languages]
            if known and len(known) < size:
                self.where[s] = np.log(np.array([SUFFIX_RIGHT / len(known) if x in known else (1 - SUFFIX_RIGHT) / (size - len(known)) for x in languages]))

    def posteriors(self, text_p: np.ndarray, n: np.ndarray, declared: list, suffixes: list, by_host: list, by_suffix: list) -> np.ndarray:
        size, none = len(self.languages), np.zeros(len(self.languages))
        # The row's own share in the sums is left out; rows without trigrams have none.
        own = np.where((n > 0)[:, None], np.floor(text_p * UNIT + 0.5), 0)

        def smoothed(sums: np.ndarray, has: np.ndarray, towards: np.ndarray) -> np.ndarray:
            c = np.maximum(0, (sums - np.where(has, own, 0)) / UNIT)
            return (c + SMOOTH * towards) / (c.sum(1, keepdims=True) + SMOOTH)

        def level(found: list) -> tuple[np.ndarray, np.ndarray]:
            has = np.array([x is not None for x in found], bool)[:, None]
            return np.array([none if x is None else x for x in found], float).reshape(-1, size), has

        prior = smoothed(self.every[None, :], np.ones((len(n), 1), bool), np.full((1, size), 1 / size))
        prior = smoothed(*level(by_suffix), prior)
        prior = smoothed(*level(by_host), prior)
        score = np.log(np.maximum(text_p, 1e-9)) + np.log(prior)
        score += np.array([self.said.get(d, none) for d in declared]).reshape(-1, size)
        score += np.array([self.where.get(s, none) for s in suffixes]).reshape(-1, size)
        odds = np.exp(score - score.max(1, keepdims=True, initial=-np.inf))
        return np.round(odds / odds.sum(1, keepdims=True), 6)


def fused(ev: DataFrame, pr: Priors, languages: tuple[str, ...], keep: list[str]) -> DataFrame:
    """Columns `keep` of ev with language, confidence, accepted, posteriors and known."""
    out = [("language", T.StringType()), ("confidence", T.DoubleType()), ("accepted", T.BooleanType()), ("posteriors", T.ArrayType(T.DoubleType())), ("known", T.DoubleType())]
    inner = [f"k{i}" for i in range(len(keep))]
    schema = T.StructType([*(T.StructField(i, ev.schema[c].dataType) for i, c in zip(inner, keep, strict=True)), *(T.StructField(f"o{i}", t) for i, (_, t) in enumerate(out))])
    fusion = Fusion(pr, languages)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, p, known = b["_n"].to_numpy(), np.array(b["_text_p"].to_pylist(), float), b["_known"].to_numpy()
            q = fusion.posteriors(p, n, b["_declared"].to_pylist(), b["_suffix"].to_pylist(), b["_by_host"].to_pylist(), b["_by_suffix"].to_pylist())
            best, sure = q.argmax(1), q.max(1)
            ok = (n > 0) & (sure >= LEAST) & (known >= 0.5)
            new = [pa.array([languages[x] for x in best], pa.string()), pa.array(sure), pa.array(ok), pa.array(list(q), pa.list_(pa.float64())), pa.array(known)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *new], names=schema.names)

    return pr.joined(ev).mapInArrow(freeing(run), schema).toDF(*keep, *(name for name, _ in out))


def identify(tables: list[tuple[DataFrame, Input, list[str]]], languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """For each row of the tables its kept columns (by name; null in other tables), language, confidence, accepted, posteriors and known."""
    names = list(dict.fromkeys(c for _, _, keep in tables for c in keep))
    rows = [i.rows(df, keep) for df, i, keep in tables]
    logp = profiles(rows, languages)
    parts = []
    for (df, _, keep), r in zip(tables, rows, strict=True):
        e = evidence(r, logp, languages)
        own = [F.col(f"k{keep.index(c)}").alias(f"i{j}") if c in keep else F.lit(None).cast(next(x.schema[c].dataType for x, _, k in tables if c in k)).alias(f"i{j}") for j, c in enumerate(names)]
        parts.append(e.select(*own, "_declared", "_host", "_suffix", "_n", "_text_p", "_known"))
    ev = stored(reduce(DataFrame.unionByName, parts), "evidence")
    out = fused(ev, priors(ev, languages), languages, [f"i{j}" for j in range(len(names))])
    return out.toDF(*names, *out.columns[len(names) :])


def accepted(df: DataFrame, source: Input, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """The accepted rows of df, with all their columns."""
    # 128 bits of what a result follows from.
    inputs = [x for c in source.columns().values() for x in (c, c.isNull())]
    ids = [F.xxhash64(F.lit(i), *inputs).alias(f"_id{i}") for i in (0, 1)]
    rows = source.rows(df, [], *ids)
    logp = profiles([rows], languages)
    ev = stored(evidence(rows, logp, languages), "evidence")
    gone = kept(fused(ev, priors(ev, languages), languages, ["_id0", "_id1"]).where("not accepted").select("_id0", "_id1").distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    own = [f"c{i}" for i in range(len(df.columns))]
    whole = df.select(*(F.col(c).alias(i) for c, i in zip(df.columns, own, strict=True)), *ids)
    return whole.join(gone, ["_id0", "_id1"], "left_anti").select(*own).toDF(*df.columns)


def documents_input() -> Input:
    """documents: lang is what the row declares, source is its host."""
    return Input("text", declared=F.col("lang"), host=F.col("source"))


def pages_input() -> Input:
    """pages: the markup declares the language, the url gives host and suffix."""
    return Input("html", is_markup=True, host=host(F.col("url")), suffix=suffix(host(F.col("url"))))
