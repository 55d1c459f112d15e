"""Deletes later copies of repeated runs of lines, by a suffix array over line ids built by prefix doubling.

Lines with a word are the symbols; a line's id is 128 bits of hash of its bytes without white space around them. A
suffix starts at each line that occurs twice or more and ends before the first line that does not, as no common
prefix passes a line that occurs once. Round k sorts the suffixes by their first 2**(k + 1) lines: the distinct pairs
of ranks (of the suffix, of the suffix 2**k lines on) are counted, sorted by range and numbered in that order, and
suffixes whose pair occurs once leave the array.

What is deleted: each line that lies in a run of at least `min_words` words of which an earlier copy exists (earlier
by doc_id, then by hash of the text, then by place). The suffixes with a common prefix of m lines are one interval of
the array, named by m and the ranks of the first and the last 2**k lines of the prefix, 2**k <= m < 2**(k + 1); its
first suffix in text order is the copy that stays. A maximal repeated run is covered by its shortest parts with
`min_words` words that start or that end at each line, and so intervals of the lengths of these parts alone are
asked for; no part has more than `min_words` lines, which bounds the rounds by its logarithm whatever the corpus.

Defined results: null texts stay null, empty ones empty, with 0 lines; lines without words are in no run, and go with
the line before them; rows equal in doc_id and text are one document (neither is a later copy of the other, both get
the same result); null doc_ids come first; other columns, whatever their names, are kept by `deduplicated`, but for
those named like its own results (n_lines, n_removed, removed), which these replace.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import freeing, text_chunks
from loomtext.session import stored

MIN_WORDS = 30
POS = ["doc_id", "text_hash", "p"]


def shortest_parts(words: list[int], least: int) -> list[list[int]]:
    """For each line the lengths of the shortest parts with `least` words that start there and that, from some line on, end soonest before it."""
    sums = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    out: list[set[int]] = [set() for _ in range(n)]
    ends = np.searchsorted(sums, sums[:-1] + least)
    starts = np.searchsorted(sums, sums[1:] - least, side="right") - 1
    for s in range(n):
        if ends[s] <= n:
            out[s].add(int(ends[s]) - s)
        if starts[s] >= 0:
            out[int(starts[s])].add(s + 1 - int(starts[s]))
    return [sorted(x) for x in out]


def lines(docs: DataFrame, least: int) -> DataFrame:
    """A row for each line with words: its place p among them, its id (a, b), and the lengths of the parts that start there."""
    names = ["doc_id", "text_hash", "p", "a", "b", "parts"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_chunks(batches, "text", 4 << 20):
            ids, hashes, place, digests, parts = [], [], [], [], []
            for d, h, text in zip(t["doc_id"].to_pylist(), t["text_hash"].to_pylist(), t["text"].cast(pa.large_binary()).to_pylist(), strict=True):
                counts = []
                for line in (text or b"").split(b"\n"):
                    if n := len(line.split()):
                        counts.append(n)
                        digests.append(hashlib.blake2b(line.strip(), digest_size=16).digest())
                parts += shortest_parts(counts, least)
                ids += [d] * len(counts)
                hashes += [h] * len(counts)
                place += range(len(counts))
            ab = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            cols = [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(place, pa.int32()), pa.array(ab[:, 0]), pa.array(ab[:, 1]), pa.array(parts, pa.list_(pa.int32()))]
            yield from pa.table(cols, names=names).to_batches(max_chunksize=20_000)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(freeing(run), "doc_id long, text_hash long, p int, a long, b long, parts array<int>")


def ranked(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Ranks of the pairs that occur more than once, in their order."""
    pairs = rows.groupBy(a, b).agg(F.count("*").alias("n")).where("n > 1").select(a, b)
    return stored(pairs.orderBy(a, b).withColumn("number", F.monotonically_increasing_id()), name)


def repeated_parts(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, text_hash, p, m): parts of m lines from p on of which an earlier copy exists."""
    rows = stored(lines(docs, least), "lines")
    suffixes = rows.join(ranked(rows, "a", "b", "ranks-0"), ["a", "b"]).select(*POS, "parts", F.col("number").alias("rank"))
    found, k = [], 0
    while True:
        step = 1 << k
        ahead = Window.partitionBy("doc_id", "text_hash").orderBy("p").rangeBetween(0, step)
        s = suffixes.withColumn("ahead", F.collect_list(F.struct("p", "rank")).over(ahead))
        at = lambda place: F.get(F.filter("ahead", lambda x: x["p"] == place), 0)["rank"]
        here = F.filter("parts", lambda m: (m >= step) & (m < 2 * step))
        s = s.withColumn("asked", F.transform(here, lambda m: F.struct(m.alias("m"), at(F.col("p") + m - step).alias("last"))))
        s = s.withColumn("on", at(F.col("p") + step)).withColumn("longer", F.exists("parts", lambda m: m >= 2 * step))
        s = stored(s.select(*POS, "parts", "rank", "on", "longer", F.filter("asked", lambda x: x["last"].isNotNull()).alias("asked")), f"suffixes-{k}")
        found.append(s.where(F.size("asked") > 0).select(*POS, F.col("rank").alias("first"), F.inline("asked")))
        rest = s.where("on is not null").select(*POS, "parts", "rank", "on", "longer")
        if rest.where("longer").isEmpty():
            break
        longer = ranked(rest, "rank", "on", f"ranks-{k + 1}")
        suffixes = rest.join(longer, ["rank", "on"]).select(*POS, "parts", F.col("number").alias("rank"))
        k += 1
    asked = found[0]
    for f in found[1:]:
        asked = asked.unionByName(f)
    asked = stored(asked, "parts")
    place = F.struct("doc_id", "text_hash", "p")
    intervals = asked.groupBy("m", "first", "last").agg(F.min(place).alias("stays"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = asked.join(stored(intervals, "intervals"), ["m", "first", "last"]).where(place > F.col("stays"))
    return later.select(*POS, "m")


def deletions(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, text_hash, gone): places of the lines that go, of each document that has such; docs has doc_id, text_hash and text."""
    gone = repeated_parts(docs, least).select("doc_id", "text_hash", F.explode(F.sequence(F.col("p"), F.col("p") + F.col("m") - 1)).alias("p")).distinct()
    return stored(gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("p")).alias("gone")), "gone")


def deduplicated(docs: DataFrame, *, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with text without the lines that go, and n_lines (with words), n_removed and removed (their numbers among the lines with words)."""
    new = ["n_lines", "n_removed", "removed"]
    names = [c for c in docs.columns if c not in new]
    # Inner names, so that no column of docs clashes with those added here.
    keep = [f"c{i}" for i in range(len(names))]
    at, id_at = keep[names.index(text)], keep[names.index(doc_id)]
    own = docs.select(*names).toDF(*keep).withColumn("_id", F.col(id_at).cast("long")).withColumn("_hash", F.xxhash64(at))
    gone = deletions(own.select(F.col("_id").alias("doc_id"), F.col("_hash").alias("text_hash"), F.col(at).alias("text")), min_words)
    # Always by sorted shuffles, which AQE splits where they are uneven: the list of documents grows with the corpus.
    joined = own.join(gone.hint("merge"), own["_id"].eqNullSafe(gone["doc_id"]) & (own["_hash"] == gone["text_hash"]), "left").select(*keep, F.col("gone").alias("_gone"))
    schema = T.StructType([*own.select(*keep).schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in text_chunks(batches, at, 4 << 20):
            texts, counts = [], []
            for x, gone in zip(t[at].to_pylist(), t["_gone"].to_pylist(), strict=True):
                if x is None:
                    texts.append(None)
                    counts.append(0)
                    continue
                leave, stay, n, cut = set(gone or ()), [], 0, False
                for line in x.split("\n"):
                    if line.encode().split():
                        cut = n in leave
                        n += 1
                    if not cut:
                        stay.append(line)
                texts.append("\n".join(stay) if leave else x)
                counts.append(n)
            gone = t["_gone"].to_pylist()
            out = t.select(keep).set_column(keep.index(at), at, pa.array(texts, t[at].type))
            for name, values, kind in (("n_lines", counts, pa.int64()), ("n_removed", [len(g or ()) for g in gone], pa.int64()), ("removed", [g or [] for g in gone], pa.list_(pa.int32()))):
                out = out.append_column(name, pa.array(values, kind))
            yield from out.to_batches(max_chunksize=10_000)

    return joined.mapInArrow(freeing(run), schema).toDF(*names, *new)


def without_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs with their columns, texts deduplicated; those of which every line went are left out."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    out = deduplicated(docs.toDF(*own), text=own[docs.columns.index(text)], doc_id=own[docs.columns.index(doc_id)], min_words=min_words)
    return out.where((F.col("n_lines") == 0) | (F.col("n_removed") < F.col("n_lines"))).select(*own).toDF(*docs.columns)


SQL = rf"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
a AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM raw),
b AS (SELECT *, sum(CASE WHEN words > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS p FROM a),
l AS (SELECT doc_id, p, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line, words, sum(words) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM b WHERE words > 0),
w AS (
  SELECT s.doc_id, s.p, min(e.p) AS q FROM l s JOIN l e ON s.doc_id = e.doc_id AND e.p >= s.p AND e.upto - s.upto + s.words >= {MIN_WORDS} GROUP BY ALL
  UNION
  SELECT e.doc_id, max(s.p) AS p, e.p AS q FROM l e JOIN l s ON s.doc_id = e.doc_id AND e.p >= s.p AND e.upto - s.upto + s.words >= {MIN_WORDS} GROUP BY e.doc_id, e.p),
c AS (SELECT w.doc_id, w.p, w.q, md5(string_agg(line, chr(10) ORDER BY l.p)) AS content FROM w JOIN l ON l.doc_id = w.doc_id AND l.p BETWEEN w.p AND w.q GROUP BY w.doc_id, w.p, w.q),
f AS (SELECT *, min((doc_id, p)) OVER (PARTITION BY content) AS stays FROM c),
g AS (SELECT DISTINCT doc_id, unnest(range(CAST(p AS BIGINT), CAST(q + 1 AS BIGINT))) AS p FROM f WHERE (doc_id, p) > stays)
SELECT b.doc_id, coalesce(string_agg(b.line, chr(10) ORDER BY b.k) FILTER (WHERE g.p IS NULL), '') AS text,
  CAST(sum(CASE WHEN b.words > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_lines,
  CAST(sum(CASE WHEN b.words > 0 AND g.p IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
  coalesce(string_agg(CAST(b.p AS VARCHAR), ',' ORDER BY b.p) FILTER (WHERE b.words > 0 AND g.p IS NOT NULL), '') AS removed
FROM b LEFT JOIN g ON b.doc_id = g.doc_id AND b.p = g.p GROUP BY b.doc_id
"""
