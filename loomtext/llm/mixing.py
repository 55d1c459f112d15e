"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Each document has a 60-bit hash of its doc_id. A source whose target is t times its size takes every document
floor(t) times and, once more, those whose hash lies below a threshold. The threshold comes from histograms of
tokens by source and hash bucket: the bucket in which the rest of the budget ends is cut into finer buckets, and
only its rows are read again, until it holds one hash. Nothing sorts or shuffles the documents: what is known of
their source, one row each, is broadcast to them if its bytes are below SOURCE_BYTES; beyond, rows meet it by a
shuffle in which each source is salted. Thresholds nest: with a larger budget a source keeps what it took before.

Defined results: a null or empty text has size 0 and is taken with 0 words; a null source is a source of its own,
last in order; rows with the same doc_id (null ones too) share a hash and are taken or left together; the group
at the threshold is taken when that brings the source nearer its target; an empty table gives an empty result;
other columns, whatever their names, are ignored by `mix` and kept by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import kept

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
HASH_BITS, STEP_BITS = 60, 12
#: Bytes of names and numbers of all sources that are broadcast at most, and the parts of a source beyond.
SOURCE_BYTES, SALTS = 16 << 20, 64


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id, as SQL engines all have it."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """Targets of the sources: sources has _source and _size, one row for each.

    Sources by code point, null last, get the weights in turn and share the sum of all sizes; no target is above
    `cap` times its source's size. Sharing out the excess again and again ends where sources in ascending order of
    cap to weight are capped as long as the level they would get lies above their cap; the windows find that end.
    The table has one row for each source, so its window is small beside the documents.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("_weight", weight.cast("long")).withColumn("_cap", F.col("_size") * cap)
    s = s.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_ratio", F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total, all_weights = F.sum("_size").over(every), F.sum("_weight").over(every)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (all_weights - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
    s = s.withColumn("_capped", level >= F.col("_ratio"))
    rest = (total - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(every), F.lit(0))) / F.sum(F.when(~F.col("_capped"), F.col("_weight"))).over(every)
    return s.withColumn("_target", F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.col("_weight") * rest)).select("_source", "_size", "_target")


def small(sources: DataFrame) -> bool:
    """Whether a table with a row for each source (_source) can be broadcast; its rows have few numbers besides."""
    return (sources.agg(F.sum(F.coalesce(F.octet_length("_source"), F.lit(0)) + 64)).first()[0] or 0) <= SOURCE_BYTES


def at_source(rows: DataFrame, sources: DataFrame, broadcast: bool) -> DataFrame:
    """rows (_source, _hash or _bin, and others) with the columns of the row of sources that has their source; those without one go."""
    s = sources.withColumnRenamed("_source", "_s")
    if broadcast:
        return rows.join(F.broadcast(s), rows["_source"].eqNullSafe(s["_s"])).drop("_s")
    spread = F.pmod(F.col("_hash" if "_hash" in rows.columns else "_bin"), F.lit(SALTS)).cast("int")
    rows, s = rows.withColumn("_salt", spread), s.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(s, rows["_source"].eqNullSafe(s["_s"]) & (rows["_salt"] == s["_part"])).drop("_s", "_salt", "_part")


def thresholds(base: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """For each source of base (_source, _words, _hash): _size, _target, _times, and _edge and _edge_in: hashes below _edge are taken once more, that at _edge if _edge_in."""
    t = targets(base.groupBy("_source").agg(F.sum("_words").alias("_size")), weights, cap)
    times = F.when(F.col("_size") > 0, F.least(F.floor(F.col("_target") / F.col("_size")), F.lit(cap))).otherwise(F.lit(0)).cast("long")
    t = kept(t.withColumn("_times", times).withColumn("_rest", F.col("_target") - F.col("_times") * F.col("_size")))
    few = small(t)
    state = t.select("_source", "_rest", F.lit(0).cast("long").alias("_below"), F.lit(0).cast("long").alias("_prefix"))
    done = None
    for bits in range(STEP_BITS, HASH_BITS + 1, STEP_BITS):
        # Rows of the bucket that is still open; at first that is all rows.
        rows = base
        if bits > STEP_BITS:
            rows = at_source(base, state.select("_source", "_prefix"), few).where(F.shiftright("_hash", HASH_BITS - bits + STEP_BITS) == F.col("_prefix"))
        bins = rows.groupBy("_source", F.shiftright("_hash", HASH_BITS - bits).alias("_bin")).agg(F.sum("_words").alias("_w"), F.min("_hash").alias("_lo"), F.max("_hash").alias("_hi"))
        run = Window.partitionBy("_source").orderBy("_bin")
        found = at_source(bins.withColumn("_upto", F.sum("_w").over(run)), state, few)
        upto = F.col("_below") + F.col("_upto")
        edge = found.where((upto > F.col("_rest")) & (upto - F.col("_w") <= F.col("_rest")))
        edge = kept(edge.select("_source", "_rest", (upto - F.col("_w")).alias("_below"), F.col("_bin").alias("_prefix"), "_w", "_lo", "_hi"))
        ended = edge.where((F.col("_lo") == F.col("_hi")) | F.lit(bits == HASH_BITS))
        done = ended if done is None else done.unionByName(ended)
        state = edge.where((F.col("_lo") < F.col("_hi")) & F.lit(bits < HASH_BITS)).select("_source", "_rest", "_below", "_prefix")
        if state.isEmpty():
            break
    edge_in = 2 * F.col("_below") + F.col("_w") <= 2 * F.col("_rest")
    done = done.select(F.col("_source").alias("_s"), F.col("_lo").alias("_edge"), edge_in.alias("_edge_in"))
    out = t.join(done, t["_source"].eqNullSafe(done["_s"]), "left")
    # Without an edge the rest covers the whole source.
    whole = F.lit((1 << HASH_BITS) - 1).cast("long")
    return out.select("_source", "_size", "_target", "_times", F.coalesce("_edge", F.when(F.col("_rest") > 0, whole).otherwise(F.lit(-1).cast("long"))).alias("_edge"), F.coalesce("_edge_in", F.lit(True)).alias("_edge_in"))


def _times() -> Column:
    more = (F.col("_hash") < F.col("_edge")) | ((F.col("_hash") == F.col("_edge")) & F.col("_edge_in"))
    return F.col("_times") + F.when((F.col("_times") < CAP) & more, 1).otherwise(0)


def _base(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    return kept(docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_source"), words(F.col(text)).alias("_words"), doc_hash(F.col(doc_id)).alias("_hash")))


def _sources(base: DataFrame, weights: tuple[int, ...]) -> tuple[DataFrame, bool]:
    t = kept(thresholds(base, weights))
    return t, small(t)


def mix(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """For each document doc_id, size, source_size, target and taken (words that the mix takes of it, repeats counted)."""
    base = _base(docs, text, doc_id, source)
    out = at_source(base, *_sources(base, weights))
    return out.select(F.col("_id").alias("doc_id"), F.col("_words").alias("size"), F.col("_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_words") * _times()).alias("taken"))


def mixed_documents(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: the rows of docs with all their columns, each as often as the mix takes it."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    col = lambda name: F.col(own[docs.columns.index(name)])
    rows = docs.toDF(*own)
    rows = rows.select(*own, col(source).alias("_source"), doc_hash(col(doc_id)).alias("_hash"))
    out = at_source(rows, *_sources(_base(docs, text, doc_id, source), weights))
    out = out.withColumn("_n", _times()).where(F.col("_n") > 0)
    return out.select(*own, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_n")).select(*own).toDF(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM s0),
s2 AS (SELECT *, 3 * s AS c, CAST(3 * s AS DOUBLE) / w AS ratio, sum(s) OVER () AS total, sum(w) OVER () AS ws FROM s1),
s3 AS (SELECT *, CAST(total - coalesce(sum(c) OVER b, 0) AS DOUBLE) / CAST(ws - coalesce(sum(w) OVER b, 0) AS DOUBLE) >= ratio AS capped
       FROM s2 WINDOW b AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, CASE WHEN capped THEN CAST(c AS DOUBLE) ELSE w * (
         CAST(total - coalesce(sum(c) FILTER (WHERE capped) OVER (), 0) AS DOUBLE) / CAST(sum(w) FILTER (WHERE NOT capped) OVER () AS DOUBLE)) END AS target FROM s3),
s5 AS (SELECT *, CASE WHEN s > 0 THEN least(floor(target / s), 3)::BIGINT ELSE 0 END AS times FROM s4),
g AS (SELECT source, h, sum(size)::BIGINT AS gw FROM d GROUP BY source, h),
g1 AS (SELECT *, sum(gw) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM g)
SELECT d.doc_id, d.size, s5.s AS source_size, s5.target,
       CAST(d.size * (s5.times + CASE WHEN s5.times < 3 AND 2 * (g1.upto - g1.gw) + g1.gw <= 2 * (s5.target - s5.times * s5.s) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source JOIN g1 ON d.source IS NOT DISTINCT FROM g1.source AND d.h = g1.h
"""
