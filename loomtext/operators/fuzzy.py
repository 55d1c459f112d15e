"""Fuzzy search over records: a subsequence score with bonuses, the best weighted key of each record."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Scores of a match, of the first and of further skipped characters, and bonuses for where a match is.
MATCH, GAP_START, GAP, BOUNDARY, CAMEL, CONSECUTIVE, FIRST = 16, -3, -1, 8, 5, 4, 2
FULL = 256.0
#: Queries that a worker holds at a time.
BLOCK = 10_000


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def _bonus(prev: str, c: str) -> int:
    if not prev or not prev.isalnum():
        return BOUNDARY if c.isalnum() else 0
    return CAMEL if prev.islower() and c.isupper() or not prev.isdigit() and c.isdigit() else 0


def fuzzy_score(query: str, text: str) -> int:
    """The best score of query as a subsequence of text, cases ignored; marks count if the query has some. 0 if it is none."""
    if query.isascii():
        text = _plain(text)
    q, t = query.lower(), text.lower()
    if len(t) != len(text):
        text = t
    if not q or len(q) > len(t):
        return 0
    none = -(10**9)
    # ended: best score with the last match here; run: length of the bonus run; gapped: best so far with a gap after it.
    ended = [none] * len(t)
    for i, c in enumerate(q):
        new, runs = [none] * len(t), [0] * len(t)
        gapped = none
        for j, d in enumerate(t):
            if i and j:
                gapped = max(gapped + GAP, ended[j - 2] + GAP_START if j > 1 else none)
            if c == d:
                bonus = _bonus(text[j - 1] if j else "", text[j])
                if i == 0:
                    new[j] = MATCH + bonus * FIRST
                else:
                    straight = ended[j - 1] + MATCH + max(bonus, CONSECUTIVE) if j else none
                    new[j] = max(straight, gapped + MATCH + bonus)
                if new[j] < 0:
                    new[j] = none
        ended = new
    best = max(ended)
    return best if best > 0 else 0


def best_field(query: str, record: str, keys: list[tuple[str, float]]) -> int:
    if not keys:
        try:
            value = json.loads(record)
        except ValueError:
            value = record
        return fuzzy_score(query, value if isinstance(value, str) else record)
    try:
        fields = json.loads(record)
    except ValueError:
        fields = {}
    get = lambda k: fields.get(k, "") if isinstance(fields, dict) and isinstance(fields.get(k, ""), str) else ""
    return max((int(fuzzy_score(query, get(k)) * w) for k, w in keys), default=0)


def search(records: DataFrame, queries: DataFrame, *, keys: list[tuple[str, float]] | None = None, threshold: float = 0.6, limit: int | None = None, ref: str = "ref_index", record: str = "record") -> DataFrame:
    """(query_id, ref_index, score, rank) of the records that match each query (query_id, query), the best first.

    Every query meets every record, as any of its characters may match. Queries go to the workers in blocks of BLOCK,
    and a worker scores a batch of records against a block; null records match nothing.
    """
    kind, id_kind = (x.simpleString() for x in (queries.schema["query_id"].dataType, records.schema[ref].dataType))
    q = queries.where(F.length("query") > 0).select("query_id", "query")
    blocks = q.groupBy(F.pmod(F.xxhash64("query_id", "query"), F.lit(max(1, -(-q.count() // BLOCK)))).alias("block")).agg(F.collect_list(F.struct("query_id", "query")).alias("asked"))
    own, fields = records.select(F.col(ref).alias("ref_index"), F.col(record).alias("record")), list(keys or [])
    names, id_type = ["query_id", "ref_index", "raw"], to_arrow_type(queries.schema["query_id"].dataType)
    out = None
    for b in blocks.toLocalIterator():  # a block of queries at a time
        asked = [(x.query_id, x.query) for x in b.asked]

        def run(batches: Iterable[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(i, r, s) for r, t in zip(batch["ref_index"].to_pylist(), batch["record"].to_pylist(), strict=True) if t is not None for i, text in asked if (s := best_field(text, t, fields)) > 0]
                yield pa.RecordBatch.from_pylist([dict(zip(names, f, strict=True)) for f in found], schema=pa.schema([("query_id", id_type), ("ref_index", batch.schema.field("ref_index").type), ("raw", pa.int32())]))

        part = own.mapInArrow(run, f"query_id {kind}, ref_index {id_kind}, raw int")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = own.sparkSession.createDataFrame([], f"query_id {kind}, ref_index {id_kind}, raw int")
    rows = out.withColumn("score", 1 - F.least(F.col("raw") / FULL, F.lit(1.0))).where(F.col("score") <= threshold)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw"), "ref_index"))
    out = rows.withColumn("rank", rank)
    return (out if limit is None else out.where(F.col("rank") <= limit)).select("query_id", "ref_index", "score", "rank")
