"""Search, streams and the registered queries."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as tx
from loomtext.operators import search
from loomtext.plans.queries import ORACLE_SQL, QUERIES
from loomtext.streaming import index as stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string")


def hits(index, query, **options):
    q = index.docs.sparkSession.createDataFrame([(0, query)], "query_id long, text string")
    return [r.id for r in search.search(index, q, **options).orderBy("rank").collect()]


def test_bm25(spark):
    i = search.build_index(corpus(spark, [("a", "the cat sat on the mat"), ("b", "the dog ran away"), ("c", "cat and dog together"), ("d", ""), ("e", None)]))
    assert set(hits(i, "cat")) == {"a", "c"} and hits(i, "bird") == [] and i.size() == 5
    assert i.corpus.first().avgdl == pytest.approx(14 / 5)
    i = search.build_index(corpus(spark, [("x", "rust rust rust"), ("y", "rust and python")]))
    assert hits(i, "rust") == ["x", "y"] and hits(i, "rust", limit=1) == ["x"]
    empty = search.build_index(corpus(spark, []))
    assert hits(empty, "rust") == [] and empty.corpus.first().avgdl == 0


def test_minisearch(spark):
    i = search.build_index(corpus(spark, [("a", "rust programming language"), ("b", "python programming"), ("c", "cat catalog cattle dog")]))
    assert hits(i, "rust programming", operator="AND") == ["a"] and len(hits(i, "rust programming")) == 2
    assert hits(i, "cat", prefix=True) == ["c"] and hits(i, "ca", prefix=True, operator="AND") == ["c"] and hits(i, "zzz", prefix=True) == []
    few, search.BROADCAST_TERMS = search.BROADCAST_TERMS, 0
    try:
        assert hits(i, "cat", prefix=True) == hits(i, "c", prefix=True) == ["c"] and set(hits(i, "p", prefix=True)) == {"a", "b"}
    finally:
        search.BROADCAST_TERMS = few
    assert [r.term for r in search.auto_suggest(i, "CAT").collect()] == ["cat", "catalog", "cattle"]
    stop = search.build_index(corpus(spark, [("a", "the quick fox")]), stopwords=tx.SEARCH_STOPWORDS)
    assert hits(stop, "the", stopwords=tx.SEARCH_STOPWORDS) == []


def test_ids_that_repeat_are_documents_of_their_own(spark):
    i = search.build_index(corpus(spark, [("a", "x y"), ("a", "x z")]), key=F.monotonically_increasing_id())
    assert i.size() == 2 and hits(i, "x") == ["a", "a"]


def test_saved_index(spark, tmp_path):
    i = search.build_index(corpus(spark, [("a", "one two"), ("b", "two three")]))
    i.save(str(tmp_path))
    saved = search.Index.load(spark, str(tmp_path))
    assert hits(saved, "three") == ["b"] and hits(saved, "tw", prefix=True) == ["a", "b"] and hits(saved, "four") == []
    assert [tuple(r) for r in search.auto_suggest(saved, "t").collect()] == [("two", 2), ("three", 1)]


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    search.build_index(corpus(spark, [(f"d{i}", f"word{i} common") for i in range(200)])).save(str(tmp_path))
    q = spark.createDataFrame([(0, "word7")], "query_id long, text string")
    plan = search.search(search.Index.load(spark, str(tmp_path)), q)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_stream_equals_batch(spark, tmp_path):
    rows = [(str(i), f"word{i % 5} common text {i}") for i in range(20)]
    for k in range(2):
        corpus(spark, rows[k * 10 : k * 10 + 10]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.follow(docs, str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()
    a, b = stream.load(spark, str(tmp_path / "index")), search.build_index(corpus(spark, rows))
    assert hits(a, "word3 text") == hits(b, "word3 text") and a.corpus.first() == b.corpus.first()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        r = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in r.description]
        want = r.fetchall()
        assert sorted(names) == sorted(df.columns)
        order = [names.index(c) for c in df.columns]
        assert sorted(rows, key=repr) == sorted((tuple(x[i] for i in order) for x in want), key=repr)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_base_does_not_need_the_training_data_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "loomtext")):
        if f"{os.sep}llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as source:
                        assert "loomtext.llm" not in source.read()
