"""The corpus pipeline: language ID, line dedup, near duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet to the shared folder
and reads again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.catalog import table
from loomtext.llm import bpe, language_id, line_dedup, mixing, ngram_join
from loomtext.llm.queries import tokenizer_path
from loomtext.session import stored


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: texts without a letter, those that no language of the profiles explains, and undecided ones go.

    Null and empty texts go; a null lang or source says nothing; long texts count whole, tempered as others are; equal
    posteriors go to the first language; repeated rows each stay or go alike; an empty table stays empty; further
    columns are kept, whatever their names.
    """
    return language_id.accepted(docs, language_id.documents_input())


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines; n_chars follows. Documents of which every line was such a copy go.

    Null, empty and blank texts stay as they are; long texts count whole; of copies the one with the smallest doc_id
    (null first), then hash of the text, then place stays; rows equal in doc_id and text are one document and get one
    result; an empty table stays empty; further columns are kept, whatever their names.
    """
    from pyspark.sql import functions as F

    out = line_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, Jaccard similarity of 0.8 or more.

    Null and empty texts and texts without words link with nothing and all stay; long texts count whole; the smallest
    doc_id of a group stays (null last), of rows alike in doc_id and text one; an empty table stays empty; further
    columns are kept, whatever their names.
    """
    return ngram_join.one_of_each(docs, ngram_join.Similarity(words=5, num=80, den=100))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Null and empty texts have no words and are taken as their hash says; a null source is a source, last in order; long
    texts count whole; rows with one doc_id (null too) share a hash and are taken alike; an empty table stays empty;
    further columns are kept, whatever their names.
    """
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids.

    Null counts as empty text, which has no ids; long texts are encoded whole; repeated rows and null doc_ids stay; an
    empty table stays empty; further columns are left out.
    """
    return bpe.encode(docs, tokenizer_path(), keep=["doc_id", "source"]).select("doc_id", "source", "n_tokens", "ids")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("bpe", token_stage),
]

#: SQL cannot express language models, suffix arrays and BPE; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
