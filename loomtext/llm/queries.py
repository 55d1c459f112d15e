"""Queries of this subpackage, by name; each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.catalog import table
from loomtext.llm import bpe, kneser_ney, language_id, line_dedup, mixing, mpeg_audio, ngram_join, rans, topk, toxicity

#: The tokenizer file of op2 and op5, by its name in the package of public tokenizers.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.train_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_files(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages alike; rows of pages have a page_id and no doc_id."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    return language_id.identify([(docs, language_id.documents_input(), ["doc_id"]), (pages, language_id.pages_input(), ["page_id"])])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(table(spark, sf_dir, "documents"), min_words=line_dedup.MIN_WORDS)
    return out.select("doc_id", "text", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.linked(table(spark, sf_dir, "documents"), ngram_join.Similarity(words=4, num=85, den=100))
    return out.select("doc_id", "n_shingles", "component_id")


def op8_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.stored_media(table(spark, sf_dir, "documents"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.train_and_score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_rans": op2_rans,
    "op3_language": op3_language,
    "op4_mixing": op4_mixing,
    "op5_bpe": op5_bpe,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_ball_tree": op8_ball_tree,
    "op9_mpeg_audio": op9_mpeg_audio,
    "op10_kneser_ney": op10_kneser_ney,
}

ORACLE_SQL: dict[str, str] = {"op4_mixing": mixing.SQL, "op6_line_dedup": line_dedup.SQL, "op7_ngram_join": ngram_join.SQL, "op8_ball_tree": topk.SQL}
