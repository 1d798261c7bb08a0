"""The corpus pipeline: documents through quality, near-dedup, substring dedup, mixing and tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tranche.llm import bpe, crf, jaccard, mixing, queries, simhash, substring
from tranche.llm.shared import read, table

KEPT_SCORE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by labels of documents among docs, doesn't reject."""
    model = queries.quality_model(docs, spark, sf_dir)
    return crf.with_score(docs, model, to="_score").where(F.col("_score") >= KEPT_SCORE).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: those of 5-word similarity 0.8 and more, found by SimHash and,
    where fingerprints differ too much, by MinHash."""
    return simhash.keep_first(docs, jaccard.near_groups(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that earlier documents hold."""
    return substring.apply_removal(docs, *substring.dedup(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target sizes; a document taken more than once holds its text as often."""
    return mixing.apply_plan(docs, mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of ids and decoded text."""
    path = queries.tokenizer_path()
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "source", "text"), path).drop("text"), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", queries.sha256(ids).alias("ids_sha256"), queries.sha256(F.col("decoded")).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix", mix), ("tokens", tokens)]

#: SQL can't express the stages (a fitted model, hashes of shingles, a tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
