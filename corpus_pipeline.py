"""Corpus pipeline: quality filter, line dedup, near-duplicate join, mixing, tokenisation.

Every stage keeps the columns of its input, whatever their names, but the last one, which returns a
row of digests for each document that is left.  Null and empty texts, very long ones, repeated rows
and ids, null ids and empty tables pass through as the stages' own docstrings say: a null text has no
words, so the classifier scores it as an empty one, line dedup leaves it alone, the join links it with
nothing and the mix, which counts words, never takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import line_dedup, mixing, ngram_jaccard, quality_classifier, sentencepiece_codec
from quire.llm.common import swept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality_classifier.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line repeats."""
    return line_dedup.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ngram_jaccard.keep(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, shard by shard and shuffled within; a document it never takes goes."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed documents."""
    return sentencepiece_codec.digest(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram jaccard join", near_duplicates),
    ("source mixing", mix),
    ("sentencepiece", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = swept(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))  # what a stage stored on the way goes
    return STAGES[-1][1](spark, docs, sf_dir)
