"""A training-corpus pipeline: each stage is a DataFrame function over what its predecessor kept.

A stage begins with the heap that it needs, not with the largest that any stage before it took."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import exact_dedup, langid, mixing, ngram_join, pieces, store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go."""
    store.give_back(spark)
    return langid.keep_known(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z case, the row with the largest doc_id stays."""
    store.give_back(spark)
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingle similarity, the smallest doc_id stays."""
    store.give_back(spark)
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    store.give_back(spark)
    return mixing.repeat_to_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with the check that they decode to its text."""
    store.give_back(spark)
    return pieces.encode(docs)


STAGES = [("language", language), ("copies", copies), ("near_copies", near_copies), ("mixed", mixed), ("encoded", encoded)]

#: Language models, similarity classes and subset sums are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
