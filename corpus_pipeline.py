"""A training corpus from the documents table: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir); docs are its predecessor's rows. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from courtside.llm import decontam, language, packing, simhash, toxicity
from courtside.llm.queries import table
from courtside.session import scratch_path


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier, fitted on the labelled rows, rejects go."""
    return toxicity.clean(docs, toxicity.train_fold(docs, table(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in no known language go."""
    return language.clean(docs, language.fit_fold(docs))


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays."""
    return simhash.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that repeat benchmark passages in a twentieth of their words go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining rows, packed."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", not_toxic), ("language_id", known_language), ("near_dedup", distinct_enough),
          ("decontamination", uncontaminated), ("packing", sequences)]

ORACLE_SQL = None  # no stage but the fourth can be said in SQL; tests/llm compares each with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
