"""A training-data pipeline over documents: five operators, each stage written as Parquet and read by the next.

Every stage but the last returns the columns of documents. Null and empty texts go in the first stage, which finds no
language in them; repeated rows are judged alike until the join keeps one document of each group.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import language_id, line_dedup, ngram_join, packing, quality
from barloom.llm.shared import written


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; lang is what was found."""
    return language_id.keep_identified(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail."""
    return _recounted(quality.clean(docs))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines seen earlier; those of which nothing is left go."""
    left = line_dedup.dedup(docs)
    return _recounted(left.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with similar sets of five words."""
    return ngram_join.keep_one(docs, size=5, threshold=0.8)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into windows of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("line_dedup", remove_repeated_lines),
    ("ngram_join", join_near_duplicates),
    ("packing", pack_windows),
]

#: SQL can't express the text model, the edit-distance join or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
