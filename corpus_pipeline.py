"""The corpus pipeline: stages that each write documents for the next one.

Defined cases, as the stages state them: a null text counts as empty, and of all empty texts
one stays; a null source is a source of its own, the last; a null id sorts after all others;
rows that repeat an id are documents of their own; texts of any length are read whole; extra
columns, whatever their names, come along up to the last stage; no documents give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from plumbline.llm.common import shared_path, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled ones."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row."""
    return exact_dedup.survivors(docs, exact_dedup.new_index(spark))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar five-word shingles the one with the smallest id."""
    return ngram_join.representatives(docs, words=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often and as much as it takes of each."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram join", without_near_copies),
    ("mixing", mixed),
    ("byte-level BPE", encoded),
]

#: SQL cannot state the trained first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; every stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        written(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
    return docs
