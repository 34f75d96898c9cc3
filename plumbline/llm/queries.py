"""The registered queries of the corpus operators, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import (
    backtracking_bpe,
    bpe,
    class_lm,
    exact_dedup,
    fill_middle,
    html_wrappers,
    mixing,
    ngram_join,
    periodic_runs,
    pii,
    quality,
    topk_search,
    toxicity,
)
from plumbline.llm.common import table


def op1_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    queries = topk_search.quantised(vectors.where("vec_id % 50 = 0"))
    return topk_search.search(topk_search.build_index(vectors), queries, k=5)


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(table(spark, folder, "documents"))


def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.links_of(table(spark, folder, "documents"), words=3, percent=90)


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classified(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_wrappers.extract(table(spark, folder, "pages"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.Mix(table(spark, folder, "documents")).taken()


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classified(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    return class_lm.scored(table(spark, folder, "documents"))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return exact_dedup.deduplicate(docs, exact_dedup.new_index(spark))


def op11_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_in_middle(table(spark, folder, "documents")))


def op12_backtracking_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = backtracking_bpe.encode(table(spark, folder, "documents"), path)
    return backtracking_bpe.digests(backtracking_bpe.decode(encoded, path))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = periodic_runs.planted(table(spark, folder, "documents"))
    return periodic_runs.digests(periodic_runs.find(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": op1_topk_search,
    "op2_pii": op2_pii,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality": op4_quality,
    "op5_html": op5_html,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_class_lm": op8_class_lm,
    "op9_bpe": op9_bpe,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_fill_middle": op11_fill_middle,
    "op12_backtracking_bpe": op12_backtracking_bpe,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op1_topk_search": topk_search.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
}
