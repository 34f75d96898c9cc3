"""Connected components of a graph of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label) for every end of ``links`` (a, b): the smallest id that it reaches.

    Each turn takes the smallest label around and then the label of that label, so chains
    shorten by half or more; it ends when no label changed. Sums run before the shuffle, so
    an id with very many links is no burden to one task. The result is a table of
    ``scratch``, which the caller releases.
    """
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    ends = F.explode(F.array(F.struct("a", "b"), turned)).alias("ends")
    both = scratch.stored(links.where("a <> b").select(ends).select("ends.*"), "links")
    labels = scratch.stored(
        both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("id"), F.least("a", "low").alias("label"), F.col("a").alias("was")
        ),
        "labels",
    )
    while True:
        around = both.join(labels.selectExpr("id as b", "label"), "b").groupBy("a").agg(
            F.min("label").alias("low")
        )
        lower = labels.join(around.withColumnRenamed("a", "id"), "id", "left").select(
            "id", "label", F.least("label", "low").alias("low")
        )
        roots = labels.select(F.col("id").alias("low"), F.col("label").alias("root"))
        turn = scratch.stored(
            lower.join(roots, "low", "left").select(
                "id", F.least("low", "root").alias("label"), F.col("label").alias("was")
            ),
            "labels",
        )
        scratch.release(labels)
        if turn.where("label <> was").isEmpty():
            scratch.release(both)
            return turn
        labels = turn
