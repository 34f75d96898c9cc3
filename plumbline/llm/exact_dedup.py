"""Exact duplicates by a persistent digest index, bucketed and sorted by digest.

A batch is reduced to one row per digest, the unseen ones are found by a sort-merge anti
join with the index, and appended to it. The index side is not shuffled; its buckets are
sorted again as they are read, since every batch adds a file to each.

Defined cases: a null text counts as empty, and all empty texts are equal; a null id sorts
after every other id; rows that repeat an id and a text count each, and one of them stays;
an empty batch gives an empty result and leaves the index as it is. Columns other than the
id and the text are never read, so their names do not matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE, quoted, shared_path, text_of

SCHEMA = "digest binary, keep_id bigint, group_size bigint"


def digest(text: str = "text") -> Column:
    """SHA-256 of the text without white space, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(text), f"[{SPACE}]+", ""), 256))


class DigestIndex:
    """One row per text ever seen: its digest, the id that stays and its group's size."""

    def __init__(self, spark: SparkSession, location: str, buckets: int | None = None):
        self.spark, self.location = spark, location
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"create table {self.table} ({SCHEMA}) using parquet clustered by (digest) "
            f"sorted by (digest) into {self.buckets} buckets location '{location}'"
        )

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups``, one per digest, whose digest the index lacks."""
        index = self.spark.table(self.table).select("digest")
        return groups.join(index.hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Add ``groups``; a task writes one bucket, so a batch adds one file to each."""
        rows = groups.select("digest", "keep_id", "group_size")
        rows.repartition(self.buckets, "digest").write.insertInto(self.table)

    def rows(self) -> DataFrame:
        """The index as plain files, for joins that adaptive execution may split."""
        return self.spark.read.schema(SCHEMA).parquet(self.location)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Id, digest, the longest original text in code points, and how many rows repeat them."""
    rows = docs.select(
        "doc_id", digest().alias("digest"), F.char_length(text_of()).alias("n_chars")
    )
    return rows.groupBy("digest", "doc_id").agg(
        F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies")
    )


def winners(prints: DataFrame) -> DataFrame:
    """Per digest the id with the longest text, then the smallest, and the group's size."""
    order = F.struct("n_chars", F.col("doc_id").isNotNull(), F.bitwise_not("doc_id"))
    return prints.groupBy("digest").agg(
        F.max_by("doc_id", order).alias("keep_id"), F.sum("copies").alias("group_size")
    )


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per document of the batch; texts new to the index are appended to it.

    A text that the index already holds keeps the id of its earlier batch and none of this
    one's rows. ``group_size`` is that of the batch which brought the text.
    """
    prints = fingerprints(docs)
    index.append(index.unseen(winners(prints)))
    joined = prints.join(index.rows(), "digest")
    each = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return joined.select("*", each.alias("copy")).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder."""
    return DigestIndex(spark, shared_path(spark, "digests"))


def survivors(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    The large texts meet the kept ids in one shuffled join; equal rows then count once.
    """
    kept = deduplicate(docs, index).where("kept").select("doc_id", F.unhex("text_sha256"))
    kept = kept.toDF("kept_id", "kept_digest")
    marked = docs.select(
        F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("doc"), digest().alias("digest")
    )
    on = (marked["digest"] == kept["kept_digest"]) & marked["doc.doc_id"].eqNullSafe(kept["kept_id"])
    longest = Window.partitionBy("digest", "doc.doc_id").orderBy(
        F.char_length(text_of("doc.text")).desc()
    )
    once = marked.join(kept, on, "left_semi").withColumn("place", F.row_number().over(longest))
    return once.where("place = 1").select("doc.*")


ORACLE = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256
  from documents),
ranked as (
  select *, row_number() over w as place, count(*) over (partition by text_sha256) as group_size,
         first_value(doc_id) over w as keep_id
  from d window w as (partition by text_sha256 order by n desc, doc_id nulls last
                      rows between unbounded preceding and unbounded following))
select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from ranked
"""
