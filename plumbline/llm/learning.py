"""Labelled rows to learn from."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import held_out, text_of

#: At most so many labelled rows are learned from, the first by a hash of their ids.
SAMPLE_ROWS = 4_000
#: Longer texts are scored like any other, but not learned from.
SAMPLE_CHARS = 50_000
FOLDS = 5


def sampled(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label) of a bounded sample outside the held-out fifth.

    An id labelled twice counts with its larger label, and one with several texts with the
    smallest. Both bounds hold for the sample alone.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = usable.where(~held_out(FOLDS)).groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return (
        docs.select("doc_id", text_of().alias("text"))
        .where(F.char_length("text") <= SAMPLE_CHARS)
        .join(F.broadcast(chosen), "doc_id")  # at most SAMPLE_ROWS rows of two numbers
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.first("label").alias("label"))
    )


def sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS
) -> tuple[list[str], list[int]]:
    """Texts and labels of :func:`sampled`, by id."""
    texts = sampled(docs, labels, label, rows).orderBy("doc_id").toArrow()
    return texts["text"].to_pylist(), [int(v) for v in texts["label"].to_pylist()]


def learned(rows: DataFrame, learn: Callable[[list[str], list[int]], Any]) -> Any:
    """``learn`` of the texts and labels of ``rows``, a bounded sample, by id.

    It runs in a task; the driver gets what was learned and holds neither the texts nor
    what learning takes.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for part in parts:
            texts += part.column(0).to_pylist()
            marks += map(int, part.column(1).to_pylist())
        found = pickle.dumps(learn(texts, marks))
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], names=["found"])

    whole = rows.repartition(1).sortWithinPartitions("doc_id").select("text", "label")
    found = whole.mapInArrow(run, "found binary").collect()
    # No rows may be no task.
    return pickle.loads(found[0]["found"]) if found else learn([], [])
