"""Quality by supervised subword embeddings.

A text is the average of learned vectors of its hashed words, of repeated words, and of
hashed runs of 3 to 5 bytes; a softmax of a linear layer on it gives the labels' chances. Vectors and layer are
trained by numpy stochastic gradient descent on a bounded sample. To score, the layer is
applied to the vectors once, so that a text costs one number per word and byte run.

Defined cases: a null text counts as empty; an empty text has no vector and gets the share
of good rows in the sample, as does every text without both labels there (0 without any
row); texts are read whole; rows that repeat an id each give a row. Only the id and the
text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches, held_out
from plumbline.llm.learning import sample

BITS = 16
RUNS = (3, 4, 5)
#: Pairs of the same word so many words apart have a vector of their own.
GAPS = 3
DIMENSIONS = 16
EPOCHS = 6
RATE = 0.5
SEED = 7_013
#: Bytes of a text that are hashed at once.
PART = 1 << 20


def buckets(raw: bytes) -> Iterator[np.ndarray]:
    """Hashed words and byte runs of a text, part by part."""
    words = raw.split()
    for begin in range(0, len(words), PART):
        codes = np.fromiter(map(zlib.crc32, words[begin : begin + PART]), np.uint32)
        yield (codes >> np.uint32(32 - BITS)) | np.uint32(1 << BITS)
        for gap in range(1, GAPS + 1):  # a word after itself, whichever word it is
            again = int((codes[gap:] == codes[:-gap]).sum())
            yield np.full(again, (2 << BITS) + gap - 1, np.uint32)
    for begin in range(0, len(raw), PART):
        codes = np.frombuffer(raw[begin : begin + PART + RUNS[-1] - 1], np.uint8).astype(np.uint32)
        run = codes
        for n in range(2, RUNS[-1] + 1):
            own = min(len(codes) - n + 1, PART)
            if own <= 0:
                break
            run = run[: len(codes) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1 :]
            if n in RUNS:
                mixed = (run[:own] + np.uint32(n)) * np.uint32(0x9E3779B1)
                yield mixed >> np.uint32(32 - BITS)


def average(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and the weight of each in its average."""
    found = list(buckets(text.encode("utf-8", "replace")))
    every = np.concatenate(found) if found else np.zeros(0, np.uint32)
    ids, counts = np.unique(every, return_counts=True)
    return ids, (counts / max(1, len(every))).astype(np.float32)


class Model:
    """Vectors and softmax layer, trained by stochastic gradient descent."""

    def __init__(self, texts: list[str], labels: list[int], epochs: int = EPOCHS):
        self.share = float(np.mean(labels)) if labels else 0.0
        self.margins = None
        if not 0 < self.share < 1:
            return
        chance = np.random.default_rng(SEED)
        vectors = chance.uniform(-1, 1, ((2 << BITS) + GAPS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
        layer = np.zeros((2, DIMENSIONS), np.float32)
        bias = np.log(np.array([1 - self.share, self.share], np.float32))
        docs = [(*average(t), y) for t, y in zip(texts, labels, strict=True) if t]
        steps, done = epochs * len(docs), 0
        for _ in range(epochs):
            for at in chance.permutation(len(docs)):
                ids, weights, label = docs[at]
                rate = np.float32(RATE * (1 - done / steps))
                done += 1
                own = vectors[ids]
                hidden = weights @ own
                out = layer @ hidden + bias
                out = np.exp(out - out.max())
                error = out / out.sum()
                error[label] -= 1
                back = error @ layer
                layer -= rate * np.outer(error, hidden)
                bias -= np.float32(0.1) * rate * error
                # A step moves the average itself by the rate, however long the text is.
                scale = rate / (weights @ weights)
                vectors[ids] = own - (scale * weights)[:, None] * back
        side = layer[1] - layer[0]
        self.margins = (vectors @ side).astype(np.float32)
        self.bias = float(bias[1] - bias[0])

    def score(self, text: str) -> float:
        if self.margins is None or not text:
            return self.share
        total, n = 0.0, 0
        for ids in buckets(text.encode("utf-8", "replace")):
            total += float(self.margins[ids].sum(dtype=np.float64))
            n += len(ids)
        return float(1 / (1 + np.exp(-np.clip(total / max(1, n) + self.bias, -500, 500))))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return Model(*sample(docs, labels, "quality"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every whole text; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (doc_id.as_py(), shared.value.score(text.as_py() or ""))
            for part in parts
            for doc_id, text in zip(part.column(0), part.column(1), strict=True)
        )
        return batches(rows, schema)

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    return rows.mapInArrow(add, "doc_id bigint, score double")


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The contract's columns for every document."""
    scored = score(docs, train(docs, labels))
    return scored.select(
        "doc_id",
        held_out(5).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
