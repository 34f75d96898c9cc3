"""Byte-level BPE encoding and decoding by a global shuffle of distinct pre-tokens.

Texts are split into pre-tokens. A block of texts lists its distinct pre-tokens once and
keeps, for every position, the pre-token's number in that list; the lists of all blocks,
packed by a hash of the pre-token, are shuffled by it, so that equal ones meet and are merged
once; their ids return to their blocks, where the positions put them in order. Only distinct
pre-tokens are shuffled, not every occurrence; the positions stay in a table bucketed by
block. Decoding looks ids up in the token-byte table, whose size is that of the vocabulary.

Defined cases: a null text counts as empty and has no tokens; special tokens are ordinary
text; a text of any length is encoded whole; rows that repeat an id each give a row; an
empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches, shared_path

#: Characters of the texts of a block, but for one longer text.
BLOCK_CHARS = 8_000_000
#: Texts beyond this are split match by match, not into a list.
LONG_TEXT = 2_000_000
#: Distinct pre-tokens whose ids a task remembers; beyond, it starts anew.
HELD_WORDS = 1_000_000
#: A byte that no UTF-8 text holds, between packed pre-tokens.
BETWEEN = b"\xff"

BLOCKS = (
    "block bigint, doc_ids array<bigint>, sizes array<bigint>, places binary, n_words bigint, "
    "packs array<struct<part:int,places:binary,words:binary,n_bytes:bigint>>"
)
PIECES = "block bigint, places binary, counts binary, ids binary"
CODED = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
)
DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
     ("decoded_sha256", pa.string())]
)


def read_ranks(path: str) -> list[bytes]:
    """The bytes of every token, by its rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks.get(rank, b"") for rank in range(max(ranks) + 1)]


def packed(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on: high ones are alike."""
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, size: int, kind: type) -> np.ndarray:
    room = size * np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, room, codec="zstd", asbytes=True), np.uint8)
    return planes.reshape(np.dtype(kind).itemsize, size).T.copy().view(kind).ravel()


def packs_of(words: list[str], parts: int) -> list[dict]:
    """The words by a hash of each, every part with its words' places in ``words``."""
    raw = [word.encode() for word in words]
    part = np.fromiter(map(zlib.crc32, raw), np.uint32) % np.uint32(parts)
    order = np.argsort(part, kind="stable").astype(np.uint32)
    found = []
    for places in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(places):
            body = BETWEEN.join([raw[place] for place in places])
            row = {"part": int(part[places[0]]), "places": counted(places)}
            found.append(row | {"words": pa.compress(body, codec="zstd", asbytes=True),
                                "n_bytes": len(body)})
    return found


def counted(values: np.ndarray) -> bytes:
    """Packed numbers after their count."""
    return np.int64(len(values)).tobytes() + packed(values)


def recounted(data: bytes) -> np.ndarray:
    return unpacked(data[8:], int(np.frombuffer(data[:8], np.int64)[0]), np.uint32)


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


PACKS = pa.list_(
    pa.struct([("part", pa.int32()), ("places", pa.binary()), ("words", pa.binary()),
               ("n_bytes", pa.int64())])
)


def _split(pattern: str, tasks: int):
    """Blocks of texts as lists of distinct pre-tokens and positions in them."""

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = regex.compile(pattern)
        serial = TaskContext.get().partitionId() << 32
        numbers, ids, places, chars = Numbers(), [], [], 0

        def block():
            every = np.concatenate(places) if places else np.zeros(0, np.uint32)
            columns = [
                pa.array([serial], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(p) for p in places]], pa.list_(pa.int64())),
                pa.array([packed(every)], pa.binary()),
                pa.array([len(numbers)], pa.int64()),
                pa.array([packs_of(list(numbers), tasks)], PACKS),
            ]
            names = ["block", "doc_ids", "sizes", "places", "n_words", "packs"]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for part in parts:
            for doc_id, value in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                text = value.as_py() or ""
                if len(text) < LONG_TEXT:
                    found = rule.findall(text)
                else:
                    found = (hit.group() for hit in rule.finditer(text))
                places.append(np.fromiter(map(numbers.__getitem__, found), np.uint32))
                ids.append(doc_id)
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield block()
                    serial += 1
                    numbers, ids, places, chars = Numbers(), [], [], 0
        if ids:
            yield block()

    return split


def _merge(ranks):
    """Packs (block, places, words, n_bytes) of one hash; a word is merged when first met."""

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {token: rank for rank, token in enumerate(ranks.value) if token}
        coder = tiktoken.Encoding("ranks", pat_str=r"[\s\S]", mergeable_ranks=table,
                                  special_tokens={})
        known: dict[bytes, list[int]] = {}
        for part in parts:
            for block, places, words, n_bytes in zip(*part.columns, strict=True):
                raw = pa.decompress(words.as_py(), n_bytes.as_py(), codec="zstd", asbytes=True)
                found = []
                for word in raw.split(BETWEEN):
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= HELD_WORDS:
                            known.clear()
                        ids = known[word] = coder._encode_single_piece(word)
                    found.append(ids)
                counts = np.fromiter(map(len, found), np.uint32, len(found))
                flat = np.fromiter((i for ids in found for i in ids), np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block.as_py()], pa.int64()),
                        pa.array([places.as_py()], pa.binary()),
                        pa.array([counted(counts)], pa.binary()),
                        pa.array([counted(flat)], pa.binary()),
                    ],
                    names=["block", "places", "counts", "ids"],
                )

    return merge


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indexes start..start+count-1 of every pair, one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def _ids_of(row: dict) -> Iterator[tuple[int | None, np.ndarray]]:
    """The ids of every text of a block, from its positions and its words' ids."""
    counts = np.zeros(row["n_words"], np.int64)
    starts = np.zeros(row["n_words"], np.int64)
    flats, size = [], 0
    for piece in row["pieces"]:
        places = recounted(piece["places"])
        own = recounted(piece["counts"]).astype(np.int64)
        counts[places] = own
        starts[places] = size + np.cumsum(own) - own
        flats.append(recounted(piece["ids"]))
        size += len(flats[-1])
    flat = np.concatenate(flats) if flats else np.zeros(0, np.uint32)
    every = unpacked(row["block_places"], sum(row["sizes"]), np.uint32)
    begin = 0
    for doc_id, n in zip(row["doc_ids"], row["sizes"], strict=True):
        own = every[begin : begin + n]
        begin += n
        yield doc_id, flat[ragged(starts[own], counts[own])]


def _assembled(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for part in parts:
        for at in range(part.num_rows):
            row = {name: part.column(i)[at].as_py() for i, name in enumerate(part.schema.names)}
            yield from _ids_of(row)


def _coded(docs: DataFrame, ranks, pattern: str) -> DataFrame:
    """One row per block with its positions and the ids of all its words."""
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed(rows.mapInArrow(_split(pattern, tasks), BLOCKS), "block", tasks)
    packs = blocks.select("block", F.explode("packs").alias("pack")).select("block", "pack.*")
    dealt = packs.repartition(tasks, "part").select("block", "places", "words", "n_bytes")
    pieces = dealt.mapInArrow(_merge(ranks), PIECES)
    gathered = pieces.groupBy("block").agg(
        F.collect_list(F.struct("places", "counts", "ids")).alias("pieces")
    )
    none = F.array().cast("array<struct<places:binary,counts:binary,ids:binary>>")
    return blocks.join(gathered.hint("merge"), "block", "left").select(
        "doc_ids",
        "sizes",
        F.col("places").alias("block_places"),
        "n_words",
        F.coalesce("pieces", none).alias("pieces"),
    )


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` as a stored table bucketed by ``key``: later joins on it leave it in place."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(buckets, key).sortBy(key).option("path", shared_path(spark, name))
    writer.format("parquet").saveAsTable(name)
    return spark.table(name)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids``, little-endian unsigned 32-bit, per document."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def assemble(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc_id, len(ids), ids.tobytes()) for doc_id, ids in _assembled(parts))
        return batches(rows, CODED, 256)

    return _coded(docs, ranks, pattern).mapInArrow(
        assemble, "doc_id bigint, n_tokens bigint, ids binary"
    )


class TokenBytes:
    """The token-byte table as one run of bytes; it is as large as the vocabulary."""

    def __init__(self, ranks: list[bytes]):
        self.counts = np.array([len(token) for token in ranks], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.bytes = np.frombuffer(b"".join(ranks), np.uint8)

    def decoded(self, ids: np.ndarray) -> bytes:
        return self.bytes[ragged(self.starts[ids], self.counts[ids])].tobytes()


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id`` and the ``decoded`` bytes of ``encoded``, by the token-byte table."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def look_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenBytes(ranks.value)
        rows = (
            (doc_id.as_py(), table.decoded(np.frombuffer(ids.as_py(), np.uint32)))
            for part in parts
            for doc_id, ids in zip(part.column(0), part.column(1), strict=True)
        )
        return batches(rows, schema, 256)

    return encoded.select("doc_id", "ids").mapInArrow(look_up, "doc_id bigint, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Number and SHA-256 of the ids, and SHA-256 of the bytes that they decode to."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenBytes(ranks.value)
        rows = (
            (
                doc_id,
                len(ids),
                hashlib.sha256(ids.tobytes()).hexdigest(),
                hashlib.sha256(table.decoded(ids)).hexdigest(),
            )
            for doc_id, ids in _assembled(parts)
        )
        return batches(rows, DIGESTS)

    return _coded(docs, ranks, pattern).mapInArrow(
        digest, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
