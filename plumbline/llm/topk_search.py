"""Exact top-k by inner product over a bit-sliced index.

The index holds blocks of rows. In a block every component of the quantised vectors is a
run of bit slices: slice i is a bitmap over the rows that tells whose offset value has bit
i. A query adds the slices of all components, shifted by the set bits of its own value, with
carry-save adders on bitmaps; a negative factor adds the complemented slices. The sum is
again bit slices. Selection goes from the most significant slice downward and keeps the
rows surely above the k-th score; the rows left equal at the last slice are the boundary,
taken by smaller id.

Query blocks meet index blocks in a keyed join, and only k rows per query and block leave
it. Defined cases: a vector that is null, holds a null or non-finite component, or whose
quantised component does not fit 26 bits takes no part, nor does a row without an id; a
shorter vector counts as padded with zeros; repeated rows of an id are candidates each, and
a query id is answered once, by its smallest vector; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored

SCALE = 256
INDEX_ROWS = 4_096
#: Queries that travel together; every index block is met once by each such pack.
QUERY_ROWS = 4_096
#: Quantised components stay below, so that differences of two fit 64 bits; beyond, it raises.
LIMIT = 1 << 62

INDEX = "block bigint, n_rows int, ids binary, lowest binary, widths binary, slices binary"
HITS = "query_id bigint, vec_id bigint, score bigint"


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and the components as floor(256 x).

    Vectors that are null or hold a null or non-finite component are left out. No other is:
    a component of magnitude 2**54 or more, whose quantised value fits no slice, raises.
    """

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * SCALE
        return F.when(F.abs(scaled) < float(LIMIT), F.floor(scaled)).otherwise(
            F.raise_error(F.lit("a vector component is beyond 2**54")).cast("bigint")
        )

    def finite(x: Column) -> Column:
        value = F.abs(x.cast("double"))
        return x.isNotNull() & ~F.isnan(value) & (value < float("inf"))

    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite)
    # The condition stands with the value: a filter alone may be evaluated after it.
    value = F.when(usable, F.transform("embedding", whole))
    return (
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), value.alias("q"))
        .where("q is not null")
    )


def matrix_of(lists: pa.ListArray) -> np.ndarray:
    """The lists as rows of one matrix, padded with zeros."""
    starts = lists.offsets.to_numpy()
    lengths = np.diff(starts)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0))
    rows = np.zeros((len(lengths), width), dtype=np.int64)
    at = np.repeat(np.arange(len(lengths)), lengths)
    rows[at, np.arange(starts[0], starts[-1]) - np.repeat(starts[:-1], lengths)] = values[
        starts[0] : starts[-1]
    ]
    return rows


def bits_of(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    spare = -packed.shape[-1] % 8
    wide = np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, spare)])
    return np.ascontiguousarray(wide).view(np.uint64)


def sliced(ids: np.ndarray, rows: np.ndarray) -> tuple:
    """One index row: offsets and bit slices of every component over the block."""
    lowest = rows.min(axis=0) if rows.size else np.zeros(rows.shape[1], np.int64)
    offset = rows - lowest
    widths = np.array([int(v).bit_length() for v in offset.max(axis=0)], dtype=np.int64)
    slices = [
        bits_of((offset[:, d] >> i & 1).astype(bool)[None, :])
        for d, width in enumerate(widths)
        for i in range(width)
    ]
    body = np.concatenate(slices).tobytes() if slices else b""
    return len(ids), ids.tobytes(), lowest.tobytes(), widths.tobytes(), body


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    serial = TaskContext.get().partitionId() << 32
    ids, lists, held = [], [], 0

    def flush():
        nonlocal serial, ids, lists, held
        every = np.concatenate(ids)
        rows = matrix_of(pa.concat_arrays(lists))
        ids, lists, held = [], [], 0
        for begin in range(0, len(every), INDEX_ROWS):
            part = slice(begin, begin + INDEX_ROWS)
            row = (serial, *sliced(every[part], rows[part]))
            serial += 1
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds, strict=True)],
                names=["block", "n_rows", "ids", "lowest", "widths", "slices"],
            )

    for batch in batches:
        if batch.num_rows:
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            lists.append(batch.column(1))
            held += batch.num_rows
        if held >= INDEX_ROWS:
            yield from flush()
    if held:
        yield from flush()


def build_index(vectors: DataFrame) -> DataFrame:
    """The bit-sliced index of every usable vector, stored; no row is shuffled for it."""
    return stored(quantised(vectors).mapInArrow(_build, INDEX), "slices")


def added(levels: dict[int, np.ndarray], words: int) -> list[np.ndarray]:
    """The sum, as bit slices from the least significant, of bitmaps given per weight.

    A full adder turns three bitmaps of a weight into one of it and one of the next.
    """
    total = []
    level = 0
    while levels:
        rows = levels.pop(level, np.zeros((0, words), np.uint64))
        carries = []
        while len(rows) > 2:
            third = len(rows) // 3
            a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
            either = a ^ b
            carries.append(a & b | either & c)
            rows = np.concatenate([either ^ c, rows[3 * third :]])
        if len(rows) == 2:
            carries.append(rows[:1] & rows[1:])
            rows = rows[:1] ^ rows[1:]
        total.append(rows[0] if len(rows) else np.zeros(words, np.uint64))
        if carries:
            above = [levels[level + 1]] if level + 1 in levels else []
            levels[level + 1] = np.concatenate(above + carries)
        level += 1
    return total


def selected(total: list[np.ndarray], rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows surely among the k highest sums, and of the boundary."""
    sure, level = np.zeros_like(rows), rows
    for bits in reversed(total):
        high = level & bits
        union = sure | high
        count = int(np.bitwise_count(union).sum())
        if count > k:
            level = high
        else:
            sure, level = union, level & ~bits
            if count == k:
                return sure, np.zeros_like(rows)
    return sure, level


class Block:
    """An index row opened for queries."""

    def __init__(self, n_rows, ids, lowest, widths, slices):
        self.n_rows, self.words = n_rows, -(-n_rows // 64)
        self.ids = np.frombuffer(ids, np.int64)
        self.lowest = np.frombuffer(lowest, np.int64)
        self.widths = np.frombuffer(widths, np.int64)
        plain = np.frombuffer(slices, np.uint64).reshape(-1, self.words)
        self.slices = np.concatenate([plain, ~plain])
        self.first = np.concatenate([[0], np.cumsum(self.widths)])
        self.every = bits_of(np.ones((1, n_rows), bool))[0]

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (id, score) of the block but the query's own rows."""
        width = max(len(query), len(self.lowest))
        query = np.pad(query, (0, width - len(query)))
        lowest = np.pad(self.lowest, (0, width - len(self.lowest)))
        # Whole numbers of any size: a sum may leave 64 bits on its way.
        base = sum(int(q) * int(low) for q, low in zip(query.tolist(), lowest.tolist(), strict=True))
        plain = len(self.slices) // 2
        chosen: dict[int, list[int]] = {}
        for d, bits in enumerate(self.widths.tolist()):
            factor = int(query[d])
            if factor < 0:  # -f * v is f * (ones - v) less f * ones
                base += factor * ((1 << bits) - 1)
            start = int(self.first[d]) + (plain if factor < 0 else 0)
            factor = abs(factor)
            shift = 0
            while factor:
                if factor & 1:
                    for i in range(bits):
                        chosen.setdefault(shift + i, []).append(start + i)
                factor >>= 1
                shift += 1
        total = added({at: self.slices[rows] for at, rows in chosen.items()}, self.words)
        rows = self.every & ~bits_of((self.ids == query_id)[None, :])[0]
        sure, edge = selected(total, rows, k)
        sure, edge = self.places(sure), self.places(edge)
        edge = edge[np.argsort(self.ids[edge], kind="stable")][: max(0, k - len(sure))]
        places = np.concatenate([sure, edge])
        scores = [base] * len(places)
        for weight, bits in enumerate(total):
            held = bits[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)
            for at in np.flatnonzero(held).tolist():
                scores[at] += 1 << weight
        if any(not -(1 << 63) <= score < 1 << 63 for score in scores):
            raise OverflowError(f"a score of query {query_id} does not fit 64 bits")
        return [(int(self.ids[p]), score) for p, score in zip(places, scores, strict=True)]

    def places(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _opened(queries: pa.StructArray) -> Iterator[tuple[int, np.ndarray]]:
    """The id and the components of each query of a pack."""
    ids, lists = queries.field(0).to_pylist(), queries.field(1)
    ends = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
    for query_id, begin, end in zip(ids, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield query_id, values[begin:end]


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for at in range(batch.num_rows):
                row = {n: batch.column(i)[at] for i, n in enumerate(names)}
                block = Block(
                    *[row[n].as_py() for n in ("n_rows", "ids", "lowest", "widths", "slices")]
                )
                out = []
                for query_id, query in _opened(row["queries"].values):
                    hits = block.top(query_id, query, k)
                    out += [(query_id, *hit) for hit in hits]
                columns = zip(*out, strict=True) if out else ([], [], [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    names=["query_id", "vec_id", "score"],
                )

    return search


def search(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k best rows of the index for each row (vec_id, q) of ``queries``.

    Query packs meet every group of index blocks by a sort-merge join: a pack is repeated for
    each group, so its size, which the planner knows once only, tells nothing of what a
    broadcast would hold in the driver. Packs travel in the narrowest numbers that hold them.
    """
    spark = index.sparkSession
    once = stored(queries.groupBy("vec_id").agg(F.min("q").alias("q")), "queries")
    largest = F.greatest(F.array_max("q"), -F.array_min("q"))
    n_queries, most = once.agg(F.count(F.lit(1)), F.coalesce(F.max(largest), F.lit(0))).first()
    blocks = max(1, -(-n_queries // QUERY_ROWS))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, min(tasks * 2 // blocks, index.count()))
    narrow = next((t for t, bits in (("smallint", 15), ("int", 31)) if most < 1 << bits), "bigint")
    numbered = once.select(
        "vec_id",
        F.col("q").cast(f"array<{narrow}>").alias("q"),
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("query_block"),
    )
    packs = numbered.groupBy("query_block").agg(
        F.collect_list(F.struct("vec_id", "q")).alias("queries")
    )
    dealt = packs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    parts = index.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    spread = parts.withColumn(
        "query_block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)"))
    )
    # A pair of blocks is few bytes and much work: tasks are not coalesced by their size.
    key, tasks = ["query_block", "part"], min(tasks, blocks * groups)
    pairs = spread.repartition(tasks, *key).join(dealt.repartition(tasks, *key).hint("merge"), key)
    pairs = pairs.drop(*key, "block")
    hits = pairs.mapInArrow(_search(k), HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.vec_id as query_id, b.vec_id,
         coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0)::bigint
           as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
"""
