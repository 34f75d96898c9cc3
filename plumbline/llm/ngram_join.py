"""Similarity join of documents by the Jaccard similarity of their word n-grams.

Equal sets are one set. Sets that link share an n-gram among the first few of each in one
common order, so these n-grams deal the sets into groups. The order puts n-grams of little
used slots of a count sketch first, which keeps what many texts share out of the groups;
any order gives the same result. Of groups with the same members one is kept, and of its
members those that the bitmaps let link with another; sets without any such partner, most
where texts share words by chance, go no further and are not built.

In a group a signature tree is walked against itself. Its leaves are token bitmaps of sets,
its nodes the OR of what is below, with the range of sizes: a pair of nodes is left as soon
as the overlap possible at most is less than the least needed. What remains is compared
exactly, by whole sets. Groups of near copies are joined first by links to a few leaders;
the tree leaves pairs of nodes that are joined already. In its first turns a task also takes
the labels of a pair that it hands out for joined, so that it hands out a forest of pairs
and not all pairs of a group; which of them link is found out after it. A group that hands
out no pair has none and is left by the turns after it. After a forest without a link comes
the last turn. It hands out every pair whose labels still differ, so no link is lost. A large group is cut into
cells, and pairs of cells are walked in tasks of their own.

Links are counted inside components, where all of them are: every pair of sets of a
component is pruned by the trees without their labels and then compared exactly. A
component is cut into cells too, and only sums per set leave a task.

Defined cases: a null text counts as empty; a text without words has no n-grams and links
with nothing; rows that repeat an id are documents of their own, with their own sets; an
empty table gives an empty result. Hashes of n-grams have 64 bits, those of sets 128. Only
the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, batches, stored
from plumbline.llm.graph import components

SKETCH_BITS = 20
SKETCH_PARTS = 64
#: Characters of the texts that are hashed together, but for one longer text.
RUN_CHARS = 1_000_000
#: Turns in which sets meet one leader of a group each, at most.
LEADERS = 3
#: Sets and n-grams of a cell, but for one larger set; a task holds two cells.
CELL = 2_048
CELL_GRAMS = 8_000_000
#: Turns of trees that hand out forests, before the one that hands out all that is left.
FORESTS = 2
#: The bounds of a cell in which links are counted.
LINK_CELL = 1_024
LINK_GRAMS = 2_000_000
#: Pairs that are compared at once.
LINK_PAIRS = 200_000
#: Bits a token of the bitmaps that all sets have; those of sets with partners have more.
BRIEF = 2
LEAF = 8
MEMO_WORDS = 1_000_000
FILTER_BITS = (20, 28)

_FACTORS = np.random.default_rng(90_210).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def coded(texts: list[str | None], memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of some texts, and where each text begins and the last ends."""
    # Bytes fold A-Z and split at ASCII space alone.
    tokens = [(text or "").encode("utf-8", "replace").lower().split() for text in texts]
    ends = np.cumsum([0, *map(len, tokens)])
    codes = np.fromiter(map(memo.__getitem__, chain.from_iterable(tokens)), np.uint64, ends[-1])
    return codes, ends


def slid(values: np.ndarray, size: int, join) -> np.ndarray:
    """``join`` of every ``size`` neighbours."""
    out = values[: len(values) - size + 1].copy()
    for at in range(1, size):
        join(out, values[at : at + len(out)], out=out)
    return out


def ngrams(
    texts: list[str | None], words: int, memo: WordHashes, ranks: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Per text the sorted distinct hashes of its n-grams, and their ranks by rarest word.

    Fewer words are one n-gram.
    """
    codes, ends = coded(texts, memo)
    plain = mixed(codes)
    rank = None if ranks is None else ranks[slots(codes)]
    whole = len(codes) - words + 1
    if whole > 0:
        total = np.full(whole, words, np.uint64) * _FACTORS[-1]
        for at in range(words):
            total += plain[at : at + whole] * _FACTORS[at]
        every = mixed(total)
        least = None if rank is None else slid(rank, words, np.minimum)
    for begin, end in pairwise(ends.tolist()):
        n = end - begin
        if n >= words:
            part = slice(begin, end - words + 1)
            if rank is None:
                yield np.unique(every[part]), None
            else:
                found, first = np.unique(every[part], return_index=True)
                yield found, least[part][first]
        elif n:
            one = np.full(1, n, np.uint64) * _FACTORS[-1]
            one += (plain[begin:end] * _FACTORS[:n]).sum(dtype=np.uint64)
            yield mixed(one), None if rank is None else rank[begin:end].min(keepdims=True)
        else:
            yield np.zeros(0, np.uint64), None if rank is None else np.zeros(0, np.int64)


def _texts(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts in runs of about ``RUN_CHARS`` characters."""
    ids, texts, size = [], [], 0
    for part in parts:
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= RUN_CHARS or len(ids) >= RUN_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def slots(codes: np.ndarray) -> np.ndarray:
    return (mixed(codes) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch(docs: DataFrame) -> np.ndarray:
    """A rank per slot by how many words of all documents fall in it; its size is fixed."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, total = WordHashes(), np.zeros(1 << SKETCH_BITS, np.int64)
        for _, texts in _texts(parts):
            total += np.bincount(slots(coded(texts, memo)[0]), minlength=1 << SKETCH_BITS)
        rows = [pa.compress(part.tobytes(), codec="zstd", asbytes=True)
                for part in np.split(total, SKETCH_PARTS)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(rows, pa.binary())],
            names=["part", "counts"],
        )

    room = 8 * (1 << SKETCH_BITS) // SKETCH_PARTS

    def counts_in(data: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(data, room, codec="zstd", asbytes=True), np.int64)

    def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, 0
        for batch in group:
            for key, counts in zip(batch.column(0), batch.column(1), strict=True):
                part, total = key.as_py(), total + counts_in(counts.as_py())
        packed = pa.compress(total.tobytes(), codec="zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([packed], pa.binary())],
            names=["part", "counts"],
        )

    partial = docs.selectExpr("doc_id", "text").mapInArrow(count, "part int, counts binary")
    rows = partial.groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    total = np.zeros((SKETCH_PARTS, room // 8), np.int64)
    for part, counts in rows:
        total[part] = counts_in(counts)
    ranks = total.ravel() + 1.0
    np.log2(ranks, out=ranks)
    ranks *= 1 << 17
    return ranks.astype(np.int32)  # below 2**24


def bitmap(hashes: np.ndarray, room: int = 4) -> bytes:
    """A token bitmap of at least ``room`` bits a token; a power of two, 64 or more."""
    width = max(64, 1 << int(room * len(hashes) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()),
     ("first", pa.list_(pa.int64())), ("bits", pa.binary())]
)


def set_key(hashes: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Every document with its set's size, key, first n-grams and small bitmap; stored."""
    order = docs.sparkSession.sparkContext.broadcast(sketch(docs))

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        memo = WordHashes()
        for ids, texts in _texts(parts):
            found = ngrams(texts, words, memo, order.value)
            for doc_id, (hashes, ranks) in zip(ids, found, strict=True):
                n = len(hashes)
                if not n:
                    yield doc_id, 0, b"", [], b""
                    continue
                shared = n - -(-percent * n // 100) + 1
                place = ranks.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24)
                at = np.argpartition(place, shared - 1)[:shared]
                yield doc_id, n, set_key(hashes), hashes[at].view(np.int64), bitmap(hashes, BRIEF)

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(rows(parts), SIGNED, 1024)

    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    schema = "doc_id bigint, n bigint, set_key binary, first array<bigint>, bits binary"
    # Stored with the rows' own numbers, which stand for sets from here on.
    return stored(
        texts.mapInArrow(sign, schema).withColumn("id", F.monotonically_increasing_id()), "signed"
    )


def candidates(rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(token, id, sets, grams) for one row of each set and the groups by a shared first n-gram.

    Of groups with the same members one is kept; ``sets`` is how many they are and ``grams``
    their sizes together. Members that no other is near enough in size to link with are left.
    """
    known = rows.where("n > 0").select("set_key", "id")
    one = known.groupBy("set_key").agg(F.min("id").alias("least"))
    # Sent to every task only while its written size is small; else both sides are shuffled.
    again = scratch.stored(known.join(one, "set_key").where("id > least").select("id"), "again")
    tokens = rows.join(again, "id", "left_anti").select(
        "id", "n", F.explode("first").alias("token")
    )
    # One shuffle serves the groups' sums and the join with them: both read the same columns,
    # and the filter, which the join would put on its side alone, is on both.
    spread = tokens.where("token is not null").repartition("token")
    groups = spread.groupBy("token").agg(
        F.count("id").alias("sets"),
        F.sum("n").alias("grams"),
        F.bit_xor(F.xxhash64("id")).alias("mark"),
        F.min("id").alias("least"),
        F.max("id").alias("most"),
    )
    kept = groups.where("sets > 1").groupBy("sets", "grams", "mark", "least", "most").agg(
        F.min("token").alias("token")
    )
    by_size = Window.partitionBy("token").orderBy("n")
    sized = spread.join(kept.select("token", "sets", "grams"), "token").select(
        "token", "id", "sets", "grams", "n",
        F.lag("n").over(by_size).alias("less"), F.lead("n").over(by_size).alias("more"),
    )
    near = sized.where(f"100 * less >= {percent} * n or 100 * n >= {percent} * more")
    found = scratch.stored(near.select("token", "id", "sets", "grams"), "tokens")
    scratch.release(again)
    scratch.clean()
    return found


def with_partners(
    rows: DataFrame, members: DataFrame, percent: int, scratch: Scratch
) -> DataFrame:
    """(token, id) for the members that the bitmaps let link with another of their group.

    Members of a group too large for a cell are kept unseen.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = (F.col("sets") > CELL) | (F.col("grams") > CELL_GRAMS)
    dealt = (
        members.where(~large)
        .join(rows.select("id", "n", "bits"), "id")
        .select("token", "id", "n", "bits")
        .repartition(tasks, "token")
        .sortWithinPartitions("token")
    )
    schema = pa.schema([("token", pa.int64()), ("id", pa.int64())])

    def groups(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        key, held = None, []
        for part in parts:
            for token, own, n, bits in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if token != key:
                    yield from ((key, kept) for kept in partnered(held, percent))
                    key, held = token, []
                held.append((own, own, n, bits, 3))
        yield from ((key, kept) for kept in partnered(held, percent))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(groups(parts), schema)

    walked = dealt.mapInArrow(run, "token bigint, id bigint")
    whole = members.where(large).select("token", "id")
    found = scratch.stored(walked.unionByName(whole), "partners")
    scratch.release(members)
    scratch.clean()
    return found


class Filter:
    """A Bloom filter of document ids of bounded size; what it lets pass wrongly is joined out."""

    def __init__(self, ids: DataFrame):
        low, high = FILTER_BITS
        self.bits = min(high, max(low, (16 * ids.count()).bit_length()))
        ends = [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(1 << self.bits)) for k in range(3)]
        places = ids.select(F.explode(F.array(*ends)).alias("place"))
        table = (
            places.groupBy(F.shiftright("place", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bit"))
            .toArrow()
        )
        self.words = np.zeros(1 << (self.bits - 6), np.int64)
        self.words[table["word"].to_numpy()] = table["bit"].to_numpy()

    def holds(self, *places: int) -> bool:
        return all(self.words[p >> 6] >> (p & 63) & 1 for p in places)


def sets_of(
    docs: DataFrame, rows: DataFrame, wanted: DataFrame, words: int, scratch: Scratch
) -> DataFrame:
    """(id, n, set_key, hashes, bits) of the wanted ids, from the texts of documents that may have them.

    Stored in buckets by key, so that whatever asks for sets is sent to them and they stay.
    """
    keys = scratch.stored(
        rows.select("set_key", "id", "n", "doc_id").join(wanted, "id", "left_semi"), "wanted"
    )
    passing = Filter(keys.select("doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(passing)
    schema = pa.schema([("set_key", pa.binary()), ("hashes", pa.binary()), ("bits", pa.binary())])
    places = [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(1 << passing.bits)) for k in range(3)]

    def some(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            marks = zip(*(column.to_pylist() for column in part.columns[2:]), strict=True)
            yield part.select([0, 1]).filter(pa.array([shared.value.holds(*m) for m in marks], pa.bool_()))

    def found(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        memo = WordHashes()
        for _, texts in _texts(some(parts)):
            for hashes, _ in ngrams(texts, words, memo):
                if len(hashes):
                    yield set_key(hashes), hashes.tobytes(), bitmap(hashes)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(found(parts), schema, 256)

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    marked = own.select("doc_id", "text", *[p.alias(f"p{k}") for k, p in enumerate(places)])
    texts = marked.mapInArrow(read, "set_key binary, hashes binary, bits binary")
    # One shuffle by key serves the sum over rows of one set, the join and the buckets.
    once = texts.groupBy("set_key").agg(
        F.first("hashes").alias("hashes"), F.first("bits").alias("bits")
    )
    found_sets = scratch.bucketed(
        once.join(keys.select("set_key", "id", "n"), "set_key").select(
            "id", "n", "set_key", "hashes", "bits"
        ),
        "sets",
        "set_key",
    )
    scratch.release(keys)
    scratch.clean()
    return found_sets


def verified(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets; stored.

    ``pairs`` is stored and then released. Sets whose sizes are too far apart to link are
    not looked at. The other pairs are sent to the sets' buckets and not the sets to them:
    first, as ids and keys alone, to the set of b, which as a leader may be in very many,
    and from there with it to the set of a.
    """
    keys = sets.select("id", "set_key", "n")
    keyed = (
        pairs.join(keys.toDF("a", "a_key", "a_n"), "a")
        .join(keys.toDF("b", "b_key", "b_n"), "b")
        .where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
        .select("a", "b", "a_key", "b_key")
    )
    others = sets.select(F.col("set_key").alias("b_key"), F.col("hashes").alias("b_hashes"))
    own = sets.select(F.col("set_key").alias("a_key"), F.col("hashes").alias("a_hashes"))
    both = keyed.join(others, "b_key").drop("b_key").join(own, "a_key").select(
        "a", "b", "a_hashes", "b_hashes"
    )

    def linked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = []
            for left, right in zip(part.column(2), part.column(3), strict=True):
                x = np.frombuffer(left.as_py(), np.uint64)
                y = np.frombuffer(right.as_py(), np.uint64)
                every = len(np.union1d(x, y))
                keep.append(100 * (len(x) + len(y) - every) >= percent * every)
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = scratch.stored(both.mapInArrow(linked, "a bigint, b bigint"), "linked")
    scratch.release(pairs)
    scratch.clean()
    return links


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with the label of each id; an id without one is its own."""
    return members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def relabelled(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The labels after more links: the labels' own graph is joined and looked up.

    The old labels and the links are released.
    """
    ends = labels.withColumnRenamed("id", "a").withColumnRenamed("label", "x")
    other = labels.withColumnRenamed("id", "b").withColumnRenamed("label", "y")
    lifted = links.join(ends, "a", "left").join(other, "b", "left").select(
        F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")
    )
    found = components(lifted.where("a <> b").distinct(), scratch)
    roots = found.select(F.col("id").alias("label"), F.col("label").alias("root"))
    old = labels.join(roots, "label", "left").select(
        "id", F.coalesce("root", "label").alias("label")
    )
    fresh = found.join(labels.select("id"), "id", "left_anti")
    after = scratch.stored(old.unionByName(fresh.select("id", "label")), "labels")
    scratch.release(found, labels, links)
    return after


def centred(members: DataFrame, scratch: Scratch) -> DataFrame:
    """``members`` with how central each set is: the sizes of all its groups together.

    The text that copies were made from is in more and larger groups than any copy.
    """
    sizes = members.groupBy("token").agg(F.count(F.lit(1)).alias("size"))
    central = members.join(sizes, "token").groupBy("id").agg(F.sum("size").alias("central"))
    found = scratch.stored(members.join(central, "id"), "centred")
    scratch.release(members)
    return found


def leader_pairs(members: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """Each set with one leader of one of its groups that is not joined with it yet.

    In the first turn a group's leader is its most central member. After that only those
    not joined with it are left, led by the most central or, in odd turns, by the member of
    the least hash.
    """
    known = labelled(members, labels)

    def led(rows: DataFrame, order: Column) -> DataFrame:
        best = rows.groupBy("token").agg(F.max(F.struct(order, "id", "label")).alias("leader"))
        return rows.join(best, "token").where(F.col("leader.label") != F.col("label"))

    pairs = led(known, F.col("central"))
    if turn:
        order = F.xxhash64("id", F.lit(turn)) if turn % 2 else F.col("central")
        pairs = led(pairs.drop("leader"), order)
    return pairs.groupBy(F.col("id").alias("a")).agg(F.max("leader").alias("leader")).select(
        "a", F.col("leader.id").alias("b")
    )


def cells(
    sets: DataFrame, members: DataFrame, labels: DataFrame, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """Open groups cut into cells: their members, and the pairs of cells to walk.

    A group is open while its members have several labels; of groups with the same members
    one is kept. Members of a label too large for a cell fill cells of their own, and pairs
    of such cells of one label need no walk.
    """
    known = labelled(members, labels)
    marks = known.groupBy("token").agg(
        F.count(F.lit(1)).alias("sets"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark"),
        F.min("id").alias("least"),
        F.max("id").alias("most"),
        F.min("label").alias("low"),
        F.max("label").alias("high"),
    )
    opened = marks.where("low < high").groupBy("sets", "mark", "least", "most").agg(
        F.min("token").alias("token")
    )
    sized = known.join(opened.select("token"), "token").join(sets.select("id", "n"), "id")
    inside = scratch.stored(sized.select("token", "id", "label", "n"), "open")

    def parts(sets: str, grams: str) -> Column:
        return F.ceil(F.greatest(F.col(sets) / CELL, F.col(grams) / CELL_GRAMS))

    def sizes(prefix: str) -> list[Column]:
        return [F.count(F.lit(1)).alias(f"{prefix}_sets"), F.sum("n").alias(f"{prefix}_grams")]

    large = (
        inside.groupBy("token", "label").agg(*sizes("own")).withColumn(
            "own", parts("own_sets", "own_grams")
        ).where("own > 1")
    )
    whole = inside.groupBy("token").agg(*sizes("all")).select(
        "token", parts("all_sets", "all_grams").alias("bundles")
    )
    split = inside.join(whole, "token").join(
        large.select("token", "label", "own"), ["token", "label"], "left"
    )
    placed = split.select(
        "token",
        "id",
        "label",
        F.when(F.col("own").isNull(), F.lit(-1)).otherwise(F.col("label")).alias("cell_label"),
        F.when(F.col("own").isNull(), F.pmod(F.xxhash64("label"), "bundles"))
        .otherwise(F.pmod(F.xxhash64("id"), "own"))
        .alias("cell_part"),
    )
    cell = F.struct("cell_label", "cell_part")
    placed = scratch.stored(placed.select("token", "id", "label", cell.alias("cell")), "cells")
    scratch.release(inside)
    every = placed.select("token", "cell").distinct()
    pairs = every.withColumnRenamed("cell", "x").join(
        every.withColumnRenamed("cell", "y"), "token"
    )
    walked = pairs.where(
        "x <= y and (x.cell_label = -1 or x.cell_label <> y.cell_label)"
    )
    return placed, walked


class Labels(dict):
    """Labels that links join: every label's root, itself unless joined."""

    def root(self, label: int) -> int:
        top = label
        while (above := self.get(top, top)) != top:
            top = above
        while label != top:
            self[label], label = top, self.get(label, label)
        return top

    def join(self, a: int, b: int) -> None:
        self[self.root(a)] = self.root(b)


class Node:
    """A node of a signature tree: the OR of the bitmaps below and what bounds an overlap."""

    __slots__ = ("bits", "children", "ids", "label", "least", "most", "spare")

    def __init__(self, children: list, ids: tuple | None = None):
        self.children, self.ids = children, ids

    @classmethod
    def leaf(cls, key: int, label: int, n: int, bits: int, side: int) -> Node:
        node = cls([], (key, side))
        node.bits, node.label, node.least, node.most = bits, label, n, n
        node.spare = n - bits.bit_count()  # tokens that share a bit with another
        return node

    @classmethod
    def above(cls, children: list[Node]) -> Node:
        node = cls(children)
        node.bits = 0
        for child in children:
            node.bits |= child.bits
        labels = {child.label for child in children}
        node.label = labels.pop() if len(labels) == 1 else None
        node.least = min(child.least for child in children)
        node.most = max(child.most for child in children)
        node.spare = max(child.spare for child in children)
        return node

    def root(self, joined: Labels | None) -> int | None:
        """The one label below after all links so far, or None where there are several."""
        if joined is None:
            return self.label
        if self.label is None and self.children:
            below = {child.root(joined) for child in self.children}
            if len(below) == 1:
                self.label = below.pop()
        return None if self.label is None else joined.root(self.label)


def tree_of(leaves: list[Node]) -> Node:
    """A tree of nodes of a few children, over leaves of one label or size side by side."""
    level = sorted(leaves, key=lambda leaf: (leaf.label or 0, leaf.most, leaf.ids))
    while len(level) > 1:
        level = [Node.above(level[at : at + LEAF]) for at in range(0, len(level), LEAF)]
    return level[0]


def walk(
    left: Node, right: Node, percent: int, joined: Labels | None = None
) -> Iterator[tuple[int, int]]:
    """Pairs of ids below two nodes that the bitmaps let link and that are not joined by then.

    Without ``joined``, every such pair. A caller may join labels between two pairs.
    """
    stack = [(left, right)]
    while stack:
        a, b = stack.pop()
        if joined is not None:
            own = a.root(joined)
            if own is not None and own == b.root(joined):
                continue
        if 100 * a.most < percent * b.least or 100 * b.most < percent * a.least:
            continue
        possible = min((a.bits & b.bits).bit_count() + min(a.spare, b.spare), a.most, b.most)
        needed = -(-percent * (a.least + b.least) // (100 + percent))
        if possible < needed:
            continue
        if a.children and (not b.children or a.most - a.least >= b.most - b.least):
            if a is b:
                stack += [(x, y) for k, x in enumerate(a.children) for y in a.children[k:]]
            else:
                stack += [(child, b) for child in a.children]
        elif b.children:
            stack += [(a, child) for child in b.children]
        elif a.ids[0] != b.ids[0]:
            apart = min(
                a.most - (a.bits & ~b.bits).bit_count(), b.most - (b.bits & ~a.bits).bit_count()
            )
            if apart >= needed:
                yield min(a.ids[0], b.ids[0]), max(a.ids[0], b.ids[0])


def fold(bits: int, width: int) -> int:
    """A bitmap of ``width`` bits as one of half of them."""
    half = width // 2
    return bits >> half | bits & ((1 << half) - 1)


def met(
    members: list[tuple], percent: int, joined: Labels | None = None
) -> Iterator[tuple[int, int]]:
    """Pairs to compare among ``members`` (id, label, n, bits, sides) of a pair of cells.

    Sides tell the cells: 1, 2 or, of a cell with itself, 3. Bitmaps of one width meet as
    they are, those of the next width folded; sizes of sets that link are not further apart.
    Each pair comes once. With ``joined``, pairs of one label are left.
    """
    widths: dict[int, list[tuple]] = {}
    for member in members:
        widths.setdefault(8 * len(member[3]), []).append(member)

    def nodes(width: int, side: int, folded: bool = False) -> list[Node]:
        found = []
        for key, label, n, raw, sides in widths.get(width, []):
            if sides & side:
                bits = int.from_bytes(raw, "little")
                found.append(Node.leaf(key, label, n, fold(bits, width) if folded else bits, side))
        return found

    itself = any(member[4] == 3 for member in members)
    for width in widths:
        if itself:
            meetings = [(nodes(width, 1), None), (nodes(width, 1), nodes(2 * width, 1, True))]
        else:
            meetings = [
                (nodes(width, 1), nodes(width, 2)),
                (nodes(width, 1), nodes(2 * width, 2, True)),
                (nodes(width, 2), nodes(2 * width, 1, True)),
            ]
        for left, right in meetings:
            if left and right is None:
                root = tree_of(left)
                yield from walk(root, root, percent, joined)
            elif left and right:
                yield from walk(tree_of(left), tree_of(right), percent, joined)


class Sets:
    """Whole sets of a task under small numbers, so that an overlap is a sum over marks."""

    def __init__(self, ids: list[int], hashes: list[bytes]):
        self.at = {key: at for at, key in enumerate(ids)}
        self.sizes = np.array([len(data) // 8 for data in hashes], np.int64)
        every = np.frombuffer(b"".join(hashes), np.uint64)
        known, codes = np.unique(every, return_inverse=True)
        self.codes = np.split(codes, np.cumsum(self.sizes)[:-1])
        self.marks = np.zeros(len(known), bool)
        self.marked: int | None = None

    def mark(self, at: int) -> None:
        if self.marked != at:
            if self.marked is not None:
                self.marks[self.codes[self.marked]] = False
            self.marks[self.codes[at]] = True
            self.marked = at


def partnered(members: list[tuple], percent: int) -> list[int]:
    """Ids of ``members`` (id, id, n, bits, 3) that the bitmaps let link with another.

    A forest of pairs names each of them: a pair is left out only when pairs handed out
    before have joined both its ends.
    """
    found = {key for pair in pairs_in(members, percent, True) for key in pair}
    return [member[0] for member in members if member[0] in found]


def pairs_in(members: list[tuple], percent: int, forest: bool) -> Iterator[tuple[int, int]]:
    """Pairs to compare among ``members`` (id, label, n, bits, sides), of labels that differ.

    A forest takes the labels of every pair handed out for joined from then on.
    """
    joined, label_of = Labels(), {member[0]: member[1] for member in members}
    for a, b in met(members, percent, joined):
        if forest:
            joined.join(label_of[a], label_of[b])
        yield a, b


def counted(members: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """(id, documents it links with) for ``members`` (id, hashes, copies, sides)."""
    if not members:
        return
    sets = Sets([m[0] for m in members], [m[1] for m in members])
    sizes, copies = sets.sizes, np.array([m[2] for m in members], np.int64)
    total = np.zeros(len(members), np.int64)
    signs = [
        (m[0], None, len(m[1]) // 8, bitmap(np.frombuffer(m[1], np.uint64)), m[3]) for m in members
    ]
    pairs = met(signs, percent)
    while some := list(islice(pairs, LINK_PAIRS)):
        partners: dict[int, list[int]] = {}
        for a, b in some:
            partners.setdefault(sets.at[a], []).append(sets.at[b])
        for a, others in partners.items():
            sets.mark(a)
            # A few at a time, as their n-grams are laid side by side.
            for begin in range(0, len(others), 256):
                part = np.array(others[begin : begin + 256])
                starts = np.cumsum(sizes[part]) - sizes[part]
                laid = sets.marks[np.concatenate([sets.codes[b] for b in part])]
                both = np.add.reduceat(laid.astype(np.int64), starts)
                part = part[100 * both >= percent * (sizes[a] + sizes[part] - both)]
                total[a] += copies[part].sum()
                total[part] += copies[a]
    for at in np.flatnonzero(total).tolist():
        yield members[at][0], int(total[at])


def tree_pairs(
    sets: DataFrame,
    members: DataFrame,
    labels: DataFrame,
    percent: int,
    forest: bool,
    scratch: Scratch,
) -> tuple[DataFrame, DataFrame]:
    """The pairs of sets, not joined yet, that signature trees of their groups leave; stored.

    Of a forest, per pair of cells fewer than it has members. Then the members of groups
    that gave a pair: in all others no pair that may link has two labels. ``members`` is
    released.
    """
    placed, walked = cells(sets, members, labels, scratch)
    numbered = walked.withColumn("pair", F.xxhash64("token", "x", "y"))
    both = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("cell"), F.lit(3).alias("sides")))).otherwise(
        F.array(
            F.struct(F.col("x").alias("cell"), F.lit(1).alias("sides")),
            F.struct(F.col("y").alias("cell"), F.lit(2).alias("sides")),
        )
    )
    sides = numbered.select("token", "pair", F.explode(both).alias("side")).select(
        "token", "pair", F.col("side.cell").alias("cell"), F.col("side.sides").alias("sides")
    )
    loaded = sides.join(placed, ["token", "cell"]).select("token", "pair", "sides", "id", "label")
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        loaded.join(sets.select("id", "n", "bits"), "id")
        .select("token", "pair", "sides", "id", "label", "n", "bits")
        .repartition(tasks, "pair", "token")
        .sortWithinPartitions("pair", "token")
    )
    schema = pa.schema([("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def walked_pairs(key: tuple, held: list[tuple]) -> Iterator[tuple[int, int, int]]:
        return ((key[1], a, b) for a, b in pairs_in(held, percent, forest))

    def groups(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int]]:
        key, held = None, []
        for part in parts:
            for token, pair, side, *member in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (pair, token) != key:
                    yield from walked_pairs(key, held)
                    key, held = (pair, token), []
                held.append((*member, side))
        yield from walked_pairs(key, held)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(groups(parts), schema)

    found = scratch.stored(dealt.mapInArrow(run, "token bigint, a bigint, b bigint"), "found")
    pairs = scratch.stored(found.select("a", "b").distinct(), "pairs")
    gave = found.select("token").distinct()
    left = scratch.stored(members.join(gave, "token", "left_semi"), "members")
    scratch.release(placed, found, members)
    return pairs, left


def link_counts(
    rows: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, scratch: Scratch
) -> DataFrame:
    """(id, n) with how many documents of other sets link with each set that has a link.

    Sets that link are of one component, so the pairs of a component's cells meet every
    link once, whichever n-grams its ends share.
    """
    copies = rows.where("n > 0").groupBy("set_key").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")
    )
    known = labels.join(rows.select("id", "n"), "id").join(copies, "id")
    room = known.groupBy("label").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("grams"))
    parts = F.ceil(F.greatest(F.col("sets") / LINK_CELL, F.col("grams") / LINK_GRAMS))
    placed = known.join(room.select("label", parts.alias("parts")), "label").withColumn(
        "cell", F.pmod(F.xxhash64("id"), F.col("parts"))
    )
    # Each set goes to the pairs of its cell with every cell; x <= y names a pair.
    with_other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sides = F.when(F.col("cell") == F.col("other"), 3).when(F.col("cell") < F.col("other"), 1)
    asked = scratch.stored(
        with_other.select(
            "label",
            F.least("cell", "other").alias("x"),
            F.greatest("cell", "other").alias("y"),
            "id", "set_key", "copies",
            sides.otherwise(2).alias("sides"),
        ),
        "asked",
    )
    dealt = (
        asked.join(sets.select("set_key", "hashes"), "set_key")
        .select("label", "x", "y", "id", "hashes", "copies", "sides")
        .repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "label", "x", "y")
        .sortWithinPartitions("label", "x", "y")
    )
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def groups(batches_in: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        key, held = None, []
        for part in batches_in:
            for *own, key_id, hashes, times, side in zip(
                *(c.to_pylist() for c in part.columns), strict=True
            ):
                if own != key:
                    yield from counted(held, percent)
                    key, held = own, []
                held.append((key_id, hashes, times, side))
        yield from counted(held, percent)

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(groups(batches_in), schema)

    found = dealt.mapInArrow(run, "id bigint, n bigint")
    links = scratch.stored(found.groupBy("id").agg(F.sum("n").alias("n")), "links")
    scratch.release(asked)
    scratch.clean()
    return links


def joined(
    docs: DataFrame, words: int, percent: int, scratch: Scratch
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows, the whole sets that may link, and the labels of those that do."""
    rows = signed(docs, words, percent)
    members = with_partners(rows, candidates(rows, percent, scratch), percent, scratch)
    members = centred(members, scratch)
    sets = sets_of(docs, rows, members.select("id").distinct(), words, scratch)
    none = members.select("id", F.col("id").alias("label")).limit(0)
    labels = scratch.stored(none, "labels")
    for turn in range(LEADERS):
        pairs = scratch.stored(leader_pairs(members, labels, turn), "pairs")
        links = verified(pairs, sets, percent, scratch)
        if not links.isEmpty():
            labels = relabelled(labels, links, scratch)
            continue
        scratch.release(links)
        if turn:
            break
    same = False
    for forest in [True] * FORESTS + [False]:
        # Without a link the labels stay, and the next forest would be of the same pairs.
        if forest and same:
            continue
        pairs, members = tree_pairs(sets, members, labels, percent, forest, scratch)
        if pairs.isEmpty():
            break
        links = verified(pairs, sets, percent, scratch)
        same = links.isEmpty()
        if same:
            scratch.release(links)
        else:
            labels = relabelled(labels, links, scratch)
    scratch.release(members)
    return rows, sets, labels


def components_of(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document.

    Two documents link when their n-grams are similar by ``percent`` hundredths or more; a
    component's id is the smallest document id that links reach.
    """
    scratch = Scratch(docs.sparkSession)
    rows, _, labels = joined(docs, words, percent, scratch)
    scratch.release_all_but(labels)
    return labelled_documents(rows, labels).drop("n_links")


def links_of(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``components_of`` with ``n_links``: how many other documents link with each.

    Documents of one set link with each other and count, as do all links between sets.
    """
    scratch = Scratch(docs.sparkSession)
    rows, sets, labels = joined(docs, words, percent, scratch)
    links = link_counts(rows, sets, labels, percent, scratch)
    scratch.release_all_but(labels, links)
    return labelled_documents(rows, labels, links)


def labelled_documents(
    rows: DataFrame, labels: DataFrame, links: DataFrame | None = None
) -> DataFrame:
    """The smallest document id of each component, brought back to all its documents."""
    known = rows.where("n > 0").select("doc_id", "n", "set_key", "id")
    heads = known.groupBy("set_key").agg(
        F.min("id").alias("id"),
        F.min("doc_id").alias("least"),
        (F.count(F.lit(1)) - 1).alias("n_links"),
    )
    if links is not None:
        heads = heads.join(links.withColumnRenamed("n", "more"), "id", "left").withColumn(
            "n_links", F.col("n_links") + F.coalesce("more", F.lit(0))
        )
    named = labelled(heads, labels).select("set_key", "label", "least", "n_links")
    parts = named.groupBy("label").agg(F.min("least").alias("component_id"))
    keyed = named.join(parts, "label").select("set_key", "component_id", "n_links")
    found = known.join(keyed, "set_key").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links"
    )
    none = F.lit(0).cast("bigint")
    empty = rows.where("n = 0").select(
        "doc_id", none.alias("n_shingles"), F.col("doc_id").alias("component_id"), none.alias("n_links")
    )
    return found.unionByName(empty)


def representatives(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with their columns.

    Texts without words link with nothing and stay. Rows that repeat an id stay or go
    together: they go if one of them links to a smaller id.
    """
    found = components_of(docs, words, percent)
    leaving = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Sent to every task only while its written size is small; else both sides are shuffled.
    scratch = Scratch(docs.sparkSession)
    gone = scratch.stored(leaving.select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")
