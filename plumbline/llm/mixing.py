"""Mix sources to target weights by fixed-length blocks of words.

Words are packed per source into blocks of a fixed length. Every slot of an output shard
draws its source by a hashed uniform number, so a shard's counts are multinomial; draws
beyond a source's target are struck, and closing shards take what is short. A source's
slots run through a pseudorandom permutation of its block indexes per pass (swap-or-not
rounds, a bijection on any length), and a join by index fetches the words of the blocks.

Defined cases: a null text has size 0; a null source is a source, last in order; documents
of size 0 are taken 0 times; rows that repeat an id are documents of their own; an empty
table gives an empty result. Only the id, the text and the source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, quoted, stored, text_of

#: The weights of the contract, by the order of the sources.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
BLOCK_WORDS = 64
SHARD_SLOTS = 65_536
#: Slots that are made into rows together.
RUN = 4_096
ROUNDS = 12
BUCKET_DOCS = 8_192
SEED = 20_417


def sizes_of(docs: DataFrame) -> DataFrame:
    """Every document with its number of words."""
    words = F.regexp_count(text_of(), F.lit(WORD)).cast("bigint")
    return docs.select("doc_id", "source", words.alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: its size, weight and the words that the mix should take.

    Sharing by weight and resharing what exceeds a source's limit fills all sources to one
    level, min(limit, level * weight). Sorted by limit per weight, the level is the first
    at which the next source stays below its limit. The windows see one row per source.
    """
    by_source = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs")
    )
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("source_rank") % len(WEIGHTS) + 1)
    ranked = by_source.withColumn("source_rank", place - 1).withColumn("weight", weight)
    limits = ranked.withColumn("most", F.col("source_size") * float(MOST_PASSES)).withColumn(
        "filled_at", F.col("most") / F.col("weight")
    )
    rising = Window.orderBy("filled_at", "source_rank")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    left = SHARE * F.sum("source_size").over(everything) - F.coalesce(
        F.sum("most").over(before), F.lit(0.0)
    )
    open_weight = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(before), F.lit(0)
    )
    levels = limits.withColumn("level", left / open_weight)
    settled = F.min(F.when(F.col("filled_at") >= F.col("level"), F.struct("filled_at", "level")))
    level = settled.over(everything)["level"]
    target = F.least("most", F.coalesce(level * F.col("weight"), F.col("most")))
    return levels.withColumn("target", target).select(
        "source", "source_rank", "source_size", "source_docs", "weight", "target"
    )


def permuted(index: Column, length: Column, *key: Column, inverse: bool = False) -> Column:
    """Where a keyed pseudorandom permutation of 0..length-1 sends ``index``.

    A round pairs x with (k - x) mod length and swaps the pair by one hashed bit of it.
    """
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)

    def swap(x: Column, turn: Column) -> Column:
        pivot = F.pmod(F.xxhash64(F.lit(SEED), *key, turn), length)
        partner = F.pmod(pivot - x, length)
        bit = F.xxhash64(F.lit(SEED + 1), *key, turn, F.greatest(x, partner)).bitwiseAND(1)
        return F.when(bit == 1, partner).otherwise(x)

    turns = F.array(*[F.lit(turn) for turn in order])
    return F.aggregate(turns, index.cast("bigint"), swap)


def plan_of(sources: DataFrame, block: int) -> DataFrame:
    """Per source: blocks, full passes, the words of the last pass, and the slots in all."""
    need = sources.where("source_size > 0").withColumn("need", F.round("target").cast("bigint"))
    counted = need.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn(
        "full_passes", F.floor(F.col("need") / F.col("source_size"))
    )
    rest = F.col("need") - F.col("full_passes") * F.col("source_size")
    short = block - (F.col("source_size") - (F.col("blocks") - 1) * block)
    last_slots = F.when(
        F.col("rest") > 0, F.least("blocks", F.ceil((F.col("rest") + F.col("short")) / block))
    ).otherwise(0)
    short_at = permuted(
        F.col("blocks") - 1,
        F.col("blocks"),
        F.col("source_rank"),
        F.col("full_passes"),
        inverse=True,
    )
    return (
        counted.withColumn("rest", rest)
        .withColumn("short", short)
        .withColumn("short_at", short_at)
        .withColumn("slots", F.col("full_passes") * F.col("blocks") + last_slots)
    )


def draws(plan: DataFrame, shard_slots: int) -> DataFrame:
    """Ranges of slots (shard, source_rank, first, slots) that meet every source's number.

    The cumulated shares are one short array, one number per source.
    """
    running = F.sum("slots").over(Window.orderBy("source_rank"))
    shares = plan.select("source_rank", running.alias("upto"), "slots")
    table = shares.agg(
        F.array_sort(F.collect_list(F.struct("upto", "source_rank"))).alias("shares"),
        F.coalesce(F.sum("slots"), F.lit(0)).alias("all_slots"),
    )
    shards = F.ceil(F.col("all_slots") / shard_slots)
    spread = table.where("all_slots > 0").select(
        "shares", "all_slots", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard")
    )
    width = F.least(F.lit(shard_slots), F.col("all_slots") - F.col("shard") * shard_slots)
    uniform = F.pmod(F.xxhash64(F.lit(SEED + 2), "shard", "slot"), F.col("all_slots"))
    runs = spread.select("*", F.explode(F.sequence(F.lit(1), width, F.lit(RUN))).alias("begin"))
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    upto = F.least(F.col("begin") + RUN - 1, width)
    each = runs.repartition(tasks, "shard", "begin").select(
        "shares", "all_slots", "shard", F.explode(F.sequence("begin", upto)).alias("slot")
    )
    drawn = F.filter(F.col("shares"), lambda s: s["upto"] > F.col("uniform"))[0]["source_rank"]
    counts = (
        each.withColumn("uniform", uniform)
        .groupBy("shard", drawn.alias("source_rank"))
        .agg(F.count(F.lit(1)).alias("drawn"))
    )
    earlier = Window.partitionBy("source_rank").orderBy("shard")
    first = F.sum("drawn").over(earlier) - F.col("drawn")
    placed = counts.withColumn("first", first).join(
        plan.select("source_rank", F.col("slots").alias("most")), "source_rank"
    )
    within = placed.where(F.col("first") < F.col("most")).select(
        "shard",
        "source_rank",
        "first",
        F.least("drawn", F.col("most") - F.col("first")).alias("slots"),
    )
    reached = within.groupBy("source_rank").agg(F.sum("slots").alias("reached"))
    short = (
        plan.select("source_rank", F.col("slots").alias("most"))
        .join(reached, "source_rank", "left")
        .withColumn("reached", F.coalesce("reached", F.lit(0)))
        .where("reached < most")
    )
    closing = short.select(
        F.lit(-1).cast("bigint").alias("shard"),
        "source_rank",
        F.col("reached").alias("first"),
        (F.col("most") - F.col("reached")).alias("slots"),
    )
    return within.unionByName(closing)


def slots_of(plan: DataFrame, ranges: DataFrame, block: int) -> DataFrame:
    """Every output slot: shard, source, the block that it takes and how many of its words."""
    keys = ["source_rank", "blocks", "full_passes", "rest", "short", "short_at"]
    wide = ranges.join(plan.select(*keys), "source_rank")
    # Short runs of slots are dealt evenly before each slot becomes a row.
    last = F.col("first") + F.col("slots") - 1
    runs = wide.select("*", F.explode(F.sequence("first", last, F.lit(RUN))).alias("begin"))
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartition(tasks, "source_rank", "begin")
    upto = F.least(F.col("begin") + RUN - 1, last)
    each = dealt.select("*", F.explode(F.sequence("begin", upto)).alias("slot"))
    turn = F.floor(F.col("slot") / F.col("blocks"))
    place = F.col("slot") % F.col("blocks")
    timed = each.withColumn("pass", turn).withColumn("place", place)
    before = F.col("place") * block - F.when(
        F.col("place") > F.col("short_at"), F.col("short")
    ).otherwise(0)
    words = F.when(F.col("pass") < F.col("full_passes"), F.lit(block)).otherwise(
        F.least(F.lit(block), F.col("rest") - before)
    )
    chosen = permuted(F.col("place"), F.col("blocks"), F.col("source_rank"), F.col("pass"))
    return timed.select(
        "shard", "source_rank", "pass", chosen.alias("block"), words.alias("words")
    ).where("words > 0")


def packed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with its first word's place in its source, in a hashed order.

    Sums per hashed bucket come first, so that no source is ordered in one task.
    """
    known = sizes.join(
        sources.drop("weight"), sizes["source"].eqNullSafe(sources["source"])
    ).drop(sources["source"])
    buckets = F.ceil(F.col("source_docs") / BUCKET_DOCS)
    spot = F.xxhash64(F.lit(SEED + 3), "doc_id")
    placed = known.withColumn("spot", spot).withColumn("bucket", F.pmod("spot", buckets))
    totals = placed.groupBy("source_rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source_rank").orderBy("bucket")
    starts = totals.withColumn(
        "bucket_first", F.sum("bucket_size").over(earlier) - F.col("bucket_size")
    ).drop("bucket_size")
    own = Window.partitionBy("source_rank", "bucket").orderBy("spot", "doc_id", "size")
    ordered = placed.withColumn("place", F.row_number().over(own)).withColumn(
        "within",
        F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
    )
    return ordered.join(starts, ["source_rank", "bucket"]).select(
        "doc_id", "source", "size", "source_size", "target", "source_rank", "bucket", "place",
        (F.col("bucket_first") + F.col("within")).alias("first_word"),
    )


def pieces_of(documents: DataFrame, block: int) -> DataFrame:
    """The part of each document in each block that it touches, in words of the block."""
    first, size = F.col("first_word"), F.col("size")
    touched = F.sequence(F.floor(first / block), F.floor((first + size - 1) / block))
    each = documents.where("size > 0").select(
        "source_rank", "bucket", "place", "first_word", "size", F.explode(touched).alias("block")
    )
    start = F.col("block") * block
    begin = F.greatest(first - start, F.lit(0))
    return each.select(
        "source_rank",
        "block",
        "bucket",
        "place",
        begin.alias("begin"),
        F.least(first + size - start, F.lit(block)).alias("end"),
        (start + begin - first).alias("doc_word"),
    )


class Mix:
    """The mix of ``docs``: its documents, sources and output slots as stored tables."""

    def __init__(
        self, docs: DataFrame, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS
    ):
        self.block = block
        sizes = stored(sizes_of(docs), "sizes")
        self.sources = stored(targets(sizes), "sources")
        self.documents = stored(packed(sizes, self.sources), "packed")
        self.plan = stored(plan_of(self.sources, block), "plan")
        self.ranges = stored(draws(self.plan, shard_slots), "draws")

    def shards(self) -> DataFrame:
        """Every taken piece: output shard, pass, document key and its words begin..end."""
        slots = slots_of(self.plan, self.ranges, self.block)
        pieces = pieces_of(self.documents, self.block)
        taken = F.least("end", "words") - F.col("begin")
        return (
            # Files tell nothing of the rows made out of them here: never broadcast.
            slots.join(pieces.hint("merge"), ["source_rank", "block"])
            .where(taken > 0)
            .select("shard", "pass", "source_rank", "block", "bucket", "place", "doc_word",
                    taken.alias("taken"))
        )

    def taken(self) -> DataFrame:
        """One row per document with the words that the mix takes of it."""
        key = ["source_rank", "bucket", "place"]
        sums = self.shards().groupBy(*key).agg(F.sum("taken").alias("taken"))
        return self.documents.join(sums.hint("merge"), key, "left").select(
            "doc_id", "size", "source_size", "target",
            F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        )


def mixed(docs: DataFrame, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The documents of the mix, with their own columns: one row per document and pass.

    A pass that takes all words of a document returns its text as it is; one that takes a
    part returns the words taken, in order, joined by spaces. ``n_chars`` follows the text.
    """
    numbered = docs.select(
        F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("doc"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(numbered, "mixed-input")  # the rows' numbers now are values
    mix = Mix(rows.select(F.col("row").alias("doc_id"), "doc.source", "doc.text"), block, shard_slots)
    keys = mix.documents.select(
        F.col("doc_id").alias("row"), "size", "source_rank", "bucket", "place"
    )
    passes = mix.shards().groupBy("source_rank", "bucket", "place", "pass").agg(
        F.array_sort(F.collect_list(F.struct("doc_word", "taken"))).alias("ranges"),
        F.sum("taken").alias("words"),
    )
    taken = passes.join(keys.hint("merge"), ["source_rank", "bucket", "place"]).select(
        "row", F.when(F.col("words") < F.col("size"), F.col("ranges")).alias("ranges")
    )
    words = F.regexp_extract_all(text_of("doc.text"), F.lit(f"({WORD})"), F.lit(1))

    def pieces(words: Column) -> Column:
        return F.transform(
            "ranges", lambda r: F.slice(words, r["doc_word"].cast("int") + 1, r["taken"].cast("int"))
        )

    # The words are bound as the one element of a list, so that a text is split once.
    parts = F.flatten(F.get(F.transform(F.array(words), pieces), F.lit(0)))
    text = F.when(F.col("ranges").isNull(), F.col("doc.text")).otherwise(F.array_join(parts, " "))
    each = rows.join(taken.hint("merge"), "row").withColumn("mixed_text", text)
    replaced = {"text": F.col("mixed_text"), "n_chars": F.char_length("mixed_text").cast("bigint")}
    own = [replaced.get(c, F.col(f"doc.{quoted(c)}")).alias(c) for c in docs.columns]
    return each.select(*own)
