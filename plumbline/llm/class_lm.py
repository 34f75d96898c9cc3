"""Scores of texts by a class-based bigram model with exchange clustering.

Every word of at least a stated count gets a class by exchange: it moves to the class that
raises the likelihood of the class bigrams most. The commonest words are clustered one after
another, over their bigrams, until none moves. All others are settled in two rounds by
Spark: the words beside each are counted as rows (word, class beside it, count), and every
word moves at once against the class bigrams, which is a matrix of bounded size, as long as
the likelihood rises. The first round settles the numbered words, of which there is a stated
maximum, by the classes on both sides; the second all words beyond, by the class before. The
counts and the classes of these are tables that grow with the corpus.

The model of a word after another is P(class | history) * P(word | class), both smoothed,
where the history is the class of a numbered word before, and one of its own for all others.
A text's score is the log10 probability of its words and its end. Words below the stated
count form one class with those that the training texts lack. A text's numbered words are
scored where it is read; only its other words meet the table of classes in a shuffled join,
summed per distinct word and history of a text.

Defined cases: a null text counts as empty and holds only its end; a null id is trained on;
without training texts every count is 0; rows that repeat an id each give a row; words of
equal count are taken in the order of their bytes; texts are read whole. Only the id and the
text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import held_out, stored

#: Words with numbers, and those of them that are clustered one by one: the bounds of what
#: is sent to every task and to the driver.
NUMBERED = 50_000
CLUSTERED = 1_000
CLASSES = 40
SWEEPS = 6
#: Rarer words have no class of their own, and how often all others move at most in a round.
LEAST = 3
MOVES = 3
#: The class of rare and unknown words, and the history at the start.
REST, START = CLASSES, CLASSES + 1
#: Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 400_000
#: Pairs of word and neighbour that a task holds, and words that it moves at once.
HELD_PAIRS = 300_000
MOVED_WORDS = 1_000
#: Tokens of texts in a row that a task looks up at once, but for one longer text.
HELD_CHAIN = 200_000
#: Tokens that a task counts at once, but for one longer text.
HELD_TOKENS = 1_000_000

#: The smoothing of the base score.
ADDED = 0.1
#: Weight of the share of a class among all words in a class's followers.
BACK_OFF = 2.0
END = b"\n"  # no word holds white space


def tokens_of(text: str | None) -> list[bytes]:
    """The words in lower case and the end; bytes fold A-Z and split at ASCII space alone."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def _counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
            names=["word", "n"],
        )

    for part in parts:
        for text in part.column(0):
            held.update(tokens_of(text.as_py()))
            if len(held) > HELD_WORDS:
                yield rows()
                held.clear()
    if held:
        yield rows()


def word_counts(training: DataFrame) -> DataFrame:
    """Every distinct token of the training texts with its count."""
    partial = training.select("text").mapInArrow(_counts, "word binary, n bigint")
    return stored(partial.groupBy("word").agg(F.sum("n").alias("n")), "words")


def numbered(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The commonest words with counts, at most ``most``, by count and word.

    How many words have each count tells which counts fit whole, so that only words of the
    next count are sorted.
    """
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    taken, least, cut = 0, None, None
    for n, words in sizes.orderBy(F.desc("n")).limit(most).collect():
        if taken + words > most:
            cut = n
            break
        taken, least = taken + words, n
    pairs = []
    if least is not None:
        pairs.append(counts.where(F.col("n") >= least))
    if cut is not None and taken < most:
        pairs.append(counts.where(F.col("n") == cut).orderBy("word").limit(most - taken))
    found = []
    for part in pairs:
        table = part.toArrow()
        found += zip(table["word"].to_pylist(), table["n"].to_pylist(), strict=True)
    return sorted(found, key=lambda pair: (-pair[1], pair[0]))


@dataclass
class Numbers:
    """Numbers of the words clustered one by one, then of all others and of the start."""

    words: list[bytes]

    def __post_init__(self):
        self.of = {word: at for at, word in enumerate(self.words)}
        self.rest = len(self.words)
        self.start = self.rest + 1
        self.size = self.start + 1


class Lookup(dict):
    """A word's number or class, or that of all words beyond."""

    def __init__(self, of: dict[bytes, int], rest: int):
        super().__init__(of)
        self.rest = rest

    def __missing__(self, word: bytes) -> int:
        return self.rest


def bigrams(training: DataFrame, numbers: Numbers) -> np.ndarray:
    """How often a number follows another in the training texts; the start precedes all."""
    shared = training.sparkSession.sparkContext.broadcast(numbers)
    size = numbers.size

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        lookup = Lookup(known.of, known.rest)
        total = np.zeros(size * size, np.int64)

        def add(chain: list[int]) -> None:
            at = np.array(chain, np.int64)
            pairs = (at[:-1] * size + at[1:])[at[1:] != known.start]
            np.add(total, np.bincount(pairs, minlength=size * size), out=total)

        chain: list[int] = []
        for part in parts:
            for text in part.column(0):
                chain.append(known.start)
                chain += map(lookup.__getitem__, tokens_of(text.as_py()))
                if len(chain) > HELD_TOKENS:
                    add(chain)
                    chain = []
        add(chain)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], ["pair", "n"])

    partial = training.select("text").mapInArrow(count, "pair bigint, n bigint")
    table = partial.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # size * size at most
    matrix = np.zeros(size * size, np.int64)
    matrix[table["pair"].to_numpy()] = table["n"].to_numpy()
    return matrix.reshape(size, size)


def _x_log_x(values: np.ndarray) -> np.ndarray:
    return values * np.log(np.maximum(values, 1.0))


def exchange(matrix: np.ndarray, movable: int, classes: int, sweeps: int) -> np.ndarray:
    """The class of every number: the first ``movable`` are clustered, others stand alone.

    The likelihood of class bigrams is sum n(g,h) log n(g,h) less twice sum n(g) log n(g),
    up to a constant. Only rows and columns of the two classes concerned change in a move.
    """
    size = len(matrix)
    own = min(classes, max(1, movable))
    of = np.concatenate([np.arange(movable) % own, own + np.arange(size - movable)])
    total = own + size - movable
    member = np.zeros((size, total))
    member[np.arange(size), of] = 1.0
    counts = member.T @ matrix @ member
    after = matrix @ member  # per word and class that follows
    before = matrix.T @ member
    single = np.diag(matrix).astype(float)

    def gain_of(rows, columns, corners):
        """Sum of n log n over the rows and columns of each class, corners once."""
        return _x_log_x(rows).sum(1) + _x_log_x(columns).sum(1) - _x_log_x(corners)

    for _ in range(sweeps):
        moved = 0
        for word in range(movable):
            a = of[word]
            right, left, loop = after[word].copy(), before[word].copy(), single[word]
            # Take the word out of its class.
            counts[a] -= right
            counts[:, a] -= left
            counts[a, a] += loop
            right[a] -= loop
            left[a] -= loop
            plain = counts[:own]
            columns = counts[:, :own].T
            corners = np.diag(counts)[:own]
            rows_with, columns_with = plain + right, columns + left
            every = np.arange(own)
            corners_with = corners + right[:own] + left[:own] + loop
            rows_with[every, every] = corners_with
            columns_with[every, every] = corners_with
            joint = gain_of(rows_with, columns_with, corners_with) - gain_of(
                plain, columns, corners
            )
            out, into = plain.sum(1), columns.sum(1)
            alone = (
                _x_log_x(out + right.sum() + loop) + _x_log_x(into + left.sum() + loop)
                - _x_log_x(out) - _x_log_x(into)
            )
            b = int((joint - alone).argmax())
            counts[b] += right
            counts[:, b] += left
            counts[b, b] += loop
            if b != a:
                moved += 1
                of[word] = b
                after[:, a] -= matrix[:, word]
                after[:, b] += matrix[:, word]
                before[:, a] -= matrix[word]
                before[:, b] += matrix[word]
        if not moved:
            break
    return of


#: A word that is not in the classes yet and whose neighbours are counted.
PENDING = START + 1
HISTORIES = START + 1
#: Cells of the matrix travel as rows of no word: a blank and the history.
CELL = b" "


def contexts(training: DataFrame, of: dict[bytes, int], both: bool) -> DataFrame:
    """What stands beside every pending word, and how often class follows class.

    Words of ``of`` have their class or are marked pending, and words beyond are of the rest
    if ``both`` sides are counted, else pending too. A slot is the history before a word, or
    ``HISTORIES`` and the class after it. One exchange, by word, of counts summed per task.
    """
    pending = [word for word, own in of.items() if own == PENDING]
    codes = {word: own for word, own in of.items() if own != PENDING}
    codes |= {word: PENDING + at for at, word in enumerate(pending)}
    codes[None] = START
    shared = training.sparkSession.sparkContext.broadcast((codes, pending))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, pending = shared.value
        lookup = Lookup(codes, REST if both else PENDING)
        cells = np.zeros(HISTORIES * HISTORIES, np.int64)
        near = np.zeros(len(pending) * 2 * HISTORIES, np.int64)  # NUMBERED rows at most
        held: Counter = Counter()
        suffix = [bytes([history]) for history in range(HISTORIES)]

        for tokens in _chains(parts):
            own = np.fromiter(map(lookup.__getitem__, tokens), np.int64, len(tokens))
            open_ = own >= PENDING
            history = np.where(open_, REST, own)
            known = np.flatnonzero(~open_ & (own != START))
            pairs = history[known - 1] * HISTORIES + own[known]
            cells += np.bincount(pairs, minlength=len(cells))
            at = np.flatnonzero(open_)
            if both:
                place = (own[at] - PENDING) * 2 * HISTORIES
                slots = place + history[at - 1]
                near += np.bincount(slots, minlength=len(near))
                # A pair of pending words counts once, by its second; a last word has no next.
                place, after = place[at < len(tokens) - 1], at[at < len(tokens) - 1] + 1
                right = ~open_[after] & (own[after] != START)
                slots = place[right] + HISTORIES + history[after[right]]
                near += np.bincount(slots, minlength=len(near))
                continue
            for start in range(0, len(at), HELD_PAIRS):
                some = at[start : start + HELD_PAIRS]
                before = history[some - 1].tolist()
                held.update(
                    [tokens[i] + suffix[h] for i, h in zip(some.tolist(), before, strict=True)]
                )
                if len(held) > HELD_PAIRS:
                    yield _held_rows(held)
                    held.clear()
        if held:
            yield _held_rows(held)
        words = pa.array(pending, pa.binary())
        found = np.flatnonzero(near)
        for start in range(0, len(found), HELD_PAIRS):
            at = found[start : start + HELD_PAIRS]
            yield _context_rows(words.take(pa.array(at // (2 * HISTORIES))),
                                at % (2 * HISTORIES), near[at])
        at = np.flatnonzero(cells)
        words = [CELL + b"%d" % history for history in at // HISTORIES]
        yield _context_rows(pa.array(words, pa.binary()), at % HISTORIES, cells[at])

    partial = training.select("text").mapInArrow(count, "word binary, slot int, n bigint")
    sums = partial.repartition("word").groupBy("word", "slot").agg(F.sum("n").alias("n"))
    beside = F.struct("slot", "n")
    left = F.when(F.col("slot") < HISTORIES, F.col("n"))
    return stored(
        sums.groupBy("word").agg(
            F.coalesce(F.sum(left), F.lit(0)).alias("n"),
            F.array_sort(F.collect_list(beside)).alias("beside"),  # 2 * HISTORIES at most
        ),
        "contexts",
    )


def _chains(parts: Iterator[pa.RecordBatch]) -> Iterator[list[bytes | None]]:
    """The tokens of many texts in a row, with None at the start of each."""
    chain: list[bytes | None] = []
    for part in parts:
        for text in part.column(0):
            chain.append(None)
            chain += tokens_of(text.as_py())
            if len(chain) > HELD_CHAIN:
                yield chain
                chain = []
    if chain:
        yield chain


def _held_rows(held: Counter) -> pa.RecordBatch:
    words = pa.array([pair[:-1] for pair in held], pa.binary())
    return _context_rows(words, [pair[-1] for pair in held], list(held.values()))


def _context_rows(words, slots, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [words, pa.array(slots, pa.int32()), pa.array(counts, pa.int64())],
        names=["word", "slot", "n"],
    )


def cells_of(found: DataFrame) -> np.ndarray:
    """The matrix of classes after histories that the counting of contexts met."""
    cell = F.substring("word", 1, 1) == F.lit(CELL)
    rows = found.where(cell).select("word", F.explode("beside").alias("at")).select("word", "at.*")
    matrix = np.zeros((HISTORIES, HISTORIES))
    for word, slot, n in rows.collect():  # HISTORIES squared at most
        matrix[int(bytes(word)), slot] = n
    return matrix


def likelihood(matrix: np.ndarray) -> float:
    """The log likelihood of the class bigrams but for what no exchange changes."""
    return float(
        _x_log_x(matrix).sum() - _x_log_x(matrix.sum(0)).sum() - _x_log_x(matrix.sum(1)).sum()
    )


class Moves:
    """The classes of words after moving against each of ``matrices`` in turn."""

    def __init__(self, matrices: list[np.ndarray], both: bool):
        self.both = both
        self.steps = []
        for matrix in matrices:
            slots = np.concatenate([matrix[:, :CLASSES], matrix[:CLASSES].T])
            self.steps.append((slots, matrix.sum(0)[:CLASSES], matrix.sum(1)[:CLASSES]))

    def classes(self, first: np.ndarray, slot: np.ndarray, times: np.ndarray) -> np.ndarray:
        """A class per word; a word's slots begin at its place in ``first``."""
        word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(slot))))
        left = np.add.reduceat(np.where(slot < HISTORIES, times, 0.0), first)
        right = np.add.reduceat(np.where(slot < HISTORIES, 0.0, times), first)
        of = None
        for slots, into, out in self.steps:
            base = slots[slot]
            totals = [(np.repeat(into[None], len(first), 0), left)]
            if self.both:
                totals.append((np.repeat(out[None], len(first), 0), right))
            if of is not None:  # a word is taken out of its class before it moves
                base[np.arange(len(slot)), of[word]] -= times
                for total, own in totals:
                    total[np.arange(len(first)), of] -= own
            gain = np.add.reduceat(_x_log_x(base + times[:, None]) - _x_log_x(base), first)
            for total, own in totals:
                gain -= _x_log_x(total + own[:, None]) - _x_log_x(total)
            of = gain.argmax(1)
        return np.where(left < LEAST, REST, of)


def _moved(found: DataFrame, moves: Moves, output: str, emit) -> DataFrame:
    """What ``emit`` makes of every batch's words, counts, slots and classes."""
    shared = found.sparkSession.sparkContext.broadcast(moves)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start in range(0, part.num_rows, MOVED_WORDS):
                rows = part.slice(start, MOVED_WORDS)
                lists = rows.column(2)
                ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                flat = lists.flatten()
                slot = flat.field(0).to_numpy(zero_copy_only=False)
                times = flat.field(1).to_numpy(zero_copy_only=False).astype(float)
                of = shared.value.classes(ends[:-1], slot, times)
                yield emit(rows, np.repeat(of, np.diff(ends)), of, slot, times)

    words = found.where(F.substring("word", 1, 1) != F.lit(CELL))
    return words.select("word", "n", "beside").mapInArrow(run, output)


def _cells(rows, each, of, slot, times) -> pa.RecordBatch:
    """The change of the matrix by a batch's words, as its cells."""
    change = np.zeros(HISTORIES * HISTORIES)
    left = slot < HISTORIES
    np.add.at(change, slot[left] * HISTORIES + each[left], times[left])
    after = slot[~left] - HISTORIES
    np.add.at(change, each[~left] * HISTORIES + after, times[~left])
    np.add.at(change, REST * HISTORIES + after, -times[~left])  # it stood there as one of the rest
    at = np.flatnonzero(change)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(change[at])], ["cell", "n"])


def _classes(rows, each, of, slot, times) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [rows.column(0), rows.column(1), pa.array(of, pa.int32())], ["word", "n", "class"]
    )


def settled(found: DataFrame, both: bool) -> tuple[DataFrame, np.ndarray]:
    """Every pending word with its count and class, and the matrix with all words in it."""
    start = cells_of(found)
    matrices, kept, best, final = [start], [start], -math.inf, start
    for _ in range(MOVES):
        change = _moved(found, Moves(matrices, both), "cell bigint, n double", _cells)
        matrix = start.copy()
        for cell, n in change.groupBy("cell").agg(F.sum("n")).collect():  # HISTORIES squared
            matrix[cell // HISTORIES, cell % HISTORIES] += n
        value = likelihood(matrix)
        if value <= best:
            break
        kept, best, final = list(matrices), value, matrix
        matrices.append(matrix)
    return _moved(found, Moves(kept, both), "word binary, n bigint, class int", _classes), final


@dataclass
class Model:
    """What scoring needs of the numbered words, and the sums for all others."""

    words: dict[bytes, tuple[int, int]]  # class and count of every numbered word
    transition: np.ndarray  # log10 P(class | history)
    totals: np.ndarray  # per class, what a share of it is divided by
    tokens: int
    distinct: int

    def places(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
        """Every numbered word's place, and by place, with one for all words beyond, the
        class, the log10 share of the class and the log10 of the base."""
        own = np.array([of for of, _ in self.words.values()], int)
        n = np.array([n for _, n in self.words.values()], float)
        share = np.log10((n + ADDED) / self.totals[own])
        base = np.log10((n + ADDED) / self.base_of)
        at = {word: place for place, word in enumerate(self.words)}
        return at, np.append(own, REST), np.append(share, 0.0), np.append(base, 0.0)

    @property
    def base_of(self) -> float:
        return self.tokens + ADDED * (self.distinct + 1)


def train(training: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the table of the words without numbers: count and class."""
    counts = word_counts(training)
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    common = numbered(counts, NUMBERED)
    numbers = Numbers([word for word, n in common[:CLUSTERED] if n >= LEAST])
    classes = exchange(bigrams(training, numbers), numbers.rest, CLASSES, SWEEPS)
    of = {word: int(classes[at]) for word, at in numbers.of.items()}
    marked = of | {word: PENDING for word, _ in common if word not in of}
    if len(marked) > len(of):
        near, _ = settled(contexts(training, marked, both=True), both=True)
        table = near.select("word", "class").toArrow()  # NUMBERED rows at most
        of |= zip(table["word"].to_pylist(), table["class"].to_pylist(), strict=True)
    far, pairs = settled(contexts(training, of, both=False), both=False)
    far = stored(far, "classes")
    # A class's share among all words, and that share as pseudo-counts after each history.
    share = pairs.sum(0) + ADDED
    share[START] = 0.0
    share /= share.sum()
    with np.errstate(divide="ignore"):
        transition = np.log10(
            (pairs + BACK_OFF * share) / (pairs.sum(1, keepdims=True) + BACK_OFF)
        )
    members = np.bincount([of[word] for word, _ in common], minlength=HISTORIES).astype(float)
    for own, n in far.groupBy("class").agg(F.count(F.lit(1))).collect():
        members[own] += n
    totals = pairs.sum(0) + ADDED * (members + 1)
    words = {word: (of[word], n) for word, n in common}
    return Model(words, transition, totals, row[0], row[1]), far


SCORED_SQL = (
    "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double, "
    "others array<struct<word:binary,history:int,n:bigint>>"
)


def score(docs: DataFrame, model: Model, far: DataFrame) -> DataFrame:
    """One row per text with the base and the model's log10 probability."""
    shared = docs.sparkSession.sparkContext.broadcast((model.places(), model.transition))

    def near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (places, own_of, share_of, base_of), steps = shared.value
        lookup = Lookup(places, len(places))

        def rows(ids: list, tokens: list[bytes], sizes: list[int]) -> pa.RecordBatch:
            place = np.fromiter(map(lookup.__getitem__, tokens), np.int64, len(tokens))
            first = np.cumsum([0, *sizes[:-1]])
            own, known = own_of[place], place < len(places)
            before = np.concatenate([[START], own[:-1]])
            before[first] = START
            step = np.where(known, steps[before, own] + share_of[place], 0.0)
            text = np.repeat(np.arange(len(ids)), sizes)
            at = np.flatnonzero(~known)
            others = Counter(
                zip(text[at].tolist(), [tokens[i] for i in at.tolist()], before[at].tolist(),
                    strict=True)
            )  # in the order of the texts
            each = np.bincount(np.array([k for k, _, _ in others], int), minlength=len(ids))
            flat = pa.StructArray.from_arrays(
                [pa.array([word for _, word, _ in others], pa.binary()),
                 pa.array([history for _, _, history in others], pa.int32()),
                 pa.array(list(others.values()), pa.int64())],
                names=["word", "history", "n"],
            )
            ends = pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(np.add.reduceat(known.astype(np.int64), first)),
                 pa.array(np.add.reduceat(base_of[place], first)),
                 pa.array(np.add.reduceat(step, first)),
                 pa.ListArray.from_arrays(ends, flat)],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score", "others"],
            )

        ids, tokens, sizes = [], [], []
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                own = tokens_of(text.as_py())
                ids.append(doc_id)
                tokens += own
                sizes.append(len(own))
                if len(tokens) > HELD_CHAIN:
                    yield rows(ids, tokens, sizes)
                    ids, tokens, sizes = [], [], []
        if ids:
            yield rows(ids, tokens, sizes)

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    # Ids may repeat: a row's own number keeps rows apart, and is read from a stored table.
    read = stored(
        rows.mapInArrow(near, SCORED_SQL).withColumn("row", F.monotonically_increasing_id()),
        "near",
    )
    each = read.select("row", F.explode("others").alias("other")).select(
        "row", F.col("other.word").alias("word"), F.col("other.history").alias("history"),
        F.col("other.n").alias("times"),
    )
    count = F.coalesce("n", F.lit(0))
    own = F.coalesce("class", F.lit(REST))
    step = F.element_at(F.lit(_finite(model.transition)), F.col("history") * HISTORIES + own + 1)
    total = F.element_at(F.lit(_finite(model.totals)), own + 1)
    far_of = each.join(far, "word", "left").groupBy("row").agg(
        F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("far_known"),
        F.sum(F.col("times") * F.log10((count + ADDED) / model.base_of)).alias("far_base"),
        F.sum(F.col("times") * (step + F.log10((count + ADDED) / total))).alias("far_score"),
    )
    added = {
        "n_known": F.col("n_known") + F.coalesce("far_known", F.lit(0)),
        "base_score": F.col("base_score") + F.coalesce("far_base", F.lit(0.0)),
        "score": F.col("score") + F.coalesce("far_score", F.lit(0.0)),
    }
    return read.drop("others").join(far_of, "row", "left").select(
        "doc_id",
        held_out(10).alias("held_out"),
        "n_tokens",
        added["n_known"].alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        added["base_score"].alias("base_score"),
        added["score"].alias("score"),
        (-added["score"] / F.col("n_tokens")).alias("log10_perplexity"),
    )


def _finite(values: np.ndarray) -> list[float]:
    """The cells in a row; no word is of the start's class, which alone is not finite."""
    return np.where(np.isfinite(values), values, 0.0).ravel().tolist()


def scored(docs: DataFrame) -> DataFrame:
    """Train on the rows outside the held-out tenth and score all."""
    return score(docs, *train(docs.where(~held_out(10))))
