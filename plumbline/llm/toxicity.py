"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of lexicons, hits near a second person, capitals, punctuation
and obfuscation. The lexicons, of words and of word beginnings, are learned from the
labelled sample: entries far more frequent in toxic texts. Features of a training text come
from the lexicons of the other folds, as do the scores that the calibration is fitted on.

Defined cases: a null text counts as empty; an empty text has all features 0 and the score
that the trees give for that; without both labels in the sample every score is the share
of toxic rows, 0 without any; texts are read whole; rows that repeat an id each give a row.
Only the id and the text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import held_out
from plumbline.llm.learning import learned, sampled

WORDS = re.compile(r"[^\W\d_]+")
BROKEN = re.compile(r"[a-z]+(?:[0-9@$*!]+[a-z]+)+")
MARKS = re.compile(r"[!?]{2,}")
#: Signs that stand for letters.
UNMASKED = str.maketrans("013457@$!", "oieastasi")
#: Second persons of the corpus's languages.
SECOND = frozenset(
    "you your yours youre yourself du dich dir dein deine ihr euch sie tu te toi ton vous votre "
    "tú ti usted vosotros ustedes".split()
)
NEAR = 5
THRESHOLD = 0.5
BEGINNINGS = (4, 5, 6, 7)
LEVELS = (0, *BEGINNINGS)  # 0: whole words
LEAST_DOCS, LEAST_ODDS, MOST_TERMS = 3, 1.5, 2_000
MEMO_WORDS = 200_000

UPPER = bytes(range(65, 91))
STOPS = b"!?"
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def terms(word: str) -> list[str]:
    """What a word counts as, by level; a beginning only of a longer word."""
    return [word, *[word[:n] if len(word) > n else "" for n in BEGINNINGS]]


class Uses:
    """How often each text uses the terms that enough toxic texts share, and their words."""

    def __init__(self, texts: list[str], labels: list[int]):
        toxic = [text for text, label in zip(texts, labels, strict=True) if label]
        self.shared: set[tuple[int, str]] = set()
        for level in range(len(LEVELS)):  # one level at a time, to hold few counts
            docs = Counter()
            for text in toxic:
                docs.update({terms(word)[level] for word in set(WORDS.findall(text.lower()))})
            self.shared |= {(level, term) for term, n in docs.items() if term and n >= LEAST_DOCS}
        memo = Memo(lambda word: [key for key in keyed(word) if key in self.shared])
        self.by_text: list[Counter] = []
        self.words: list[int] = []
        self.labels = labels
        for text in texts:
            words = WORDS.findall(text.lower())
            self.words.append(len(words))
            self.by_text.append(Counter(key for hits in map(memo.__getitem__, words) for key in hits))

    def sums(self, texts) -> tuple[list[Counter], list[int], Counter]:
        """Uses and words by label over some texts, and toxic texts per term."""
        uses, totals, docs = [Counter(), Counter()], [1, 1], Counter()
        for at in texts:
            label = self.labels[at]
            uses[label].update(self.by_text[at])
            totals[label] += self.words[at]
            if label:
                docs.update(self.by_text[at].keys())
        return uses, totals, docs


def keyed(word: str) -> list[tuple[int, str]]:
    return [(level, term) for level, term in enumerate(terms(word)) if term]


class Lexicons:
    """Per level the entries over-represented in toxic texts, with their log odds."""

    def __init__(self, uses: list[Counter], totals: list[int], docs: Counter):
        found: list[dict[str, float]] = [{} for _ in LEVELS]
        for key, n in docs.items():
            if n >= LEAST_DOCS:
                bad = math.log((uses[1][key] + 0.5) / totals[1])
                odds = bad - math.log((uses[0][key] + 0.5) / totals[0])
                if odds >= LEAST_ODDS:
                    found[key[0]][key[1]] = odds
        self.odds = [
            dict(sorted(level.items(), key=lambda item: (-item[1], item[0]))[:MOST_TERMS])
            for level in found
        ]

    def hits(self, word: str) -> tuple[tuple[int, str, float], ...]:
        """(level, entry, log odds) of every entry that the word hits."""
        return tuple(
            (level, term, self.odds[level][term])
            for level, term in enumerate(terms(word))
            if term in self.odds[level]
        )


def minus(every, some):
    """The sums over all texts but some."""
    uses = [Counter(a) for a in every[0]]
    for own, other in zip(uses, some[0], strict=True):
        own.subtract(other)
    docs = Counter(every[2])
    docs.subtract(some[2])
    return uses, [a - b + 1 for a, b in zip(every[1], some[1], strict=True)], docs


class Memo(dict):
    """Hits by word, forgotten when there are too many."""

    def __init__(self, hits: Callable[[str], Sequence]):
        super().__init__()
        self.hits = hits

    def __missing__(self, word: str):
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self[word] = self.hits(word)
        return found


N_FEATURES = 4 * len(LEVELS) + 9


def features(text: str, memo: Memo) -> list[float]:
    """The dense features of a whole text."""
    low = text.lower()
    words = WORDS.findall(low)
    n = len(words)
    out = [0.0] * N_FEATURES
    if not text:
        return out
    found = [(at, hit) for at, hit in enumerate(map(memo.__getitem__, words)) if hit]
    per_level = [Counter() for _ in LEVELS]
    weight = [0.0] * len(LEVELS)
    near = 0
    for at, hits in found:
        for level, term, odds in hits:
            per_level[level][term] += 1
            weight[level] += odds
        near += not SECOND.isdisjoint(words[max(0, at - NEAR) : at + NEAR + 1])
    for level, counts in enumerate(per_level):
        total = sum(counts.values())
        out[4 * level : 4 * level + 4] = [
            total / (n or 1),
            math.log1p(total),
            max(counts.values(), default=0) / (n or 1),
            weight[level] / (n or 1),
        ]
    raw = text.encode("utf-8", "replace")
    size = len(raw)
    letters = size - len(raw.translate(None, LETTERS))
    capitals = size - len(raw.translate(None, UPPER))
    masked = BROKEN.findall(low)
    unmasked = sum(bool(memo[w.translate(UNMASKED).replace("*", "")]) for w in masked)
    out[4 * len(LEVELS) :] = [
        near / (n or 1),
        math.log1p(near),
        capitals / (letters or 1),
        (size - len(raw.translate(None, STOPS))) / size,
        len(MARKS.findall(text)) / (n or 1),
        len(masked) / (n or 1),
        unmasked / (n or 1),
        math.log1p(n),
        len(found) / (n or 1),
    ]
    return out


@dataclass
class Trees:
    """Boosted regression trees on binned features for the logistic loss."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    smooth: float = 2.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple]] = field(default_factory=list)
    start: float = 0.0

    def binned(self, rows: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(self.edges)]
        return np.stack(columns, axis=1) if columns else np.zeros((len(rows), 0), int)

    def fit(self, rows: np.ndarray, labels: np.ndarray) -> Trees:
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = []
        for f in range(rows.shape[1]):  # zero is a bin of its own: most lexicons miss
            some = rows[:, f][rows[:, f] > 0]
            cuts = np.quantile(some, quantiles) if len(some) else np.zeros(0)
            self.edges.append(np.unique(np.concatenate([[0.0], cuts])))
        bins = self.binned(rows)
        share = np.clip(labels.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        margin = np.full(len(rows), self.start)
        self.trees = []
        for _ in range(self.rounds):
            chance = 1 / (1 + np.exp(-margin))
            tree: list[tuple] = []
            self._grow(bins, labels - chance, chance * (1 - chance), np.arange(len(rows)), 0, tree)
            self.trees.append(tree)
            margin += self._walk(tree, bins)
        return self

    def _grow(self, bins, grad, hess, rows, depth, tree) -> int:
        """Append the node of ``rows`` and what is below it; its number."""
        me = len(tree)
        value = self.rate * grad[rows].sum() / (hess[rows].sum() + self.smooth)
        tree.append((-1, 0, 0, 0, float(value)))
        best = self._split(bins, grad, hess, rows) if depth < self.depth else None
        if best:
            f, cut = best
            low = bins[rows, f] <= cut
            left = self._grow(bins, grad, hess, rows[low], depth + 1, tree)
            right = self._grow(bins, grad, hess, rows[~low], depth + 1, tree)
            tree[me] = (f, cut, left, right, float(value))
        return me

    def _split(self, bins, grad, hess, rows):
        most, best = 1e-6, None
        g_all, h_all = grad[rows].sum(), hess[rows].sum()
        whole = g_all**2 / (h_all + self.smooth)
        for f, edges in enumerate(self.edges):
            size = len(edges) + 1
            own = bins[rows, f]
            n = np.cumsum(np.bincount(own, minlength=size))[:-1]
            g = np.cumsum(np.bincount(own, grad[rows], size))[:-1]
            h = np.cumsum(np.bincount(own, hess[rows], size))[:-1]
            gain = (
                g**2 / (h + self.smooth)
                + (g_all - g) ** 2 / (h_all - h + self.smooth)
                - whole
            )
            gain[(n < 3) | (len(rows) - n < 3)] = 0
            at = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[at] > most:
                most, best = gain[at], (f, at)
        return best

    @staticmethod
    def _walk(tree, bins) -> np.ndarray:
        table = np.array(tree)
        at = np.zeros(len(bins), int)
        every = np.arange(len(bins))
        while True:
            f = table[at, 0].astype(int)
            inner = f >= 0
            if not inner.any():
                return table[at, 4]
            low = bins[every, np.maximum(f, 0)] <= table[at, 1]
            below = np.where(low, table[at, 2], table[at, 3]).astype(int)
            at = np.where(inner, below, at)

    def margin(self, rows: np.ndarray) -> np.ndarray:
        bins = self.binned(rows)
        return self.start + sum((self._walk(t, bins) for t in self.trees), np.zeros(len(rows)))


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step fit by pooling adjacent violators."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []  # mean, weight, last score
    for x, y in zip(scores[order].tolist(), labels[order].tolist(), strict=True):
        pools.append([y, 1.0, x])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][2] == pools[-1][2]):
            mean, weight, last = pools.pop()
            before = pools[-1]
            before[0] = (before[0] * before[1] + mean * weight) / (before[1] + weight)
            before[1] += weight
            before[2] = last
    return np.array([p[2] for p in pools]), np.array([p[0] for p in pools])


class Model:
    """Lexicons, trees and calibration learned from a bounded sample."""

    def __init__(self, texts: list[str], labels: list[int], folds: int = 5):
        target = np.array(labels, dtype=float)
        self.share = float(target.mean()) if len(target) else 0.0
        uses = Uses(texts, labels)
        every = uses.sums(range(len(texts)))
        self.lexicons = Lexicons(*every)
        self.trees = None
        if not 0 < self.share < 1 or len(texts) < 2 * folds:
            return
        rows = np.zeros((len(texts), N_FEATURES))
        fold = np.arange(len(texts)) % folds
        for k in range(folds):
            own = np.flatnonzero(fold == k).tolist()
            memo = Memo(Lexicons(*minus(every, uses.sums(own))).hits)
            for i in own:
                rows[i] = features(texts[i], memo)
        margins = np.zeros(len(texts))
        for k in range(folds):
            own = fold == k
            margins[own] = Trees().fit(rows[~own], target[~own]).margin(rows[own])
        self.knots, self.levels = isotonic(margins, target)
        self.trees = Trees().fit(rows, target)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(rows), self.share)
        return np.interp(self.trees.margin(rows), self.knots, self.levels)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return learned(sampled(docs, labels, "toxic"), Model)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` and, of every whole text, its score as ``column``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.withColumn(column, F.lit(0.0)).schema
    if column in docs.columns:
        raise ValueError(f"there is a column {column} already")

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(shared.value.lexicons.hits)
        for part in parts:
            texts = part.column(part.schema.get_field_index("text"))
            rows = np.array(
                [features(t.as_py() or "", memo) for t in texts], dtype=float
            ).reshape(len(texts), N_FEATURES)
            marks = pa.array(shared.value.scores(rows), pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, marks], [*part.schema.names, column])

    return docs.mapInArrow(add, schema)


def classified(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The contract's columns for every document."""
    return score(docs.select("doc_id", "text"), train(docs, labels)).select(
        "doc_id",
        held_out(5).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns.

    Columns travel under plain names, so a dot in a name or a column ``score`` does no harm.
    """
    plain = ["text" if name == "text" else f"c{at}" for at, name in enumerate(docs.columns)]
    scored = score(docs.toDF(*plain), train(docs, labels))
    kept = scored.where(F.col("score") < threshold)
    return kept.select(*[F.col(p).alias(c) for p, c in zip(plain, docs.columns, strict=True)])
