"""Periodic runs of words, located by block convolution at dyadic scales.

A run is a stretch of words with smallest period q (words q apart are identical), at least
``LEAST`` words and two periods long, that no neighbouring word extends. Scale s, a power of
two, is in charge of the distances 2s-1 to 4s-2 (scale 2 of 1 to 6): a run of such a period
holds a whole block of s words that starts at a multiple of s and occurs again one period on.
For every block the sums of squared differences to the window after it are computed for all
distances at once, by number-theoretic transforms whose sums stay whole in double precision.
A sum of zero is a zero residue, so no occurrence is missed; a zero residue is a seed, whose
words are compared and which is extended both ways. Blocks with a word that does not occur
again at such a distance are not transformed: they cannot recur.

Texts are worked on many at a time, laid end to end, in tasks that each read their own rows;
nothing is shuffled. The work grows with n log n of the words of a text. Blocks longer than
``PATTERN`` words are sought by their first ``PATTERN`` words, whose every occurrence is
compared in full, so that the transform's size stays bounded.

Defined cases: a null text counts as empty and has no words and no runs; a text of any length
is one unit of work of its own; rows that repeat an id, null ids and equal texts each give a
row; an empty table gives an empty result. Only the id and the text are read, so other
columns and their names play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, text_of

#: Fewest words of a run.
LEAST = 12
#: Words worked on at a time, but for one longer text.
BATCH_WORDS = 200_000
#: Most words of a block that are transformed.
PATTERN = 1 << 16
#: Numbers in one transform's matrix, which bounds its memory.
MATRIX = 1 << 19
#: 7 * 2**20 + 1 is prime and has roots of unity up to order 2**20; 64 products of residues
#: add up to less than 2**53.
PRIME, GENERATOR = 7 * 2**20 + 1, 3
RADIX = 64
#: Words by which all seeds are extended together before the rest is compared run by run.
TOGETHER = 16

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)),
     ("collapsed", pa.string())]
)
FOUND_SQL = (
    "doc_id bigint, n_words bigint, "
    "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
)


def _residue(values: np.ndarray) -> np.ndarray:
    """Residues of whole doubles below 2**53; a multiple of the prime may stay the prime."""
    return values - PRIME * np.floor(values * (1.0 / PRIME))


@lru_cache(maxsize=64)
def _powers(root_order: int, rows: int, columns: int, inverse: bool) -> np.ndarray:
    """root ** (row * column) for the root of unity of that order."""
    root = pow(GENERATOR, (PRIME - 1) // root_order, PRIME)
    if inverse:
        root = pow(root, PRIME - 2, PRIME)
    table = np.ones(root_order, np.int64)
    for k in range(1, root_order):
        table[k] = table[k - 1] * root % PRIME
    at = np.arange(rows)[:, None] * np.arange(columns)[None, :] % root_order
    return table[at].astype(np.float64)


def transformed(rows: np.ndarray) -> np.ndarray:
    """The transform of every row; its order of frequencies is that of :func:`restored`."""
    size = rows.shape[-1]
    if size <= RADIX:
        return _residue(rows @ _powers(size, size, size, False))
    high, low = RADIX, size // RADIX
    parts = rows.reshape(*rows.shape[:-1], high, low)
    parts = _residue(_powers(high, high, high, False) @ parts)
    parts = _residue(parts * _powers(size, high, low, False))
    return transformed(parts).reshape(rows.shape)


def restored(rows: np.ndarray) -> np.ndarray:
    """The rows whose transform is given."""
    return _residue(_untransformed(rows) * float(pow(rows.shape[-1], PRIME - 2, PRIME)))


def _untransformed(rows: np.ndarray) -> np.ndarray:
    size = rows.shape[-1]
    if size <= RADIX:
        return _residue(rows @ _powers(size, size, size, True))
    high, low = RADIX, size // RADIX
    parts = _untransformed(rows.reshape(*rows.shape[:-1], high, low))
    parts = _residue(parts * _powers(size, high, low, True))
    return _residue(_powers(high, high, high, True) @ parts).reshape(rows.shape)


def differences(codes: np.ndarray, blocks: np.ndarray, width: int, first: int, lags: int):
    """Sums of squared differences, modulo the prime, of every block's ``width`` words and the
    words ``first`` to ``first + lags - 1`` further on. Words beyond the end count as zeros."""
    size = 4 * width
    held = np.concatenate([codes, np.zeros(first + lags + size, np.int64)]) % PRIME
    squares = np.concatenate([[0], np.cumsum(held * held % PRIME)])
    block = np.zeros((len(blocks), size))
    inside = blocks[:, None] + np.arange(width)
    block[:, -np.arange(width) % size] = held[inside]
    window = np.zeros((len(blocks), size))
    reach = lags + width - 1
    window[:, :reach] = held[blocks[:, None] + first + np.arange(reach)]
    met = restored(_residue(transformed(block) * transformed(window)))[:, :lags]
    there = blocks[:, None] + first + np.arange(lags)
    own = (squares[blocks + width] - squares[blocks])[:, None]
    other = squares[there + width] - squares[there]
    return (own + other - 2 * met.astype(np.int64)) % PRIME


class Texts:
    """Word codes of several texts, laid end to end."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.codes = codes
        self.ends = np.repeat(np.cumsum(sizes), sizes)
        self.begins = self.ends - np.repeat(sizes, sizes)
        n = len(codes)
        # The next and the last place of the same word in the same text.
        order = np.lexsort((codes, self.ends))
        same = np.zeros(n, bool)
        same[1:] = (codes[order][1:] == codes[order][:-1]) & (
            self.ends[order][1:] == self.ends[order][:-1]
        )
        self.next = np.full(n, 2 * n + 1, np.int64)
        self.next[order[:-1][same[1:]]] = order[1:][same[1:]]
        group = np.cumsum(~same) - 1
        last = np.zeros(group[-1] + 1 if n else 0, np.int64)
        last[group] = order
        self.last = np.empty(n, np.int64)
        self.last[order] = last[group]
        # Smallest known period at every place, and the end of its run.
        self.period = np.zeros(n, np.int64)
        self.until = np.zeros(n, np.int64)

    def blocks(self, scale: int, first: int, final: int) -> np.ndarray:
        """Starts of the blocks whose every word occurs again at one of the distances."""
        n = len(self.codes) // scale * scale
        at = np.arange(n)
        again = (self.last[:n] - at >= first) & (self.next[:n] - at <= final)
        starts = np.flatnonzero(again.reshape(-1, scale).all(axis=1)) * scale
        return starts[starts + first + scale <= self.ends[starts]]

    def seeds(self, scale: int) -> tuple[np.ndarray, np.ndarray]:
        """Blocks and distances of every occurrence, but in runs of a divisor of the distance."""
        first, final = (1, 6) if scale == 2 else (2 * scale - 1, 4 * scale - 2)
        blocks = self.blocks(scale, first, final)
        width = min(scale, PATTERN)
        size = 4 * width
        found = []
        step = max(1, MATRIX // size)
        for lag in range(first, final + 1, size - width + 1):
            lags = min(size - width + 1, final + 1 - lag)
            for cut in range(0, len(blocks), step):
                own = blocks[cut : cut + step]
                row, column = np.nonzero(differences(self.codes, own, width, lag, lags) == 0)
                found.append((own[row], column + lag))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        block, far = (np.concatenate(part) for part in zip(*found, strict=True))
        keep = block + far + scale <= self.ends[block]
        block, far = block[keep], far[keep]
        period = self.period[block]
        known = (period > 0) & (far % np.maximum(period, 1) == 0) & (
            block + far + scale <= self.until[block]
        )
        return block[~known], far[~known]

    def extended(self, block: np.ndarray, far: np.ndarray, scale: int):
        """Seeds whose words agree and that may reach a run's length, with how far they do.

        All of them grow together by up to ``TOGETHER`` words a side.
        """
        codes = self.codes
        agree = np.ones(len(block), bool)
        for step in range(min(scale, TOGETHER)):
            agree &= codes[block + step] == codes[block + far + step]
        block, far = block[agree], far[agree]
        left, right = block.copy(), block + min(scale, TOGETHER)
        begin, end = self.begins[block], self.ends[block]
        back = np.ones(len(block), bool)
        forth = np.ones(len(block), bool)
        for _ in range(TOGETHER):
            back &= left > begin
            back &= codes[left - 1] == codes[np.minimum(left + far - 1, len(codes) - 1)]
            left -= back
            forth &= right + far < end
            forth &= codes[np.minimum(right, len(codes) - 1)] == codes[
                np.minimum(right + far, len(codes) - 1)
            ]
            right += forth
        reached = (right - left >= np.maximum(LEAST - far, far)) | back | forth
        return block[reached], far[reached], left[reached], right[reached]

    def _grown(self, left: int, right: int, far: int) -> tuple[int, int]:
        """The longest stretch around left..right whose words recur ``far`` words on."""
        codes = self.codes
        begin, end = int(self.begins[left]), int(self.ends[left]) - far
        step = 64
        while right < end:
            stop = min(right + step, end)
            apart = np.flatnonzero(codes[right:stop] != codes[right + far : stop + far])
            if len(apart):
                right += int(apart[0])
                break
            right, step = stop, 2 * step
        step = 64
        while left > begin:
            stop = max(left - step, begin)
            apart = np.flatnonzero(codes[stop:left] != codes[stop + far : left + far])
            if len(apart):
                left = stop + int(apart[-1]) + 1
                break
            left, step = stop, 2 * step
        return left, right

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, end, smallest period) of every run, by start, then period."""
        best: dict[tuple[int, int], int] = {}
        longest = int((self.ends - self.begins).max()) if len(self.codes) else 0
        scale = 2
        while longest >= 2 and (scale == 2 or 2 * (2 * scale - 1) <= longest):
            block, far, left, right = self.extended(*self.seeds(scale), scale)
            # Seeds by distance, then place.
            key = far * (len(self.codes) + 1) + block
            order = np.argsort(key, kind="stable")
            key = key[order]
            k = 0
            while k < len(order):
                seed = order[k]
                q = int(far[seed])
                start, stop = self._grown(int(left[seed]), int(right[seed]), q)
                end = stop + q
                if end - start >= max(LEAST, 2 * q):
                    # Of maximal runs with equal ends the smallest period comes first.
                    if best.setdefault((start, end), q) == q:
                        free = self.period[start:end] == 0
                        self.period[start:end][free] = q
                        self.until[start:end][free] = end
                # The distance's next seed beyond what was compared.
                beyond = q * (len(self.codes) + 1) + stop
                k = max(k + 1, int(np.searchsorted(key, beyond)))
            scale *= 2
        return sorted((start, end, q) for (start, end), q in best.items())


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self) + 1
        return number


def runs_of(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of every list of words, by start, then period."""
    numbers = Numbers()
    sizes = np.array([len(words) for words in texts], np.int64)
    codes = np.fromiter(
        (numbers[word] for words in texts for word in words), np.int64, int(sizes.sum())
    )
    begins = np.cumsum(sizes) - sizes
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs = Texts(codes, sizes).runs()
    owners = np.searchsorted(begins, [start for start, _, _ in runs], side="right") - 1
    for (start, end, period), owner in zip(runs, owners.tolist(), strict=True):
        # Of texts that begin at one place only the last has words.
        found[owner].append((start - int(begins[owner]), end - start, period))
    return found


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words but those that a run repeats, joined by one space."""
    if not runs:
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return " ".join([words[place] for place in np.flatnonzero(kept).tolist()])


def _find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = re.compile(WORD).findall
    ids: list[int | None] = []
    texts: list[list[str]] = []
    held = 0

    def batch() -> pa.RecordBatch:
        runs = runs_of(texts)
        names = ("start", "length", "period")
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(words) for words in texts], pa.int64()),
            pa.array([[dict(zip(names, run, strict=True)) for run in own] for own in runs],
                     pa.list_(RUN)),
            pa.array([collapsed(*pair) for pair in zip(texts, runs, strict=True)], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=FOUND)

    for part in parts:
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            words = split(text.as_py() or "")
            ids.append(doc_id)
            texts.append(words)
            held += len(words)
            if held >= BATCH_WORDS:
                yield batch()
                ids, texts, held = [], [], 0
    if ids:
        yield batch()


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and the
    ``collapsed`` text, without what runs repeat, of every row."""
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(_find, FOUND_SQL)


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with the contract's repetitions written into a tenth of the texts.

    With h the crc32 of the id and g = h / 10, a text of n words with h % 10 = 0 repeats its
    words from g % n on with period 1 + (n - g % n) / (3 + g % 8). The words are joined by
    one space, which leaves them as they are. A null id is never among them.
    """
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(h / 10)
    words = F.expr(f"regexp_extract_all(text, '{WORD}', 0)")

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(
            F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p))),
            " ",
        )

    # The words are bound once, as the one element of a list.
    rewritten = F.get(F.transform(F.array(words), repeated), F.lit(0))
    chosen = F.coalesce(h % 10 == 0, F.lit(False)) & text_of().rlike(WORD)
    return docs.select("doc_id", F.when(chosen, rewritten).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of :func:`find`: the longest run, and digests of runs and text."""
    first = F.expr(
        """array_min(transform(runs, r ->
             struct(-r.length as length, r.start as start, r.period as period)))"""
    )
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', "
                   "r.period, chr(10))))")
    length, period = -F.col("first.length"), F.col("first.period")
    return found.withColumn("first", first).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("first.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("-first.length * 1000 div first.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
