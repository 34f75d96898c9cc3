"""Fill-in-middle documents, cut by memoized content-defined chunks.

A rolling hash over the last ``WINDOW`` characters ends chunks where its highest bits are
zero, so that passages which documents share fall into the same chunks wherever they stand.
A task keeps a summary of every chunk that it met, found again by the chunk's own characters
(a dictionary compares them, so a shared chunk is never mistaken): how many words end in it,
where, whether it begins and ends inside a word, and what a marker across its borders needs.
Adding up the counts of a text's chunks finds the chunk of a cut; the summary finds the place.

A token is a word with the white space before it, or the white space that ends the text.
Prefix, middle and suffix are cut at two tokens drawn from a digest of seed and id, so reruns
agree. A text that is empty, holds a marker or is not drawn stays plain.

Nothing is shuffled and every text is read once; a task holds at most ``MEMO_CHARS`` of
remembered chunks and one text. Losing an executor repeats its tasks only.

Defined cases: a null text counts as empty and stays plain; a null id draws as an empty id;
a text of any length is cut whole; rows that repeat an id draw alike; an empty table gives an
empty result. Only the id and the text are read, so other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE, batches

#: Characters that the rolling hash sees, a power of two.
WINDOW = 32
#: A chunk ends once in this many characters, a power of two, within the bounds below.
MEAN_CHUNK, LEAST_CHUNK, MOST_CHUNK = 256, 64, 4096
#: Characters of remembered chunks in a task; beyond, it starts anew.
MEMO_CHARS = 32_000_000

#: The markers and shares of the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SUFFIX_FIRST = 42, 50, 80

CUT = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
     ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
)
CUT_SQL = (
    "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
)

WORD_END = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
BLANK = frozenset("\x20\t\n\x0b\x0c\r")
MARKER = re.compile("|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))))
#: Characters of a marker that may lie on one side of a chunk's border.
LAP = len(PREFIX) - 1


def rolling_hash(text: str) -> np.ndarray:
    """For every character a 32-bit hash of the ``WINDOW`` characters that end there."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    mixed = (points + np.uint32(1)) * np.uint32(0x9E3779B1)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    mixed ^= mixed >> np.uint32(13)
    reach = 1
    while reach < WINDOW:
        # A window of twice the length is the later half and the earlier half, shifted.
        earlier = mixed[:-reach] << np.uint32(reach)
        mixed = mixed.copy()
        mixed[reach:] += earlier
        reach *= 2
    return mixed


def chunk_ends(text: str) -> list[int]:
    """Where the chunks of a text end; the last end is the text's."""
    size = len(text)
    if size <= LEAST_CHUNK:
        return [size] if size else []
    ends, begin = [], 0
    marked = np.flatnonzero(rolling_hash(text) < np.uint32((1 << 32) // MEAN_CHUNK)) + 1
    for place in [*marked.tolist(), size]:
        while place - begin > MOST_CHUNK:
            begin += MOST_CHUNK
            ends.append(begin)
        if place - begin >= LEAST_CHUNK or (place == size and place > begin):
            ends.append(place)
            begin = place
    return ends


class Summary(NamedTuple):
    """What a chunk tells of its text: the places where words end inside it (a word that ends
    with it ends where the next chunk begins), its borders, and whether it holds a marker."""

    word_ends: list[int]
    begins_blank: bool
    ends_blank: bool
    head: str
    marked: bool


class Memo(dict):
    """Summaries by chunk; a chunk is summarised when first asked for."""

    def __init__(self, most_chars: int = 0):
        super().__init__()
        self.most = most_chars or MEMO_CHARS
        self.chars = 0

    def __missing__(self, chunk: str) -> Summary:
        if self.chars >= self.most:
            self.clear()
            self.chars = 0
        self.chars += len(chunk)
        summary = self[chunk] = Summary(
            [hit.start() for hit in WORD_END.finditer(chunk)],
            chunk[0] in BLANK,
            chunk[-1] in BLANK,
            chunk[:LAP],
            MARKER.search(chunk) is not None,
        )
        return summary


class Outline:
    """A text's number of tokens, whether it holds a marker, and the places of its tokens."""

    def __init__(self, text: str, memo: Memo):
        self.size = len(text)
        begin, in_word, tail, counted = 0, False, "", 0
        self.marked = False
        self.begins: list[int] = []
        self.before: list[int] = []
        self.summaries: list[Summary] = []
        self.carried: list[bool] = []
        for end in chunk_ends(text):
            chunk = text[begin:end]
            summary = memo[chunk]
            # A word that fills the chunk before may end at this border.
            carried = in_word and summary.begins_blank
            self.begins.append(begin)
            self.before.append(counted)
            self.summaries.append(summary)
            self.carried.append(carried)
            counted += len(summary.word_ends) + carried
            if not self.marked:
                self.marked = summary.marked or MARKER.search(tail + summary.head) is not None
            tail = (tail + chunk)[-LAP:] if len(chunk) < LAP else chunk[-LAP:]
            in_word = not summary.ends_blank
            begin = end
        # What follows the last word's end is one more token; so is a word that ends the text.
        self.tokens = counted + (1 if self.size else 0)

    def place(self, tokens: int) -> int:
        """The characters of the first ``tokens`` tokens."""
        if tokens <= 0:
            return 0
        if tokens >= self.tokens:
            return self.size
        at = int(np.searchsorted(self.before, tokens)) - 1
        nth = tokens - self.before[at] - 1
        if self.carried[at]:
            if nth == 0:
                return self.begins[at]
            nth -= 1
        return self.begins[at] + self.summaries[at].word_ends[nth]


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers out of a digest of seed and id."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def rearranged(
    doc_id: int | None, text: str, memo: Memo, seed: int, rate: int, suffix_first: int
) -> tuple:
    """The row of one text."""
    outline = Outline(text, memo)
    n = outline.tokens
    first, second, drawn, order = draws(doc_id, seed)
    if not text or outline.marked or drawn % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = outline.place(low), outline.place(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < suffix_first:
        form, output = "spm", SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    else:
        form, output = "psm", PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return doc_id, n, form, a, b - a, output


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """``doc_id``, ``n`` tokens, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``rate`` percent of the texts are rearranged, ``suffix_first`` percent of those with the
    suffix before the prefix.
    """

    def rearrange(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        rows = (
            rearranged(doc_id.as_py(), text.as_py() or "", memo, seed, rate, suffix_first)
            for part in parts
            for doc_id, text in zip(part.column(0), part.column(1), strict=True)
        )
        return batches(rows, CUT, 1024)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(rearrange, CUT_SQL)


def original(output: Column, form: Column) -> Column:
    """The exact text that became ``output``; parts hold no marker, so the markers part it."""
    parts = F.split(output, MARKER.pattern, -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(rearranged: DataFrame) -> DataFrame:
    """The contract's columns: output and the text rebuilt from it as digests."""
    rebuilt = original(F.col("output"), F.col("form"))
    return rearranged.select(
        *("doc_id", "n", "form", "prefix_chars", "middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(rebuilt, 256).alias("restored_sha256"),
    )


#: The contract in SQL, by whole lists of tokens.
ORACLE = r"""
with cut as (
  select doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''),
      '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tokens,
    sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents
), drawn as (
  select doc_id, text, tokens, cast(len(tokens) as bigint) as n,
    cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
    cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4
  from cut
), parted as (
  select doc_id, text, n,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
           or h3 % 100 >= 50 then 'plain'
         when h4 % 100 < 80 then 'spm' else 'psm' end as form,
    array_to_string(tokens[1 : least(h1 % (n + 1), h2 % (n + 1))], '') as prefix,
    array_to_string(tokens[least(h1 % (n + 1), h2 % (n + 1)) + 1
                           : greatest(h1 % (n + 1), h2 % (n + 1))], '') as middle,
    array_to_string(tokens[greatest(h1 % (n + 1), h2 % (n + 1)) + 1 : n], '') as suffix
  from drawn
)
select doc_id, n, form,
  case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text
    when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from parted
"""
