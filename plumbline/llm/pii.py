"""Personal data in texts, also where it is written in disguise.

Identifiers are searched in the text as it is (the base), and in a normalised copy made by
two transducers: one maps look-alike characters one to one, the other rewrites spelled
digits and written-out ``at`` and ``dot`` and drops invisible characters. It keeps, for
every piece of its output, the place in the source, so that what is found in the copy is
reported as a span of the source. Offsets are code points, ends exclusive.

Found spans that overlap a base span of their kind are left out, so base spans stay as they
are. An added span must hold a disguise: text that normalises to itself adds nothing.

Defined cases: a null text counts as empty and has no spans; texts are read whole and every
search is linear in their length; rows that repeat an id each give a row. Only the id and
the text are read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import batches

#: The kinds and patterns of the contract.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Digits as words in the languages of the corpus.
SPELLED = {
    "0": "zero null cero zéro oh",
    "1": "one eins uno un",
    "2": "two zwei dos deux",
    "3": "three drei tres trois",
    "4": "four vier cuatro quatre",
    "5": "five fünf cinco cinq",
    "6": "six sechs seis",
    "7": "seven sieben siete sept",
    "8": "eight acht ocho huit",
    "9": "nine neun nueve neuf",
}
DIGIT_OF = {word: digit for digit, words in SPELLED.items() for word in words.split()}
#: Cyrillic and Greek letters that look like Latin ones.
LOOKS = dict(
    zip(
        "АВЕКМНОРСТХЅІЈаеорсухѕіјԁԛԝ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοаνι",
        "ABEKMHOPCTXSIJaeopcyxsijdqw" + "ABEZHIKMNOPTYXoavi",
        strict=True,
    )
)
INVISIBLE = "­​‌‍⁠﻿"

_SPELLED = "|".join(sorted(DIGIT_OF, key=len, reverse=True))
_OPEN, _CLOSE = r"[\[({<]\s?", r"\s?[\])}>]"
#: Written-out signs; bare words count only between word characters and blanks.
REWRITES = re.compile(
    rf"(?P<gone>[{INVISIBLE}])"
    rf"|(?P<at>\x20?{_OPEN}(?:at|@|arroba|arobase|ät){_CLOSE}\x20?|&#0*64;|&commat;)"
    rf"|(?P<dot>\x20?{_OPEN}(?:dot|\.|punkt|punto|point){_CLOSE}\x20?|&#0*46;|&period;)"
    r"|(?P<bare_at>(?<=\w)\x20(?:at|arroba|arobase)\x20(?=\w))"
    r"|(?P<bare_dot>(?<=\w)\x20(?:dot|punkt|punto|point)\x20(?=\w))"
    rf"|(?P<plus>(?<!\w)plus\x20(?=\d|(?:{_SPELLED})(?!\w)))"
    rf"|(?P<digits>(?<!\w)(?:{_SPELLED})(?:[\x20-](?:{_SPELLED}|[0-9]+))+(?!\w)"
    rf"|(?:(?<=dot\x20)(?:{_SPELLED})(?!\w)|(?<!\w)(?:{_SPELLED})(?=\x20dot\x20)))",
    re.IGNORECASE,
)
_PART = re.compile(r"[\x20-]|[^\x20-]+")

# The alternatives of REWRITES on lower case, none narrower than its own. A bare ``at`` alone
# can add only an email, whose domain then follows as it is.
_SIGNS = re.compile(
    rf"{_OPEN}(?:at|@|arroba|arobase|ät|dot|\.|punkt|punto|point){_CLOSE}"
    r"|&(?:#0*(?:64|46)|commat|period);"
)
_BARE_AT = re.compile(r"\x20(?:at|arroba|arobase)\x20[a-z0-9-]+\.[a-z0-9-]")
_BARE = re.compile(r"\x20(?:punkt|punto|point)\x20|dot\x20|plus\x20")
_TOLD = re.compile(rf"\b(?:{_SPELLED})[\x20-](?:{_SPELLED}|[0-9])")
_HIDDEN = re.compile(f"[{INVISIBLE}]")


def suspicious(text: str) -> bool:
    """Whether the rewriting transducer could change ``text`` so that more is found."""
    if not text.isascii() and _HIDDEN.search(text):
        return True
    low = text.lower()
    return any(signs.search(low) for signs in (_BARE, _BARE_AT, _SIGNS, _TOLD))


def _look(char: str) -> str:
    """The one ASCII character that ``char`` looks like, or itself."""
    if char in LOOKS:
        return LOOKS[char]
    plain = unicodedata.normalize("NFKC", char)
    return plain if len(plain) == 1 and plain.isascii() and plain.isprintable() else char


class Looks(dict):
    """A translation table that fills itself; it has an entry per character ever met."""

    def __missing__(self, code: int) -> str:
        look = self[code] = _look(chr(code)) if code > 127 else chr(code)
        return look


LOOK_TABLE = Looks()


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ the local part grows to the left, no further than the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            end = found.end()
            yield begin, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four parts at a time of every dotted run of numbers."""
    for run in DOTTED.finditer(text):
        parts, begin = run.group().split("."), run.start()
        for first in range(0, len(parts) - 3, 4):
            four = parts[first : first + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield begin, end
            begin = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for run in CARD.finditer(text):
        if 12 <= run.end() - run.start() <= 37:
            digits = run.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield run.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for run in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, run.group())) <= 15:
            yield run.span()


FINDERS = dict(zip(KINDS, (emails, addresses, cards, phones), strict=True))
Span = tuple[int, int, str]


def found_in(text: str) -> list[Span]:
    """(start, end, kind) of every identifier of the base patterns."""
    return [(a, b, kind) for kind, find in FINDERS.items() for a, b in find(text)]


class Rewritten:
    """A normalised text and the way back to the source."""

    def __init__(self, text: str):
        self.source = text
        self.looked = text if text.isascii() else text.translate(LOOK_TABLE)
        self.pieces: list[str] = []
        self.outs: list[int] = []  # where in the output a piece begins,
        self.spans: list[tuple[int, int]] = []  # and the source that it stands for
        self.kinds: list[str] = []
        self.size = 0
        last = 0
        for hit in REWRITES.finditer(self.looked) if suspicious(self.looked) else ():
            self._put(self.looked[last : hit.start()], last, hit.start(), "")
            if hit.lastgroup == "digits":
                self._digits(hit)
            else:
                signs = {"gone": "", "at": "@", "bare_at": "@", "dot": ".", "bare_dot": ".",
                         "plus": "+"}
                self._put(signs[hit.lastgroup], *hit.span(), hit.lastgroup)
            last = hit.end()
        self._put(self.looked[last:], last, len(text), "")
        self.text = "".join(self.pieces)

    def _digits(self, hit: re.Match) -> None:
        """Spelled digits run together; digits written as such stay."""
        for part in _PART.finditer(hit.group()):
            word, begin = part.group(), hit.start() + part.start()
            said = DIGIT_OF.get(word.lower(), word if word.isdigit() else "")
            self._put(said, begin, begin + len(word), "digits")

    def _put(self, out: str, begin: int, end: int, kind: str) -> None:
        if out:
            self.pieces.append(out)
            self.outs.append(self.size)
            self.spans.append((begin, end))
            self.kinds.append(kind)
            self.size += len(out)

    def origin(self, begin: int, end: int) -> tuple[int, int, set[str]]:
        """The source span of an output span, and the kinds of rewriting in it."""
        first, last = bisect_right(self.outs, begin) - 1, bisect_right(self.outs, end - 1) - 1
        start, stop = self.spans[first][0], self.spans[last][1]
        if not self.kinds[first]:
            start += begin - self.outs[first]
        if not self.kinds[last]:
            stop = self.spans[last][0] + end - self.outs[last]
        return start, stop, {k for k in self.kinds[first : last + 1] if k}

    def disguised(self, begin: int, end: int, kinds: set[str]) -> bool:
        """Whether the source there is in disguise, beyond doubt that it is prose.

        A lone `` at `` before a plain domain is how people write; it counts only with a
        written-out dot, or where the local part has a digit or a joining sign. A lone `` dot ``
        is between numbers or after a written @ wherever something is found, so it counts.
        """
        source = self.source[begin:end]
        if kinds == {"bare_at"} and not re.match(r"\S*[0-9._+-]\S*\x20", source):
            return False
        return bool(kinds) or source != self.looked[begin:end] or bool(
            re.search(f"[{INVISIBLE}]", source)
        )


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans and all spans of ``text``, in the contract's order."""
    order = {kind: place for place, kind in enumerate(KINDS)}
    base = found_in(text)
    added: list[Span] = []
    rewritten = Rewritten(text)
    if rewritten.text != text:
        for begin, end, kind in found_in(rewritten.text):
            start, stop, kinds = rewritten.origin(begin, end)
            if rewritten.disguised(start, stop, kinds):
                added.append((start, stop, kind))
        taken = {kind: sorted(s for s in base if s[2] == kind) for kind in KINDS}
        added = [s for s in added if not overlaps(s, taken[s[2]])]

    def place(span: Span):
        return span[0], order[span[2]], span[1]

    return sorted(base, key=place), sorted(base + added, key=place)


def overlaps(span: Span, others: list[Span]) -> bool:
    """Whether ``span`` meets one of the sorted, disjoint ``others``."""
    at = bisect_right(others, (span[1], -1, "")) - 1
    return at >= 0 and others[at][1] > span[0]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for begin, end, kind in spans)


FOUND = pa.schema(
    [("doc_id", pa.int64()), *[(f"n_{kind}", pa.int64()) for kind in KINDS],
     ("base_sha256", pa.string()), ("spans", pa.string()), ("base_spans", pa.string())]
)
FOUND_SQL = "doc_id bigint, " + ", ".join(f"n_{kind} bigint" for kind in KINDS) + (
    ", base_sha256 string, spans string, base_spans string"
)


def find(docs: DataFrame) -> DataFrame:
    """Counts and spans of every document, one row each; no shuffle."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                base, every = spans_of(text.as_py() or "")
                counts = [sum(s[2] == kind for s in every) for kind in KINDS]
                plain = joined(base)
                digest = hashlib.sha256(plain.encode()).hexdigest()
                yield (doc_id, *counts, digest, joined(every), plain)

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(rows(parts), FOUND)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(search, FOUND_SQL)


def redacted(text: str) -> str:
    """``text`` with every found span replaced by its kind; overlaps merge to the first."""
    out, last = [], 0
    for begin, end, kind in spans_of(text)[1]:
        if begin >= last:
            out += [text[last:begin], f"<{kind}>"]
        last = max(last, end)
    return "".join([*out, text[last:]])
