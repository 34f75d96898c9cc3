"""Main text of web pages by wrappers inferred per host.

A wrapper is a union-free regular expression over structural tokens: tags, text slots,
optional groups and repeated groups. It starts as one page of the host, its repeats folded.
Every other page of the host is aligned with it, equal shapes once; where they differ, a group
that one side repeats becomes a repeated group, and what only one side has becomes optional.
The shapes of a host are dealt to buckets; the wrappers of the buckets are aligned with each
other. One that grows too wide takes the tokens of its unequal part in any order, and where
these are too many, as with names that each page makes up, any tokens. The wrapper becomes an automaton of its tokens, which pages of the host are run through with
sets of places, in time linear in the page whatever its shape; a page that does not match is
aligned in the same way first. Texts in the article's slots are the page's main text, but
for menus, forms, adverts, notices, comments and the like by the names of their elements.

A page without an article or main element has its content found by what its slots hold: the
texts that every distinct page of the host has, counted over all of them, are the template's,
and the content is the smallest box around all others. Everything in that box stays, also
what all pages say there; where one page is all there is, nothing tells, and all stays.

Defined cases: a null page counts as empty and has no text; a page without a host shares one
wrapper with its like; a page is read whole; rows that repeat an id each give a row; an empty
table gives an empty result. Only id, url and html are read.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches, stored, text_of

#: Parts that the shapes of a host are dealt to, and the shapes that a task knows it has told.
BUCKETS = 16
HELD_SHAPES = 100_000
#: Tokens of a wrapper beyond which its unequal part becomes one group of them in any order.
WIDEST = 600
#: How often a shape's groups are repeated to see whether a wrapper has it, and most tokens.
REPEATS, MOST_REPEATED = 3, 20_000
LONGEST_GROUP = 12
#: Pairs of tokens that one alignment compares. Beyond it, what lies between the common
#: beginning and the common end of both sides becomes two optional groups.
MOST_PAIRS = 16_000_000
#: Places of an automaton, whose tables take the square of it in bits. An odd page beyond it is
#: read by the tokens of its root element.
MOST_PLACES = 6_000
#: Bytes of automata that a task holds of one host's odd pages, and of all hosts' wrappers.
HELD_ODD = 2_000_000
HELD_KNOWN = 100_000_000
#: Bits, and number, of the steps that an automaton remembers.
STEP_BITS, HELD_STEPS = 1 << 22, 4_096

#: Names of the HTML elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = "script|style|noscript|template|iframe|svg|math|object|canvas|textarea|select|button"
OPTIONAL_END = frozenset("p li td th tr dd dt option tbody thead tfoot colgroup".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split()
)
ROOTS = ("article", "main")
#: Elements that are never main text, and words of class or id that say so.
OTHER = frozenset("head title nav footer aside form dialog menu".split())
OTHER_WORDS = frozenset(
    "nav navbar navigation menu sidebar footer ad ads advert adverts advertisement banner "
    "sponsor sponsored promo cookie cookies consent notice notices alert popup modal overlay "
    "comment comments disqus replies share sharing social related breadcrumb breadcrumbs "
    "newsletter subscribe signup login search pagination pager widget".split()
)
OUTSIDE = frozenset(["header"])  # a page's header, not an article's
#: Elements that group blocks.
BOXES = frozenset("body div section center td".split())
#: What all pages say in a sentence is not taken for a label of the template.
SENTENCE = re.compile(r"(?:\S+ ){5,}\S*[.!?…][\"'”’)\]]*")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)

SLOT = "#"
ANY = "**"  # in a wrapper, whatever token
Item = str | tuple  # a token, ("+", items) or ("?", items)


class Page:
    """The tokens of a page: element opened (+), closed (-), or text (#), with its value."""

    def __init__(self, source: str):
        self.kinds: list[str] = []
        self.values: list[str] = []
        self.names: list[str] = []  # words of class, id and role
        self.shape: list[str] = []  # structural tokens,
        self.place: list[int] = []  # and the token at which each begins
        for hit in TOKEN.finditer(source):
            kind = hit.lastgroup
            if hit["text"] is not None:
                self._text(hit["text"])
            elif kind and kind.startswith("rest"):
                two = "2" * kind.endswith("2")
                self._tag(hit[f"name{two}"].lower(), hit[f"end{two}"], hit[f"rest{two}"])

    def _add(self, kind: str, value: str, names: str = "") -> None:
        self.kinds.append(kind)
        self.values.append(value)
        self.names.append(names)

    def _text(self, value: str) -> None:
        if value.strip() and (not self.shape or self.shape[-1] != SLOT):
            self.shape.append(SLOT)
            self.place.append(len(self.kinds))
        self._add("#", value)

    def _tag(self, name: str, end: str, rest: str) -> None:
        named = "" if end else " ".join("".join(m) for m in NAMED.findall(rest)).lower()
        self._add("-" if end else "+", name, named)
        if name not in INLINE and not (end and name in OPTIONAL_END):
            self.shape.append(f"<{end}{name}>" if end or not named else f"<{name} {named}>")
            self.place.append(len(self.kinds) - 1)


def folded(items: list[Item]) -> list[Item]:
    """Adjacent equal groups as one repeated group, shortest groups first."""
    for size in range(1, LONGEST_GROUP + 1):
        out: list[Item] = []
        at = 0
        while at < len(items):
            group = items[at : at + size]
            end = at + size
            while len(group) == size and items[end : end + size] == group:
                end += size
            if end > at + size and group != [SLOT]:
                out.append(group[0] if size == 1 and group[0][0] == "+" else ("+", tuple(group)))
                at = end
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def _code_of(codes: dict[Item, int], items: list[Item]) -> np.ndarray:
    return np.array([codes.setdefault(item, len(codes)) for item in items], np.int32)


def _starts(items: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The places at which ``group`` stands in ``items``."""
    count = len(items) - len(group) + 1
    if count <= 0:
        return np.empty(0, np.int64)
    hits = np.ones(count, bool)
    for at, code in enumerate(group):
        hits &= items[at : at + count] == code
    return np.flatnonzero(hits)


def _scores(old: list[Item], new: list[Item]) -> np.ndarray:
    """The best score from every pair of places on, by the moves of :func:`_moves`.

    A row holds one place of the old side; all its pairs are filled at once. Steps over the
    new side have costs of their own, so the best of them is a running maximum.
    """
    n, m = len(old), len(new)
    codes: dict[Item, int] = {}
    left, right = _code_of(codes, old), _code_of(codes, new)
    where = {code: np.flatnonzero(right == code) for code in set(left.tolist())}
    inside = {a: _starts(right, _code_of(codes, a[1])) for a in set(old) if a[0] in "+?"}
    ends: dict[int, list[tuple[np.ndarray, int]]] = {}
    for group in {b for b in new if b[0] in "+?"}:
        places = np.flatnonzero(right == codes[group])
        for at in _starts(left, _code_of(codes, group[1])).tolist():
            ends.setdefault(at, []).append((places, len(group[1])))
    far = np.cumsum([0, *(b[0] != "?" for b in new)], dtype=np.int32)
    best = np.empty((n + 1, m + 1), np.int32)
    best[n] = far - far[m]
    for i in range(n - 1, -1, -1):
        a = old[i]
        row = best[i + 1] - (a[0] != "?")
        same = where[left[i]]
        row[same] = np.maximum(row[same], 2 + best[i + 1, same + 1])
        if a[0] in "+?":
            at, size = inside[a], len(a[1])
            row[at] = np.maximum(row[at], 2 * size + best[i + 1, at + size])
        for at, size in ends.get(i, ()):
            row[at] = np.maximum(row[at], 2 * size + best[i + size, at + 1])
        best[i] = np.maximum.accumulate((row - far)[::-1])[::-1] + far
    return best


def aligned(old: list[Item], new: list[Item]) -> list[Item]:
    """The wrapper that covers ``old``, a wrapper, and ``new``, a folded page or a wrapper.

    The steps that share most tokens are found by dynamic programming.
    """
    if len(old) * len(new) > MOST_PAIRS:
        return _aligned_ends(old, new)
    n, m = len(old), len(new)
    best = _scores(old, new)
    out: list[Item] = []
    before: list[Item] = []  # what only the old side has at a place,
    after: list[Item] = []  # and only the new: two groups, as no page need have both
    i = j = 0
    while i < n or j < m:
        take, put, shared = next(
            (take, put, shared)
            for score, take, put, shared in _moves(old, new, i, j)
            if score + best[i + take, j + put] == best[i, j]
        )
        if shared is None:
            before += old[i : i + take]
            after += new[j : j + put]
        else:
            _close(out, before)
            _close(out, after)
            out += shared
        i, j = i + take, j + put
    _close(out, before)
    _close(out, after)
    return out


def _aligned_ends(old: list[Item], new: list[Item]) -> list[Item]:
    """As :func:`aligned`, but the unequal middles of both sides are aligned alone."""
    least = min(len(old), len(new))
    head = next((k for k in range(least) if old[k] != new[k]), least)
    tail = next((k for k in range(least - head) if old[-1 - k] != new[-1 - k]), least - head)
    before, after = old[head : len(old) - tail], new[head : len(new) - tail]
    middle: list[Item] = []
    if len(before) * len(after) <= MOST_PAIRS:
        middle = aligned(before, after)
    else:
        _close(middle, before)
        _close(middle, after)
    return old[:head] + middle + old[len(old) - tail :]


def _moves(old, new, i, j):
    """(score, tokens of old, tokens of new, shared items or None) from a pair of places."""
    if i < len(old) and j < len(new):
        a, b = old[i], new[j]
        if a == b:
            yield 2, 1, 1, [a]
        if a[0] == "+" and tuple(new[j : j + len(a[1])]) == a[1]:
            yield 2 * len(a[1]), 1, len(a[1]), [a]
        if b[0] == "+" and tuple(old[i : i + len(b[1])]) == b[1]:
            yield 2 * len(b[1]), len(b[1]), 1, [b]
        if a[0] == "?" and tuple(new[j : j + len(a[1])]) == a[1]:
            yield 2 * len(a[1]), 1, len(a[1]), [a]
        if b[0] == "?" and tuple(old[i : i + len(b[1])]) == b[1]:
            yield 2 * len(b[1]), len(b[1]), 1, [b]
    if i < len(old):
        yield (0, 1, 0, [old[i]]) if old[i][0] == "?" else (-1, 1, 0, None)
    if j < len(new):
        yield (0, 0, 1, [new[j]]) if new[j][0] == "?" else (-1, 0, 1, None)


def _close(out: list[Item], lone: list[Item]) -> None:
    if lone:
        out.append(("?", tuple(lone)))
        lone.clear()


def flat(item: Item) -> Iterator[str]:
    if isinstance(item, str):
        yield item
    else:
        for part in item[1]:
            yield from flat(part)


def element(token: str) -> str:
    """The name in a structural token; empty for a slot and for an end tag."""
    return "" if token == SLOT or token[1] == "/" else token[1:-1].split(" ")[0]


class Automaton:
    """The tokens of a wrapper as places, and for each the set of places that may be next.

    A set is a whole number with a bit per place. Place 0 is before the first token, the last
    one after the last. A text slot may be missing everywhere.
    """

    def __init__(self, items: list[Item]):
        self.at = 1  # the next place's number
        self.places: dict[str, int] = {}  # per token, the places that hold it
        self.next: list[int] = [0]
        self.begins: list[int] = []  # the first place of each item of the wrapper
        built = []
        for item in items:
            self.begins.append(self.at)
            built.append(self._place(item))
        self.end = self.at
        self.next.append(0)
        self.next[0] = self._chain(built, 1 << self.end)
        self.any = self.places.get(ANY, 0)
        self.steps: dict[int, int] = {}

    def _place(self, item: Item) -> tuple:
        """(places it may begin with, whether it may be empty, how it repeats, its parts)."""
        if isinstance(item, str):
            place, self.at = self.at, self.at + 1
            self.next.append(0)
            self.places[item] = self.places.get(item, 0) | 1 << place
            return 1 << place, item == SLOT, "", place
        parts = [self._place(part) for part in item[1]]
        first, empty = 0, True
        for part in parts:
            if empty:
                first |= part[0]
            empty = empty and part[1]
        return first, empty or item[0] == "?", item[0], parts

    def _chain(self, parts: list[tuple], after: int) -> int:
        """Link the parts, which ``after`` follows; the places that they may begin with."""
        for first, empty, repeats, inner in reversed(parts):
            if isinstance(inner, int):
                self.next[inner] = after
            else:
                self._chain(inner, after | first if repeats == "+" else after)
            after = first | after if empty else first
        return after

    def match(self, shape: list[str]) -> list[int] | None:
        """The place of every token, the earliest that still leads to the end, or None."""
        ahead = [0] * len(shape)  # the places of each token from which the end is reached
        live = 1 << self.end
        live = self._back(live)
        for k in range(len(shape) - 1, -1, -1):
            ahead[k] = live & (self.places.get(shape[k], 0) | self.any)
            if not ahead[k]:
                return None
            live = self._back(ahead[k])
        if not live & 1:
            return None
        found = []
        place = 0
        for k in range(len(shape)):
            open_to = self.next[place] & ahead[k]
            place = (open_to & -open_to).bit_length() - 1
            found.append(place)
        return found

    def _back(self, places: int) -> int:
        """The places that one of ``places`` may follow."""
        if places not in self.steps:
            if len(self.steps) >= min(HELD_STEPS, STEP_BITS // self.end):
                self.steps.clear()
            sources = 0
            for place, after in enumerate(self.next):
                if after & places:
                    sources |= 1 << place
            self.steps[places] = sources
        return self.steps[places]


class Wrapper:
    """A wrapper ready to match: its items, its root element and the texts all pages share."""

    def __init__(self, items: list[Item], root: str, shared: Iterable[int] = ()):
        self.items, self.root, self.shared = items, root, frozenset(shared)
        self.first, self.last = self._region()
        self.places = sum(1 for item in items for _ in flat(item))
        self.automaton = Automaton(items) if self.places <= MOST_PLACES else None
        self.bytes = self.places**2 // 8

    def _region(self) -> tuple[int, int]:
        """The items that hold the root element."""
        if not self.root or any(token == ANY for item in self.items for token in flat(item)):
            return 0, len(self.items)
        opens = [k for k, it in enumerate(self.items) if self.root in map(element, flat(it))]
        closes = [k for k, it in enumerate(self.items) if f"</{self.root}>" in flat(it)]
        first = opens[0] if opens else 0
        after = [k for k in closes if k >= first]
        return first, (after[-1] + 1 if after else len(self.items))

    def match(self, page: Page) -> tuple[int, int] | None:
        """The structural tokens of the page's article, if the page fits."""
        places = self.automaton.match(page.shape) if self.automaton else None
        if places is None:
            return None
        begins = [*self.automaton.begins, self.automaton.end]
        begin = sum(place < begins[self.first] for place in places)  # items keep their order
        return begin, begin + sum(begins[self.first] <= p < begins[self.last] for p in places)

    def text(self, page: Page, span: tuple[int, int]) -> str:
        return span_text(page, span, self.root, self.shared)


def root_of(shape: Iterable[str], first: str = "") -> str:
    """The root element among the tokens, ``first`` before others; empty without one."""
    names = set(map(element, shape))
    return next((name for name in (first, *ROOTS) if name and name in names), "")


def span_text(page: Page, span: tuple[int, int], root: str, shared: frozenset) -> str:
    """Main text of the span, or of the root element in it: a group may begin before it."""
    begin, end = span
    shape = page.shape[begin:end]
    opens = [k for k, token in enumerate(shape) if root and element(token) == root]
    if opens:
        closes = [k for k in range(opens[0], len(shape)) if shape[k] == f"</{root}>"]
        begin, end = begin + opens[0], begin + closes[-1] + 1 if closes else end
    first = page.place[begin] if begin < len(page.place) else len(page.kinds)
    last = page.place[end] if end < len(page.place) else len(page.kinds)
    return main_text(page, first, last, bool(opens), shared)


def other(name: str, named: str, in_root: bool) -> bool:
    """Whether an element is something else than main text."""
    if name in OTHER or (name in OUTSIDE and not in_root):
        return True
    return bool(named) and not OTHER_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", named))


def text_blocks(
    page: Page, first: int, last: int, in_root: bool
) -> Iterator[tuple[tuple[int, ...], str]]:
    """The blocks of the tokens first..last outside of other elements, each with the boxes
    around it, by the token that opens them."""
    parts: list[str] = []
    left_open: dict[str, int] = {}
    for at in range(first, last):
        if page.kinds[at] == "-":
            left_open[page.values[at]] = left_open.get(page.values[at], 0) + 1
    within: list[str] = []  # the other element and the same elements inside it
    boxes: tuple[int, ...] = ()

    def flush() -> Iterator[tuple[tuple[int, ...], str]]:
        block = " ".join("".join(parts).split())
        parts.clear()
        if block:
            yield boxes, block

    for at in range(first, last):
        kind, value = page.kinds[at], page.values[at]
        if kind == "#":
            if not within:
                parts.append(html.unescape(value))
            continue
        around = boxes
        if kind == "-":
            left_open[value] -= 1
            if within:
                if value == within[-1]:
                    within.pop()
            elif boxes and page.values[boxes[-1]] == value:
                around = boxes[:-1]
        elif within:
            if value == within[0]:
                within.append(value)
        elif value not in VOID and left_open.get(value, 0) > 0:  # one that never ends holds nothing
            if value not in ROOTS and other(value, page.names[at], in_root):
                yield from flush()
                within.append(value)
            elif value in BOXES:
                around = (*boxes, at)
        if value == "br":
            parts.append(" ")
        elif value not in INLINE:
            yield from flush()
        boxes = around
    yield from flush()


def hashed(block: str) -> int:
    """A block's hash, a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(block.encode("utf-8", "replace")) - (1 << 63)


def main_text(page: Page, first: int, last: int, in_root: bool, shared: frozenset) -> str:
    """The blocks of the tokens first..last, outside of other elements.

    Where ``shared`` holds the blocks that all pages of a host have, content is the smallest
    box around all other blocks. Of what is outside it only whole sentences stay.
    """
    found = list(text_blocks(page, first, last, in_root))
    own = [boxes for boxes, block in found if shared and hashed(block) not in shared]
    if own:
        box = commonprefix(own)
        found = [
            (boxes, block)
            for boxes, block in found
            if boxes[: len(box)] == box or SENTENCE.fullmatch(block)
        ]
    return "\n\n".join(block for _, block in found)


def places_of(items: Iterable[Item]) -> int:
    return sum(1 for item in items for _ in flat(item))


def repeated(items: Iterable[Item]) -> list[str]:
    """The tokens of a folded page with every group repeated."""
    out: list[str] = []
    for item in items:
        out += [item] if isinstance(item, str) else REPEATS * repeated(item[1])
    return out


def widened(items: list[Item]) -> list[Item]:
    """The wrapper with one group of optional tokens, repeated, for all between its first and
    its last group, or for all of it where the rest is still too wide.

    Whatever sequence of tokens the replaced part takes, the group takes it. One of too many
    tokens takes all.
    """
    groups = [at for at, item in enumerate(items) if not isinstance(item, str)]
    first, last = (groups[0], groups[-1] + 1) if groups else (0, 0)
    if first + len(items) - last >= WIDEST // 2:
        first, last = 0, len(items)
    tokens = sorted({token for item in items[first:last] for token in flat(item)})
    if ANY in tokens or len(tokens) >= WIDEST // 2:
        tokens = [ANY]
    return [*items[:first], ("+", tuple(("?", (token,)) for token in tokens)), *items[last:]]


class Inference:
    """A wrapper that grows by shapes and by other wrappers until it covers all of them."""

    def __init__(self):
        self.items: list[Item] = []
        self.roots: set[str] = set()  # of the pages; empty for a page without one
        self.automaton: Automaton | None = None

    def add_shape(self, shape: list[Item]) -> None:
        """Take a folded page; an empty one says nothing."""
        if shape:
            self.roots.add(root_of(token for item in shape for token in flat(item)))
            if not self._covers(shape):
                self._align(shape)

    def add(self, found: dict) -> None:
        """Take the wrapper of other pages."""
        self.roots.update([found["root"]] * bool(found["items"]), [""] * found["open"])
        items = list(map(_tupled, found["items"]))
        if items and items != self.items:
            self._align(items)

    def _covers(self, shape: list[Item]) -> bool:
        """Whether the wrapper takes the shape, as told by repeating its groups."""
        if not self.items:
            return False
        tokens = repeated(shape)
        if len(tokens) > MOST_REPEATED:
            return False
        if self.automaton is None:
            self.automaton = Automaton(self.items)
        return self.automaton.match(tokens) is not None

    def _align(self, items: list[Item]) -> None:
        self.items = aligned(self.items, items) if self.items else list(items)
        if places_of(self.items) > WIDEST:
            self.items = widened(self.items)
        self.automaton = None

    def found(self) -> dict:
        """The wrapper in a form that JSON holds."""
        root = next((name for name in ROOTS if name in self.roots), "")
        return {"items": self.items, "root": root, "open": "" in self.roots}


def inferred(pages: list[str]) -> dict:
    """The wrapper of a host's pages, in a form that JSON holds."""
    grown = Inference()
    for shape in dict.fromkeys(tuple(folded(list(Page(source).shape))) for source in pages):
        grown.add_shape(list(shape))
    return grown.found()


def page_blocks(source: str) -> list[int]:
    """Hashes of a page's distinct blocks."""
    page = Page(source)
    return sorted({hashed(block) for _, block in text_blocks(page, 0, len(page.kinds), False)})


def infer(pages: list[str]) -> dict:
    """The wrapper of a host that has these pages and no more."""
    found = inferred(pages)
    distinct = [set(page_blocks(source)) for source in set(pages)]
    shared = set.intersection(*distinct) if len(distinct) > 1 and found["open"] else set()
    return found | {"shared": sorted(shared)}


def _tupled(item):
    return item if isinstance(item, str) else (item[0], tuple(map(_tupled, item[1])))


class Extractor:
    """The wrapper of one host, and what its odd pages were resolved into, by shape."""

    def __init__(self, wrapper: str | None, shared: Iterable[int] | None = None):
        found = json.loads(wrapper) if wrapper else {"items": [], "root": ""}
        self.items = [_tupled(item) for item in found["items"]]
        self.root = found["root"]
        self.shared = frozenset(found.get("shared", ()) if shared is None else shared)
        self.known = Wrapper(self.items, self.root, self._shared(self.root))
        self.odd: dict[tuple, Wrapper] = {}
        self.odd_bytes = 0

    def _shared(self, root: str) -> frozenset:
        """What is template in a page: in an article or main element, nothing."""
        return frozenset() if root else self.shared

    def text(self, source: str) -> str:
        page = Page(source)
        span = self.known.match(page)
        if span is not None:
            root = root_of(page.shape, self.root)
            if root == self.root:
                return self.known.text(page, span)
            # The host's other pages have another root: this one's own, or all of it, counts.
            return span_text(page, (0, len(page.shape)), root, self._shared(root))
        shape = tuple(folded(list(page.shape)))
        if shape not in self.odd:
            if self.odd_bytes > HELD_ODD:
                self.odd.clear()
                self.odd_bytes = 0
            self.odd[shape] = self._resolved(list(shape))
            self.odd_bytes += self.odd[shape].bytes + 100 * len(shape)
        wrapper = self.odd[shape]
        span = wrapper.match(page)
        return wrapper.text(page, (0, len(page.shape)) if span is None else span)

    def _resolved(self, shape: list[Item]) -> Wrapper:
        """The wrapper with this shape's mismatches resolved."""
        items = aligned(self.items, shape) if self.items else shape
        root = root_of((token for item in shape for token in flat(item)), self.root)
        return Wrapper(items, root, self._shared(root))


def host_of(url: str = "url"):
    """The host of an absolute url in lower case, else empty."""
    return F.lower(F.regexp_extract(text_of(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1))


SHAPES = pa.schema([("host", pa.string()), ("digest", pa.int64()), ("shape", pa.string())])
PARTS = pa.schema([("host", pa.string()), ("bucket", pa.int64()), ("wrapper", pa.string())])


def shapes(pages: DataFrame) -> DataFrame:
    """The folded shapes of all pages by host; a task tells each once, as far as it knows."""
    rows = pages.select(host_of().alias("host"), text_of("html").alias("html"))

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        told: set[tuple] = set()
        for part in parts:
            for host, source in zip(*part.columns, strict=True):
                shape = json.dumps(folded(list(Page(source.as_py()).shape)))
                key = host.as_py(), xxhash.xxh3_128_digest(shape.encode("utf-8", "replace"))
                if key in told:
                    continue
                if len(told) >= HELD_SHAPES:
                    told.clear()
                told.add(key)
                yield key[0], hashed(shape), shape

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(each(parts), SHAPES, 1024)

    return rows.mapInArrow(run, "host string, digest bigint, shape string")


def wrappers(pages: DataFrame) -> DataFrame:
    """One row per host with its wrapper, inferred from all its pages.

    The shapes of a host are dealt to buckets, so that a host of many does not hold one task;
    sorted, they are read one by one. Only the buckets' wrappers meet.
    """

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, before, grown = None, None, Inference()
        for part in parts:
            for host, bucket, shape in zip(*part.columns, strict=True):
                key = host.as_py(), bucket.as_py()
                if at is not None and key != at:
                    yield *at, json.dumps(grown.found())
                    before, grown = None, Inference()
                at, shape = key, shape.as_py()
                if shape != before:
                    grown.add_shape(list(map(_tupled, json.loads(shape))))
                before = shape
        if at is not None:
            yield *at, json.dumps(grown.found())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(each(parts), PARTS, 64)

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        grown = Inference()
        for wrapper in group.sort_values("bucket")["wrapper"]:
            grown.add(json.loads(wrapper))
        return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(grown.found())]})

    dealt = shapes(pages).withColumn("bucket", F.pmod("digest", F.lit(BUCKETS)))
    parts = (
        dealt.repartition("host", "bucket")
        .sortWithinPartitions("host", "bucket", "digest", "shape")
        .select("host", "bucket", "shape")
        .mapInArrow(run, "host string, bucket bigint, wrapper string")
    )
    # BUCKETS rows of a host at most.
    return stored(
        parts.groupBy("host").applyInPandas(one, "host string, wrapper string"), "wrappers"
    )


BLOCKS = pa.schema(
    [("host", pa.string()), ("page", pa.string()), ("blocks", pa.list_(pa.int64()))]
)


def shared_blocks(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Per host with pages without a root element: hashes of the blocks that all its distinct
    pages have.

    All pages of such a host count. One of its pages bounds what a host's row can hold.
    """
    open_hosts = known.where(F.get_json_object("wrapper", "$.open") == "true").select("host")
    rows = pages.select(host_of().alias("host"), text_of("html").alias("html"))

    def blocks_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for part in parts:
                for host, source in zip(*part.columns, strict=True):
                    source = source.as_py()
                    page = xxhash.xxh3_128_hexdigest(source.encode("utf-8", "replace"))
                    yield host.as_py(), page, page_blocks(source)

        return batches(each(), BLOCKS, 1024)

    distinct = (
        rows.join(open_hosts, "host", "left_semi")
        .mapInArrow(blocks_of, "host string, page string, blocks array<bigint>")
        .groupBy("host", "page")
        .agg(F.first("blocks").alias("blocks"))
    )
    distinct = stored(distinct, "blocks")
    sizes = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return (
        distinct.select("host", F.explode("blocks").alias("block"))
        .groupBy("host", "block")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(sizes.where("pages > 1"), "host")
        .where("n = pages")
        .groupBy("host")
        .agg(F.collect_list("block").alias("shared"))
    )


TEXTS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]
)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page.

    The stored wrappers have a known size: small ones are sent to the pages, otherwise both
    are shuffled by host and adaptive execution splits large hosts.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", "html", host_of().alias("host")
    )
    known = wrappers(pages)
    shared = shared_blocks(pages, known)
    learned = stored(
        known.join(shared, "host", "left").select("host", "wrapper", "shared"), "learned"
    )
    joined = rows.join(learned, "host", "left").select(
        "page_id", "url", "html", "host", "wrapper", "shared"
    )

    def texts(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        hosts: dict[str, Extractor] = {}
        held = 0
        for part in parts:
            for page_id, url, source, host, wrapper, shared in zip(*part.columns, strict=True):
                host = host.as_py()
                if host not in hosts:
                    if len(hosts) >= 256 or held > HELD_KNOWN:
                        hosts.clear()
                        held = 0
                    hosts[host] = Extractor(wrapper.as_py(), shared.as_py() or ())
                    held += hosts[host].known.bytes
                text = hosts[host].text(source.as_py() or "")
                yield page_id.as_py(), url.as_py(), text, len(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(texts(parts), TEXTS, 1024)

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
