"""BPE encoding by longest matches that are taken back where merges would not make them.

The tokens that begin at every byte of a pre-token come from one pass of an Aho-Corasick
automaton over it; the automaton holds the tokens back to front and reads the pre-token from
its end. The encoder goes on with the longest of them whose pair with the token before is
compatible, which means that merging in rank order never joins bytes across their border. If
none is, the token before is taken back and its next shorter prefix tried; a place once given
up is not tried again, so the steps grow with the bytes. The tokens that remain are exactly
those of the merges. Decoding cuts tokens out of one run of bytes by a table of offsets.

Vocabulary, merges and added tokens are read from a tokenizer file on the driver and
broadcast; their size is the vocabulary's, never the corpus'. A worker builds its automaton
once and keeps it. Texts are encoded in the task that reads them: nothing is shuffled, a worker
holds at most ``HELD_WORDS`` pre-tokens with their ids, and losing it repeats its rows only.

Defined cases: a null text counts as empty and has no ids; an added token's text is its id; a
text of any length is encoded whole; rows that repeat an id each give a row, null ids too; an
empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose ids a worker remembers; beyond, it starts anew. Longer ones are not kept.
HELD_WORDS, HELD_CHARS = 500_000, 64
#: Pairs of tokens whose compatibility a worker remembers.
HELD_PAIRS = 1_000_000
#: Texts beyond this are split match by match, not into a list.
LONG_TEXT = 1_000_000
#: Characters of the texts of one batch of results, but for one longer text.
BATCH_CHARS = 4_000_000

#: The split of byte-level tokenizer files that name none of their own.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?LETTER+| ?NUMBER+| ?OTHER+|\s+(?!\S)|\s+"


def split_rule(letter: str, number: str, other: str) -> regex.Pattern:
    rule = SPLIT.replace("LETTER", letter).replace("NUMBER", number).replace("OTHER", other)
    return regex.compile(rule)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
ENCODED_SQL = "doc_id bigint, ids array<int>"


def unassigned_letters() -> str:
    """Letters and numbers of the expression engine that are unassigned in the Unicode version
    of Python's tables, as ranges of a character class. Tokenizer files know them neither."""
    rule = regex.compile(r"[\p{L}\p{N}]")
    later = [
        point for point in range(sys.maxunicode + 1)
        if unicodedata.category(chr(point)) == "Cn" and rule.match(chr(point))
    ]
    borders = [k for k in range(1, len(later)) if later[k] != later[k - 1] + 1]
    return "".join(
        rf"\U{later[a]:08x}-\U{later[b - 1]:08x}"
        for a, b in zip([0, *borders], [*borders, len(later)], strict=True)
        if later
    )


def ranges_of(rule: str, without: str) -> str:
    """The characters of 16 bits that ``rule`` matches, less the class ``without``, as ranges."""
    every = "".join(map(chr, range(0x10000)))
    less = f"(?![{without}])" if without else ""
    return "".join(
        rf"\u{ord(run[0]):04x}-\u{ord(run[-1]):04x}"
        for run in regex.findall(rf"(?:{less}{rule})+", every)
    )


class Split:
    """Pre-tokens of a text. Texts of 16-bit characters are split by classes listed one by
    one, which Python's own engine runs through several times as fast. Of the others only
    texts with a character that the engine alone takes for a letter or number need the longer
    expression, which gives the same on all others."""

    def __init__(self, unassigned: str):
        space, letters, numbers = ranges_of(r"\s", ""), *(
            ranges_of(rule, unassigned) for rule in (r"\p{L}", r"\p{N}")
        )
        self.short = re.compile(
            SPLIT.replace("(?!\\S)", f"(?![^{space}])").replace("\\s", f"[{space}]")
            .replace("LETTER", f"[{letters}]").replace("NUMBER", f"[{numbers}]")
            .replace("OTHER", f"[^{space}{letters}{numbers}]")
        )
        self.wide = re.compile("[\U00010000-\U0010ffff]")
        self.usual = split_rule(r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]")
        self.odd = regex.compile(f"[{unassigned}]" if unassigned else r"(?!)")
        known = f"(?![{unassigned}])" if unassigned else ""
        self.exact = split_rule(
            rf"(?:{known}\p{{L}})", rf"(?:{known}\p{{N}})", rf"(?:(?!{known}[\p{{L}}\p{{N}}])\S)"
        )

    def __call__(self, text: str) -> Iterator[str]:
        if text.isascii() or self.wide.search(text) is None:
            rule = self.short
        else:
            rule = self.usual if self.odd.search(text) is None else self.exact
        if len(text) < LONG_TEXT:
            return iter(rule.findall(text))
        return (hit.group() for hit in rule.finditer(text))


def byte_letters() -> dict[str, int]:
    """The byte that every letter of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others follow from 256 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in set(shown)]
    letters = {chr(byte): byte for byte in shown}
    return letters | {chr(256 + k): byte for k, byte in enumerate(hidden)}


class Vocabulary:
    """What a byte-level BPE tokenizer file says, as plain data that a broadcast carries."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, split = whole["model"], whole["pre_tokenizer"]
        plain = (
            model["type"] == "BPE" and split["type"] == "ByteLevel" and split["use_regex"]
            and not split["add_prefix_space"] and whole["normalizer"] is None
            and not model.get("ignore_merges") and not model.get("dropout")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"]
                        for t in whole["added_tokens"])
        )
        if not plain:
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        letters = byte_letters()
        self.tokens = {
            int(number): bytes(letters[letter] for letter in token)
            for token, number in model["vocab"].items()
            if all(letter in letters for letter in token)
        }
        self.added = {t["content"]: int(t["id"]) for t in whole["added_tokens"]}
        numbers = model["vocab"]
        #: (left, right) to (rank, merged), in the order of the file.
        self.merges = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[numbers[left], numbers[right]] = (rank, numbers[left + right])
        self.unassigned = unassigned_letters()
        with open(path, "rb") as file:
            self.digest = hashlib.sha256(file.read()).hexdigest()


class Encoder:
    """Longest matches, pair compatibility and backtracking over one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.merges = vocabulary.merges
        #: Rank of the merge that makes a token, and its two sides; a byte has none.
        self.made: dict[int, tuple[int, int, int]] = {}
        for (left, right), (rank, token) in vocabulary.merges.items():
            self.made.setdefault(token, (rank, left, right))
        self.pairs: dict[tuple[int, int], bool] = {}
        # A token that its own merges do not make never stands in a result.
        by_bytes = {
            content: token for token, content in vocabulary.tokens.items()
            if len(content) == 1 or self._made_whole(token)
        }
        if any(bytes([byte]) not in by_bytes for byte in range(256)):
            raise ValueError("the vocabulary lacks some bytes")
        self.size = {token: len(content) for content, token in by_bytes.items()}
        self.most = max(self.size.values())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for content, token in by_bytes.items():
            self.automaton.add_word(content.decode("latin-1"), token)
        self.automaton.make_automaton()
        #: The longest token that is a shorter prefix of a token, or -1.
        self.shorter = {}
        for content, token in by_bytes.items():
            cut = len(content) - 1
            while cut and content[:cut] not in by_bytes:
                cut -= 1
            self.shorter[token] = by_bytes[content[:cut]] if cut else -1

    def _made_whole(self, token: int) -> bool:
        made = self.made.get(token)
        return made is not None and self.compatible(made[1], made[2], made[0])

    def compatible(self, left: int, right: int, until: int = sys.maxsize) -> bool:
        """Whether merges of a lower rank than ``until`` leave the border of two tokens alone.

        The tokens' parts at the border are looked at from the last merge back. Two parts
        stand side by side until the merge that takes up either; a merge of the two that
        comes earlier crosses the border. At equal rank the left place goes first.
        """
        known = self.pairs.get((left, right)) if until == sys.maxsize else None
        if known is not None:
            return known
        pair, made = (left, right), self.made
        left_taken = right_taken = until
        result = True
        while True:
            met = self.merges.get((left, right))
            if met is not None and met[0] < left_taken and met[0] <= right_taken and met[0] < until:
                result = False
                break
            of_left, of_right = made.get(left), made.get(right)
            if of_left is None and of_right is None:
                break
            # The later of the two merges is undone first.
            if of_right is None or (of_left is not None and of_left[0] >= of_right[0]):
                left_taken, left = of_left[0], of_left[2]
            else:
                right_taken, right = of_right[0], of_right[1]
        if until == sys.maxsize:
            if len(self.pairs) >= HELD_PAIRS:
                self.pairs.clear()
            self.pairs[pair] = result
        return result

    def encode(self, text: bytes) -> list[int]:
        """The ids that merging in rank order gives."""
        size, letters = len(text), text.decode("latin-1")
        sizes, shorter, compatible = self.size, self.shorter, self.compatible
        open_at = bytearray(b"\x01") * (size + 1)
        taken: list[int] = []
        # Every byte is a token, so longest matches lie end to end; they are the tokens to
        # take as long as none is shortened.
        ahead = self.automaton.iter_long(letters)
        place, token, in_step = 0, -1, True
        while place < size:
            if token < 0:
                if in_step:
                    token = next(ahead)[1]
                else:
                    near = self.automaton.iter_long(letters[place : place + self.most])
                    token = next(near)[1]
            last = taken[-1] if taken else -1
            while token >= 0:
                if open_at[place + sizes[token]] and (last < 0 or compatible(last, token)):
                    break
                token, in_step = shorter[token], False
            if token >= 0:
                taken.append(token)
                place += sizes[token]
                token = -1
            else:
                # Nothing fits here after the token before: give the place up.
                open_at[place] = 0
                last = taken.pop()
                place -= sizes[last]
                token = shorter[last]
                while token < 0:
                    open_at[place] = 0
                    last = taken.pop()
                    place -= sizes[last]
                    token = shorter[last]
        return taken


class Offsets:
    """Token bytes as one run, cut by offsets; ids without a token decode to nothing."""

    def __init__(self, vocabulary: Vocabulary):
        contents = vocabulary.tokens | {
            number: content.encode() for content, number in vocabulary.added.items()
        }
        sizes = np.zeros(max(contents) + 1, np.int64)
        for number, content in contents.items():
            sizes[number] = len(content)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        run = b"".join(contents.get(number, b"") for number in range(len(sizes)))
        self.run = np.frombuffer(run, np.uint8)

    def decoded(self, ids: np.ndarray) -> str:
        """The text; bytes that are no text become replacement characters."""
        begins, sizes = self.begins[ids], self.ends[ids] - self.begins[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(begins - (ends - sizes), sizes)
        return self.run[at].tobytes().decode("utf-8", "replace")


class Ids(dict):
    """The packed ids of pre-tokens; one is encoded when first asked for."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        packed = array("i", self.encoder.encode(word.encode())).tobytes()
        if len(word) <= HELD_CHARS:
            if len(self) >= HELD_WORDS:
                self.clear()
            self[word] = packed
        return packed


_WORDS: dict[str, Ids] = {}


def ids_of(vocabulary: Vocabulary) -> Ids:
    """The worker's encoder and pre-tokens for a vocabulary; a worker keeps the last one."""
    if vocabulary.digest not in _WORDS:
        _WORDS.clear()
        _WORDS[vocabulary.digest] = Ids(Encoder(vocabulary))
    return _WORDS[vocabulary.digest]


class TextEncoder:
    """Whole texts: added tokens apart, the rest by pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.split = Split(vocabulary.unassigned)
        # Where two added tokens begin, the longer one is meant.
        contents = sorted(vocabulary.added, key=len, reverse=True)
        self.apart = regex.compile("|".join(map(regex.escape, contents)) or r"(?!)")
        self.added = {
            content: array("i", [number]).tobytes()
            for content, number in vocabulary.added.items()
        }
        self.ids = ids_of(vocabulary)

    def encode(self, text: str) -> np.ndarray:
        parts: list[bytes] = []
        begin, known = 0, self.ids.__getitem__
        for hit in self.apart.finditer(text):
            parts.extend(map(known, self.split(text[begin : hit.start()])))
            parts.append(self.added[hit.group()])
            begin = hit.end()
        parts.extend(map(known, self.split(text[begin:] if begin else text)))
        return np.frombuffer(b"".join(parts), np.int32)


def _lists(doc_ids: list, lists: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(ids) for ids in lists], out=offsets[1:])
    flat = np.concatenate([np.zeros(0, np.int32), *lists])
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
        schema=ENCODED,
    )


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every row, by the tokenizer file at ``path``."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def encoded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TextEncoder(vocabulary.value)
        doc_ids, lists, chars = [], [], 0
        for part in parts:
            for doc_id, value in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                text = value.as_py() or ""
                doc_ids.append(doc_id)
                lists.append(coder.encode(text))
                chars += len(text)
                if chars >= BATCH_CHARS:
                    yield _lists(doc_ids, lists)
                    doc_ids, lists, chars = [], [], 0
        if doc_ids:
            yield _lists(doc_ids, lists)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(
        encoded, ENCODED_SQL
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and the ``decoded`` text of encoded rows; null ids decode to ''."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))
    schema = pa.schema([*ENCODED, ("decoded", pa.string())])

    def looked_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Offsets(vocabulary.value)
        for part in parts:
            lists = part.column(1)
            texts = [
                table.decoded(ids.values.to_numpy(zero_copy_only=False)) if ids.is_valid else ""
                for ids in lists
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), lists.cast(schema.field("ids").type), pa.array(texts, pa.string())],
                schema=schema,
            )

    return encoded.selectExpr("cast(doc_id as bigint) doc_id", "ids").mapInArrow(
        looked_up, ENCODED_SQL + ", decoded string"
    )


def digests(decoded: DataFrame) -> DataFrame:
    """The contract's columns of :func:`decode`."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
