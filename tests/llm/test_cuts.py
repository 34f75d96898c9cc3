"""Fill-in-middle, backtracking BPE and periodic runs against plain versions of their own."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import backtracking_bpe, fill_middle, periodic_runs

FILE = public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LONG = "many words in a row, " * 4000 + "Ω" * 3000
ODD = [
    None, "", " ", "\n\t ", "word", "the  end \n\n of it's 123 €", "x" * 5000, "a b " * 3000,
    "naïve \U0001f600 text <|endoftext|>", "\x1c\x85\xa0mixed　spaces ", "has <P> in it", "<", LONG,
    "same text", "same text", "<|endoftext|><|endoftext|>", "߿࢏1࢏ \U00010940\U00010941!",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crowded(spark, rows):
    """Documents among columns whose names clash with everything an operator makes."""
    return spark.createDataFrame(
        [(i, t, 1, "x", 2.0, "y") for i, t in rows],
        "doc_id bigint, text string, n int, `ids.form` string, output double, runs string",
    )


def rows_of_odd():
    return [*enumerate(ODD), (3, "again under one id"), (None, "without an id, but text")]


# Fill-in-middle


def cut_plainly(doc_id, text):
    text = text or ""
    tokens = TOKENS.findall(text)
    n = len(tokens)
    name = f"42:{'' if doc_id is None else doc_id}"
    digits = hashlib.sha256(name.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(p) for p in (tokens[:low], tokens[low:high], tokens[high:]))
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_equals_whole_token_lists(spark):
    chance = random.Random(2)
    bits = ["a", "word ", " ", "\n", "é", "\U0001f600", "<", "P>", "longer words here and there "]
    rows = rows_of_odd() + [
        (1000 + k, "".join(chance.choice(bits) for _ in range(chance.randint(0, 200))))
        for k in range(200)
    ]
    cut = fill_middle.fill_in_middle(crowded(spark, rows))
    got = sorted((tuple(r) for r in cut.collect()), key=repr)
    assert got == sorted((cut_plainly(i, t) for i, t in rows), key=repr)
    back = cut.select(
        "doc_id", fill_middle.original(cut["output"], cut["form"]).alias("text")
    ).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((i, t or "")) for i, t in rows)
    forms = {r.form for r in cut.collect()}
    assert forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize("sizes", [(64, 256, 4096), (1, 2, 8), (1, 2, 3), (2, 4, 5)])
def test_chunks_of_any_size_give_the_same_places(monkeypatch, sizes):
    for name, size in zip(("LEAST_CHUNK", "MEAN_CHUNK", "MOST_CHUNK"), sizes, strict=True):
        monkeypatch.setattr(fill_middle, name, size)
    chance, memo = random.Random(sum(sizes)), fill_middle.Memo(500)
    bits = ["a", " ", "\n", "é", "<P>", "<", "M", ">", "\x85", "word", "  "]
    for _ in range(1500):
        text = "".join(chance.choice(bits) for _ in range(chance.randint(0, 60)))
        assert "".join(chunks(text)) == text
        tokens, outline = TOKENS.findall(text), fill_middle.Outline(text, memo)
        assert outline.tokens == len(tokens), text
        assert outline.marked == any(m in text for m in ("<P>", "<S>", "<M>")), text
        for k in range(len(tokens) + 1):
            assert outline.place(k) == len("".join(tokens[:k])), (text, k)


def chunks(text):
    begins = [0, *fill_middle.chunk_ends(text)]
    return [text[a:b] for a, b in zip(begins, begins[1:])]


def test_a_shared_passage_is_summarised_once():
    chance = random.Random(9)
    passage = " ".join(str(chance.random()) for _ in range(400))
    memo = fill_middle.Memo()
    fill_middle.Outline("first " + passage, memo)
    known = len(memo)
    fill_middle.Outline("another beginning, quite a bit longer: " + passage, memo)
    assert known > 15 and len(memo) <= known + 4


def test_fill_in_middle_of_nothing(spark):
    empty = fill_middle.fill_in_middle(crowded(spark, []))
    assert fill_middle.digests(empty).collect() == []


# Backtracking BPE


@pytest.fixture(scope="module")
def library():
    known = Tokenizer.from_file(FILE)
    known.no_truncation()
    known.no_padding()
    return known


@pytest.fixture(scope="module")
def coder():
    return backtracking_bpe.TextEncoder(backtracking_bpe.Vocabulary(FILE))


def test_encoding_equals_the_library(spark, library):
    rows = rows_of_odd()
    encoded = backtracking_bpe.encode(crowded(spark, rows), FILE)
    decoded = backtracking_bpe.decode(encoded, FILE)
    got = sorted(map(tuple, decoded.collect()), key=repr)
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    digests = {r.doc_id: r for r in backtracking_bpe.digests(decoded).collect()}
    assert digests[1].n_tokens == 0 and digests[1].ids_sha256 == sha("")
    assert digests[8].decoded_sha256 == sha(ODD[8])


def test_any_pre_token_equals_the_library(library, coder):
    chance = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    tokens = [c.decode("utf-8", "ignore") for c in backtracking_bpe.Vocabulary(FILE).tokens.values()]
    texts = ["ab" * 4000, "a" * 9999, " " * 700 + "x", "'s'll've" * 50]
    for _ in range(2500):
        kind = chance.random()
        source = tokens if kind < 0.4 else letters if kind < 0.8 else ["aa", "ab", " ", "ther", "in"]
        texts.append("".join(chance.choice(source) for _ in range(chance.randint(1, 20))))
    texts += [f"a{chr(c)}1{chr(c)}! " for c in (0x558, 0x88F, 0xA7CE, 0x10940, 0x2FFFE, 0x378, 0x85)]
    for text, known in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert coder.encode(text).tolist() == known.ids, text


def test_listed_classes_split_like_the_whole_expression():
    split = backtracking_bpe.Split(backtracking_bpe.unassigned_letters())
    assert isinstance(split.short, re.Pattern)
    chance = random.Random(4)
    pool = [chr(point) for point in range(0x10000) if not 0xD800 <= point < 0xE000]
    near = " \t\n'sdlrevem a1A.\x1c\x1f\x85\xa0\u3000"
    texts = ["".join(pool), " ".join(pool)]
    for _ in range(2000):
        texts.append("".join(chance.choice(pool if chance.random() < 0.4 else near) for _ in range(30)))
    for text in texts:
        assert list(split(text)) == split.exact.findall(text)


def test_ids_of_no_text_decode_like_the_library(library):
    table, chance = backtracking_bpe.Offsets(backtracking_bpe.Vocabulary(FILE)), random.Random(6)
    for _ in range(800):
        ids = [chance.randrange(50257) for _ in range(chance.randint(0, 8))]
        assert table.decoded(np.array(ids, np.int64)) == library.decode(
            ids, skip_special_tokens=False
        )


def test_a_pair_is_compatible_if_merging_keeps_it(library):
    vocabulary = backtracking_bpe.Vocabulary(FILE)
    encoder, chance = backtracking_bpe.Encoder(vocabulary), random.Random(8)
    own = list(vocabulary.tokens.items())

    def merged(text):
        parts = [encoder_bytes[bytes([b])] for b in text]
        while True:
            ranked = [
                (vocabulary.merges[pair][0], k)
                for k, pair in enumerate(zip(parts, parts[1:])) if pair in vocabulary.merges
            ]
            if not ranked:
                return parts
            _, k = min(ranked)
            parts[k : k + 2] = [vocabulary.merges[parts[k], parts[k + 1]][1]]

    encoder_bytes = {content: token for token, content in own if len(content) == 1}
    for _ in range(4000):
        (a, left), (b, right) = chance.choice(own), chance.choice(own)
        assert encoder.compatible(a, b) == (merged(left + right) == [a, b]), (left, right)


def test_encoding_of_nothing_and_other_files(spark, tmp_path):
    empty = backtracking_bpe.encode(crowded(spark, []), FILE)
    assert backtracking_bpe.digests(backtracking_bpe.decode(empty, FILE)).collect() == []
    with pytest.raises(ValueError):
        backtracking_bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


# Periodic runs


def runs_plainly(words):
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in best.items())


def planted_plainly(doc_id, text):
    words = WORDS.findall(text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def row_plainly(doc_id, text):
    words = planted_plainly(doc_id, text)
    runs = runs_plainly(words)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    start, length, period = longest or (None, None, None)
    return (
        doc_id, len(runs), start, length, period, longest and 1000 * length // period,
        sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(kept),
    )


def test_runs_of_documents_equal_brute_force(spark):
    chance = random.Random(12)
    rows = rows_of_odd()[:12] + [(3, "x " * 40), (None, "a b c " * 9), (77, " a " * 300)]
    for k in range(400):
        words = [str(chance.randrange(chance.choice([2, 5, 1000]))) for _ in range(chance.randint(0, 150))]
        rows.append((2000 + k, "\n".join(words)))
    found = periodic_runs.find(periodic_runs.planted(crowded(spark, rows)))
    got = sorted(map(tuple, periodic_runs.digests(found).collect()), key=repr)
    assert got == sorted((row_plainly(i, t) for i, t in rows), key=repr)


@pytest.mark.parametrize("pattern", [8, 1 << 16])
def test_runs_of_words_equal_brute_force(monkeypatch, pattern):
    monkeypatch.setattr(periodic_runs, "PATTERN", pattern)
    monkeypatch.setattr(periodic_runs, "MATRIX", 1 << 12)
    chance = random.Random(pattern)
    for _ in range(150):
        texts = []
        for _ in range(chance.randint(1, 6)):
            few, n = chance.choice([1, 2, 3, 50]), chance.choice([0, 1, 11, 12, 13, 40, 300])
            words = [str(chance.randrange(few)) for _ in range(n)]
            for _ in range(chance.randint(0, 3) if n > 5 else 0):
                a = chance.randrange(n)
                p = 1 + chance.randrange(max(1, (n - a) // 2))
                for i in range(a, min(n, a + p * chance.randint(2, 6))):
                    words[i] = words[a + (i - a) % p]
            texts.append(words)
        assert periodic_runs.runs_of(texts) == [runs_plainly(words) for words in texts]


def test_sums_of_squared_differences_are_exact():
    chance = np.random.default_rng(3)
    codes = chance.integers(0, 40, 3000)
    for width in (2, 16, 64, 256):
        blocks = np.arange(0, 512, width)
        got = periodic_runs.differences(codes, blocks, width, 2 * width - 1, 2 * width)
        for row, b in enumerate(blocks):
            for q in range(2 * width):
                there = codes[b + 2 * width - 1 + q :][:width]
                assert got[row, q] == ((codes[b : b + width] - there) ** 2).sum() % periodic_runs.PRIME


def test_a_long_text_of_one_word_is_one_run():
    assert periodic_runs.runs_of([["x"] * 50_000]) == [[(0, 50_000, 1)]]
    assert periodic_runs.collapsed(["x"] * 50_000, [(0, 50_000, 1)]) == "x"


def test_runs_of_nothing(spark):
    docs = periodic_runs.planted(crowded(spark, []))
    assert periodic_runs.digests(periodic_runs.find(docs)).collect() == []
