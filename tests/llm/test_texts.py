"""Text operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from plumbline.llm import bpe, class_lm, learning, ngram_join, pii, quality, toxicity
from plumbline.llm.common import Scratch
from plumbline.llm.common import held_out

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    None, "", " ", "\n\t ", "word", "the  end \n\n of it's 123 €", "x" * 5000, "a b " * 3000,
    "naïve \U0001f600 text <|endoftext|>", "\x1c\x85\xa0mixed　spaces ",
]


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    """The contract's base, by its own patterns."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_base_spans_equal_the_patterns():
    chance = random.Random(5)
    bits = ["a.b", "@", "x-y.org", ".", "1", "22", "300", " ", "-", "+", "(", ")", "4111 1111 1111 1111",
            "1.2.3.4", "é", "+1 (212) 555-0100", "word", "0001", "\n"]
    for _ in range(3000):
        text = "".join(chance.choice(bits) for _ in range(chance.randint(0, 14)))
        base, every = pii.spans_of(text)
        assert pii.joined(base) == base_spans(text), text
        assert set(base) <= set(every)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("to jane.doe (at) example (dot) com today", ["email:3:34"]),
        ("jane7 at mail dot example dot org", ["email:0:33"]),
        ("jаne@exаmple.com", ["email:0:16"]),
        ("pe​ter@exa​mple.com", ["email:0:19"]),
        ("four one one one one one one one one one one one one one one one", ["card:0:64"]),
        ("plus four nine one five one two three four five six seven", ["phone:0:57"]),
        ("one nine two dot one six eight dot zero dot one", ["ip:0:47"]),
        ("look at example.com for one or two days. dot it", []),
    ],
)
def test_disguises(text, found):
    assert pii.joined(pii.spans_of(text)[1]).split(",") == (found or [""])


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("write to maria.lopez@example dot com today", "email:9:36"),
        ("host 192 dot 168 dot 0 dot 1 is up", "ip:5:28"),
        ("call +1 212 dot 555 dot 0100 now", "phone:5:28"),
        ("(plus 49 170 1234567)", "phone:1:20"),
        ("Tel:\nplus 44 20 7946 0958", "phone:5:25"),
        ("plus 49 170 1234567 is mine", "phone:0:19"),
        ("(four 111 1111 1111 1111)", "card:1:24"),
        ("(four 111 one 111 one 111 one 111)", "card:1:33"),
        ("jane7 arroba example.com", "email:0:24"),
        ("192.168.one-2.7", "ip:0:15"),
        ("ask bob@localhost. dot it, 3 dot 4 plus 5 at home", ""),
    ],
)
def test_every_rewriting_is_reached_and_kept(text, found):
    assert pii.joined(pii.spans_of(text)[1]) == found


def test_the_gate_is_no_narrower_than_the_rewriting(monkeypatch):
    chance = random.Random(8)
    bits = ["plus ", "(", ")", "one", "two ", "-", " ", "3", "4.5", "dot ", " dot ", " at ", "\n",
            "[at]", "&#46;", "x7", "y.org", "@", ".", "+4", " punkt ", "null", "\u200b", "111 2222 "]
    texts = ["".join(chance.choices(bits, k=chance.randint(1, 16))) for _ in range(6000)]
    gated = [pii.spans_of(text) for text in texts]
    monkeypatch.setattr(pii, "suspicious", lambda text: True)
    assert gated == [pii.spans_of(text) for text in texts]


def test_pii_rows(documents):
    docs = documents([(1, None, "x"), (2, "a@b.co a@b.co", "x"), (2, "no", None)])
    rows = {(r.doc_id, r.n_email, r.spans) for r in pii.find(docs).collect()}
    assert rows == {(1, 0, ""), (2, 2, "email:0:6,email:7:13"), (2, 0, "")}
    assert pii.find(docs.limit(0)).count() == 0
    assert pii.redacted("mail a@b.co now") == "mail <email> now"


def test_positions_are_packed_by_byte():
    chance = np.random.default_rng(1)
    values = (chance.random(200_000) ** 4 * 150_000).astype(np.uint32)
    plain = pa.compress(values.tobytes(), codec="zstd", asbytes=True)
    assert len(bpe.packed(values)) < 0.9 * len(plain)
    for some in (values, values[3:4], values[:0]):
        assert bpe.unpacked(bpe.packed(some), len(some), np.uint32).tolist() == some.tolist()
        assert bpe.recounted(bpe.counted(some)).tolist() == some.tolist()


def test_bpe_equals_the_library(spark, documents, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 4000)
    ranks = {token: rank for rank, token in enumerate(bpe.read_ranks(RANKS)) if token}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                              special_tokens={})
    docs = documents([(i, t, "x") for i, t in enumerate(ODD)] + [(0, "again", "x")])
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    got = sorted((r.doc_id, np.frombuffer(r.ids, np.uint32).tolist()) for r in coded.collect())
    assert got == sorted((r.doc_id, coder.encode_ordinary(r.text or "")) for r in docs.collect())
    back = sorted((r.doc_id, r.decoded.decode()) for r in bpe.decode(coded, RANKS).collect())
    assert back == sorted((r.doc_id, r.text or "") for r in docs.collect())
    sums = {r.doc_id: r for r in bpe.digests(docs.where("doc_id > 0"), RANKS, public_tokenizers.PATTERN).collect()}
    ids = np.array(coder.encode_ordinary(ODD[5]), "<u4").tobytes()
    assert sums[5].ids_sha256 == hashlib.sha256(ids).hexdigest()
    assert sums[5].decoded_sha256 == hashlib.sha256(ODD[5].encode()).hexdigest()
    assert bpe.digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_base_score_and_classes(documents, monkeypatch):
    monkeypatch.setattr(class_lm, "NUMBERED", 12)
    monkeypatch.setattr(class_lm, "CLUSTERED", 6)
    monkeypatch.setattr(class_lm, "CLASSES", 3)
    chance = random.Random(2)
    words = ["The", "cat", "dog", "runs", "sits", "a", "É", "on", *[f"rare{k}" for k in range(30)]]
    rows = [(i, " ".join(chance.choices(words, k=chance.randint(0, 30))), "x") for i in range(90)]
    rows += [(i + 100, t, "x") for i, t in enumerate(ODD)] + [(None, "cat", "x"), (5, "dog dog", "x")]
    counts = Counter()
    for i, t, _ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            counts.update((t or "").encode().lower().split() + [b"\n"])
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for i, t, _ in rows:
        tokens = (t or "").encode().lower().split() + [b"\n"]
        score = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        expected[(i, len(tokens), sum(w in counts for w in tokens), n, round(score, 6))] += 1
    found = class_lm.scored(documents(rows)).collect()
    assert expected == Counter(
        (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found
    )
    assert all(r.score < 0 for r in found)
    assert class_lm.scored(documents([])).count() == 0


def grammar(sentences):
    """Texts in which words of five kinds follow each other, with many rare words of each."""
    chance = random.Random(4)
    kinds = [[f"{kind}{k}" for k in range(40)] for kind in "abcde"]
    share = [1 / (k + 1) for k in range(40)]
    return [
        (i, " ".join(chance.choices(kinds[(i + k) % 5], share)[0] for k in range(12)), "x")
        for i in range(sentences)
    ] + [(sentences, "zulu", "x"), (sentences + 1, None, "x"), (sentences + 2, "zulu a1", "x")]


@pytest.mark.parametrize("numbers", [12, 60, 500])
def test_score_equals_plain_loops(documents, monkeypatch, numbers):
    monkeypatch.setattr(class_lm, "NUMBERED", numbers)
    monkeypatch.setattr(class_lm, "CLUSTERED", 10)
    monkeypatch.setattr(class_lm, "CLASSES", 6)
    monkeypatch.setattr(class_lm, "HELD_PAIRS", 50)
    rows = grammar(400)
    docs = documents(rows)
    training = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    model, far = class_lm.train(docs.where(~held_out(10)))
    far = {bytes(r["word"]): (r["class"], r["n"]) for r in far.collect()}
    known = model.words | far
    counts = Counter(w for _, t, _ in training for w in class_lm.tokens_of(t))
    assert {w: n for w, (_, n) in known.items()} == counts
    assert len(model.words) == min(numbers, len(counts)) and not set(model.words) & set(far)
    rest, start = class_lm.REST, class_lm.START
    assert all((of == rest) == (n < class_lm.LEAST) for of, n in known.values())

    def steps(text):
        history = start
        for word in class_lm.tokens_of(text):
            own, n = known.get(word, (rest, 0))
            yield history, own, n
            history = own if word in model.words else rest

    pairs, totals, members = Counter(), Counter(), Counter(of for of, _ in known.values())
    for _, text, _ in training:
        for history, own, _ in steps(text):
            pairs[history, own] += 1
            totals[own] += 1
    after = Counter()
    for (history, _), n in pairs.items():
        after[history] += n
    classes = [k for k in range(class_lm.HISTORIES) if k != start]
    every = sum(totals[k] + class_lm.ADDED for k in classes)

    def brute(text):
        total = 0.0
        for history, own, n in steps(text):
            share = (totals[own] + class_lm.ADDED) / every
            back = class_lm.BACK_OFF
            total += math.log10((pairs[history, own] + back * share) / (after[history] + back))
            total += math.log10(
                (n + class_lm.ADDED) / (totals[own] + class_lm.ADDED * (members[own] + 1))
            )
        return total

    found = class_lm.scored(docs).collect()
    assert len(found) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for row in found:
        assert row.score == pytest.approx(brute(texts[row.doc_id]), abs=1e-6)
    held = [row for row in found if row.held_out]
    assert sum(row.score for row in held) > sum(row.base_score for row in held) + 0.2 * len(held)


def test_scores_of_long_texts_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "HELD_CHAIN", 100)
    names = "doc_id bigint, text string, n bigint, word string, row int, `a.b` int"
    rows = [(None, None, 1, "a", 1, 1), (1, "zz " * 30_000, 2, "b", 1, 1), (1, "", 3, "c", 1, 1)]
    found = class_lm.scored(spark.createDataFrame(rows, names)).collect()
    assert sorted(r.n_tokens for r in found) == [1, 1, 30_001]
    assert all(r.n_known == r.n_tokens and r.train_tokens == 30_003 for r in found)
    empty = {round(r.score, 9) for r in found if r.n_tokens == 1}
    assert len(empty) == 1 and all(r.score < 0 for r in found)


def test_all_words_of_the_least_count_are_settled(documents, monkeypatch):
    monkeypatch.setattr(class_lm, "NUMBERED", 60)
    monkeypatch.setattr(class_lm, "CLUSTERED", 25)
    monkeypatch.setattr(class_lm, "CLASSES", 6)
    model, far = class_lm.train(documents(grammar(1500)))
    table = {bytes(r["word"]): (r["class"], r["n"]) for r in far.collect()}
    for words in (model.words, table):  # most words of a kind share a class, near and far
        kinds = {}
        for word, (of, n) in words.items():
            if n >= 10 and word != class_lm.END:
                kinds.setdefault(word[:1], Counter())[of] += 1
        assert len(kinds) == 5
        tops = [found.most_common(1)[0] for found in kinds.values()]
        assert len({of for of, _ in tops}) == 5
        assert sum(n for _, n in tops) >= 0.8 * sum(sum(f.values()) for f in kinds.values())


def test_numbered_words_break_ties_by_their_bytes(spark):
    counts = spark.createDataFrame(
        [(bytearray(w), n) for w, n in [(b"d", 2), (b"c", 2), (b"b", 2), (b"a", 5)]],
        "word binary, n bigint",
    )
    assert class_lm.numbered(counts, 3) == [(b"a", 5), (b"b", 2), (b"c", 2)]
    assert class_lm.numbered(counts, 0) == []


def test_exchange_finds_planted_classes():
    chance = np.random.default_rng(1)
    matrix = np.zeros((12, 12), np.int64)
    for a in range(10):
        for b in range(10):
            matrix[a, b] = chance.integers(40, 60) if a % 2 != b % 2 else chance.integers(0, 3)
    of = class_lm.exchange(matrix, 10, 2, 10)
    assert len({of[k] for k in range(0, 10, 2)}) == 1 and of[0] != of[1]


def brute_components(rows, words, percent):
    sets = []
    for _, text, _ in rows:
        tokens = (text or "").encode().lower().split()
        spans = range(max(1, len(tokens) - words + 1)) if tokens else ()
        sets.append(frozenset(tuple(tokens[k : k + words]) for k in spans))
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((rows[k][0], len(sets[k]), least[find(k)]) for k in range(len(rows)))


def near_copies(chance, n, size, edits):
    base = [f"w{chance.randint(0, 400)}" for _ in range(size)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(chance.randint(0, edits)):
            copy[chance.randrange(size)] = f"v{chance.randint(0, 999)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("words", "percent", "cell"), [(3, 90, 2048), (5, 80, 5)])
def test_join_equals_all_pairs(documents, monkeypatch, words, percent, cell):
    monkeypatch.setattr(ngram_join, "CELL", cell)
    chance = random.Random(words)
    texts = near_copies(chance, 60, 120, 6) + near_copies(chance, 40, 30, 2)
    texts += near_copies(chance, 30, 700, 40) + near_copies(chance, 10, 4, 1)
    shared = " ".join(f"common{k}" for k in range(60))
    texts += [f"{shared} " + " ".join(f"u{i}x{k}" for k in range(chance.randint(0, 90))) for i in range(40)]
    texts += [t for t in ODD] + ["one two", "ONE two", "two one", "one  TWO"]
    chance.shuffle(texts)
    rows = [(10 * k + 3, t, "x") for k, t in enumerate(texts)]
    found = ngram_join.components_of(documents(rows), words, percent).collect()
    assert sorted(map(tuple, found)) == brute_components(rows, words, percent)


@pytest.mark.parametrize(("cell", "grams"), [(512, 2_000_000), (7, 2_000_000), (512, 900)])
def test_links_equal_all_pairs(documents, monkeypatch, cell, grams):
    monkeypatch.setattr(ngram_join, "LINK_CELL", cell)
    monkeypatch.setattr(ngram_join, "LINK_GRAMS", grams)
    monkeypatch.setattr(ngram_join, "LINK_PAIRS", 50)
    chance = random.Random(9)
    texts = near_copies(chance, 40, 90, 5) + near_copies(chance, 25, 33, 1) + ["", None, "a b", "A b"]
    texts += texts[:6]
    rows = [(7 * k + 2, t, "x") for k, t in enumerate(texts)]
    sets = []
    for _, text, _ in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set())
    links = [
        sum(j != k and bool(s) and 100 * len(s & o) >= 80 * len(s | o) for j, o in enumerate(sets))
        for k, s in enumerate(sets)
    ]
    found = ngram_join.links_of(documents(rows), 3, 80).collect()
    assert {r.doc_id: r.n_links for r in found} == {r[0]: n for r, n in zip(rows, links, strict=True)}
    assert sorted(tuple(r)[:3] for r in found) == brute_components(rows, 3, 80)


def test_join_of_few_rows(documents):
    assert ngram_join.links_of(documents([])).count() == 0
    assert ngram_join.components_of(documents([])).count() == 0
    docs = documents([(7, "a b c d e f", "x"), (3, "A b  c d e f", "y"), (9, None, None)])
    found = {tuple(r) for r in ngram_join.components_of(docs).collect()}
    assert found == {(7, 2, 3), (3, 2, 3), (9, 0, 9)}
    assert {r.doc_id for r in ngram_join.representatives(docs).collect()} == {3, 9}


def test_whole_sets_stay_in_their_buckets(spark, documents):
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (40, 41, 80)]
    docs = documents([(k, text, "x") for k, text in enumerate(texts)])
    scratch = Scratch(spark)
    rows = ngram_join.signed(docs, 3, 90)
    sets = ngram_join.sets_of(docs, rows, rows.select("id"), 3, scratch)
    key = spark.sql(f"describe extended {scratch.tables[scratch.held[-1][1]]}").where(
        "col_name = 'Bucket Columns'"
    )
    assert key.first()["data_type"] == "[`set_key`]"
    ids = [r["id"] for r in rows.orderBy("doc_id").collect()]
    pairs = scratch.stored(
        spark.createDataFrame([(ids[0], ids[1]), (ids[0], ids[2])], "a bigint, b bigint"), "pairs"
    )
    found = ngram_join.verified(pairs, sets, 90, scratch)
    assert [tuple(r) for r in found.collect()] == [(ids[0], ids[1])]
    scratch.release_all_but()
    assert not scratch.tables


def test_sets_without_a_partner_are_left(spark, documents, monkeypatch):
    texts = [" ".join(f"{w}{k}" for k in range(n)) for w, n in (("w", 60), ("w", 61), ("v", 60), ("w", 90))]
    rows = ngram_join.signed(documents([(k, text, "x") for k, text in enumerate(texts)]), 3, 90)
    ids = [r["id"] for r in rows.orderBy("doc_id").collect()]

    def members(*placed):
        schema = "token bigint, id bigint, sets bigint, grams bigint"
        return spark.createDataFrame([(t, ids[k], n, 60 * n) for t, k, n in placed], schema)

    # The three first texts in one group, and the third with the first in another.
    groups = members((1, 0, 3), (1, 1, 3), (1, 2, 3), (2, 0, 2), (2, 2, 2))
    scratch = Scratch(spark)
    found = ngram_join.with_partners(rows, groups, 90, scratch).collect()
    assert sorted(map(tuple, found)) == sorted([(1, ids[0]), (1, ids[1])])
    monkeypatch.setattr(ngram_join, "CELL", 2)
    found = ngram_join.with_partners(rows, groups, 90, scratch).collect()
    assert sorted(map(tuple, found)) == sorted((1, key) for key in ids[:3])
    # The last text is too long to link, though it shares its n-grams; groups come once.
    found = ngram_join.candidates(rows, 90, scratch).collect()
    assert {r["id"] for r in found} == set(ids[:2])
    assert len({r["token"] for r in found}) * 2 == len(found) <= 4


def test_groups_without_pairs_are_walked_once(spark, documents):
    texts = [" ".join(f"{w}{k}" for k in range(n)) for w, n in (("w", 60), ("w", 61), ("v", 60))]
    docs = documents([(k, text, "x") for k, text in enumerate(texts)])
    scratch = Scratch(spark)
    rows = ngram_join.signed(docs, 3, 90)
    ids = [r["id"] for r in rows.orderBy("doc_id").collect()]
    sets = ngram_join.sets_of(docs, rows, rows.select("id"), 3, scratch)
    placed = [(1, ids[0]), (1, ids[1]), (2, ids[0]), (2, ids[2])]
    members = spark.createDataFrame(placed, "token bigint, id bigint")
    labels = members.selectExpr("id", "id label").limit(0)
    pairs, left = ngram_join.tree_pairs(sets, members, labels, 90, True, scratch)
    assert [tuple(r) for r in pairs.collect()] == [tuple(sorted(ids[:2]))]
    assert sorted(r["id"] for r in left.collect()) == sorted(ids[:2])


def labelled_texts(n, seed):
    chance = random.Random(seed)
    words = [chance.choice("bcdfgl") + chance.choice("aeiou") + chance.choice("mnrst") for _ in range(300)]
    rows = []
    for i in range(n):
        text = [chance.choice(words) for _ in range(chance.randint(15, 60))]
        toxic, good = int(chance.random() < 0.25), int(chance.random() < 0.7)
        if toxic:
            for _ in range(3):
                text.insert(chance.randrange(len(text)), "zork" + chance.choice(["ig", "en", "", "us"]))
        if not good:
            text = [w + "###" for w in text]
        rows.append((i, " ".join(text), toxic, good))
    return rows


@pytest.mark.parametrize("kind", ["toxicity", "quality"])
def test_held_out_accuracy(spark, documents, kind):
    rows = labelled_texts(500, 4)
    docs = documents([(i, t, "x") for i, t, _, _ in rows] + [(900, None, "x"), (901, "", None), (3, "twice", "x")])
    labels = spark.createDataFrame([(i, g, t) for i, _, t, g in rows], "doc_id bigint, quality int, toxic int")
    model = toxicity if kind == "toxicity" else quality
    truth = {i: t if kind == "toxicity" else g for i, _, t, g in rows}
    found = model.classified(docs, labels).collect()
    assert len(found) == len(rows) + 3 and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and r.doc_id in truth and r.doc_id != 3]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    none = model.classified(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}


def test_toxic_rows_go_and_columns_stay(spark, documents):
    rows = labelled_texts(400, 6)
    docs = documents([(i, t, "x") for i, t, _, _ in rows]).withColumnRenamed("lang", "toxicity")
    labels = spark.createDataFrame([(i, t) for i, _, t, _ in rows], "doc_id bigint, toxic int")
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    wrong = sum((i in left) == bool(t) for i, _, t, _ in rows)
    assert wrong <= 8


def test_isotonic_rises():
    knots, levels = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5, 5]), np.array([0.0, 1, 0, 1, 1, 0]))
    assert list(knots) == [1, 3, 5] and np.allclose(levels, [0, 0.5, 2 / 3])


def test_toxicity_is_not_learned_in_the_driver(spark, documents, monkeypatch):
    rows = labelled_texts(300, 5)
    docs = documents([(i, t, "x") for i, t, _, _ in rows])
    labels = spark.createDataFrame([(i, t) for i, _, t, _ in rows], "doc_id bigint, toxic int")
    here = toxicity.Model(*learning.sample(docs, labels, "toxic"))

    def refused(*_):
        raise AssertionError("learned in the driver")

    with monkeypatch.context() as patch:
        patch.setattr(toxicity.Model, "__init__", refused)
        model = toxicity.train(docs, labels)
    assert model.lexicons.odds == here.lexicons.odds
    assert model.trees.trees == here.trees.trees
    assert model.knots.tolist() == here.knots.tolist()
    assert toxicity.train(docs, labels.limit(0)).share == 0


def test_turns_without_a_link_are_not_repeated(documents, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    # Sets of 58 n-grams that share 55: 100 * 55 < 95 * 61, and full bitmaps cannot tell.
    own = [[f"x{k}{j}" for j in range(3)] for k in range(4)]
    rows = [(k, " ".join([*words[:57], *own[k]]), "x") for k in range(4)]
    rows.append((9, " ".join(sum(own, []) * 10), "x"))  # so what they share is rarer
    turns = []
    walk, relabel = ngram_join.tree_pairs, ngram_join.relabelled
    monkeypatch.setattr(ngram_join, "bitmap", lambda hashes, room=4: bytes([255] * 8))
    monkeypatch.setattr(ngram_join, "tree_pairs", lambda *a: turns.append(a[4]) or walk(*a))
    monkeypatch.setattr(ngram_join, "relabelled", lambda *a: turns.append("labels") or relabel(*a))
    found = ngram_join.components_of(documents(rows), 3, 95).collect()
    assert sorted(map(tuple, found)) == [*[(k, 58, k) for k in range(4)], (9, 12, 9)]
    assert turns == [True, False]
