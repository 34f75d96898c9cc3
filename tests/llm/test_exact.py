"""Exact duplicates, top-k search and mixing against plain loops."""

import hashlib
import math
import random
from collections import Counter

import pytest

from plumbline.llm import exact_dedup, mixing, topk_search

GAPS = " \t\n\x0b\x0c\r"


def plain(text):
    return "".join(c for c in text or "" if c not in GAPS)


def test_exact_groups_and_ties(spark, documents):
    rows = [
        (5, "a b c", "x"), (2, "abc", "x"), (9, "a  b c", None), (4, "a  b c", "x"),
        (1, None, "x"), (3, "", "x"), (7, " \n", "y"), (8, "é", "y"), (8, "é", "y"),
    ]
    docs = documents(rows)
    found = exact_dedup.deduplicate(docs, exact_dedup.new_index(spark)).collect()
    assert len(found) == len(rows)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(plain(t), []).append((-len(t or ""), i))
    for i, keep, size, kept, sha in sorted(found):
        mine = next(p for p in groups if hashlib.sha256(p.encode()).hexdigest() == sha)
        assert keep == min(groups[mine])[1] and size == len(groups[mine])
        assert not kept or i == keep
    assert sum(row.kept for row in found) == len(groups)


def test_second_batch_keeps_what_the_index_holds(spark, documents):
    index = exact_dedup.new_index(spark)
    exact_dedup.deduplicate(documents([(1, "a b", "x")]), index).collect()
    found = exact_dedup.deduplicate(documents([(2, "a   b", "x"), (3, "c", "x")]), index).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in found} == {(2, 1, False), (3, 3, True)}
    assert index.rows().count() == 2


def test_survivors_keep_columns_and_one_of_equal_rows(spark, documents):
    docs = documents([(1, "a", "x"), (1, "a", "x"), (2, "a ", "x"), (None, "n", "x"), (3, "b", None)])
    docs = docs.withColumnRenamed("lang", "digest")
    kept = exact_dedup.survivors(docs, exact_dedup.new_index(spark))
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == ["a ", "b", "n"]


def test_exact_of_an_empty_table(spark, documents):
    assert exact_dedup.deduplicate(documents([]), exact_dedup.new_index(spark)).count() == 0


def brute_top(rows, k):
    usable = {
        i: [math.floor(256 * x) for x in v]
        for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = set()
    for q in (i for i in usable if i % 50 == 0):
        score = {i: sum(a * b for a, b in zip(usable[q], v, strict=False)) for i, v in usable.items() if i != q}
        best = sorted(score.items(), key=lambda p: (-p[1], p[0]))[:k]
        out |= {(q, rank + 1, i, s) for rank, (i, s) in enumerate(best)}
    return out


@pytest.mark.parametrize("block", [4_096, 7])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk_search, "INDEX_ROWS", block)
    chance = random.Random(3)
    rows = [(i, [chance.uniform(-1, 1) for _ in range(6)]) for i in range(180)]
    rows += [(i, [0.5] * 6) for i in range(180, 260)]  # ties
    rows += [(300, [0.25, None, 1.0, 0.0, 0.0, 0.0]), (350, None), (400, [float("nan")] * 6),
             (450, [float("inf")] * 6), (500, [3.0, -70.5, 0.1, 0.0, 9.0, 1.0]), (501, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    queries = topk_search.quantised(frame.where("vec_id % 50 = 0"))
    found = topk_search.search(topk_search.build_index(frame), queries, 5).collect()
    import numpy as np
    narrow = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert {tuple(r) for r in found} == brute_top(narrow, 5)


def test_top_k_of_few_and_no_rows(spark):
    one = spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<float>")
    assert topk_search.search(topk_search.build_index(one), topk_search.quantised(one)).count() == 0
    none = one.limit(0)
    assert topk_search.search(topk_search.build_index(none), topk_search.quantised(none)).count() == 0


def test_query_packs_are_not_broadcast(spark, monkeypatch):
    """A pack is repeated for every group of index blocks: the driver must never hold them."""
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 16)
    rows = [(i, [float(i % 7), float(-i)]) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = topk_search.search(topk_search.build_index(frame), topk_search.quantised(frame), 3)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {tuple(r) for r in found.where("query_id % 50 = 0").collect()} == brute_top(rows, 3)


def level_targets(sizes):
    """The contract's sharing, turn by turn."""
    weights = dict(zip(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))], strict=True))
    left, open_, out = 1.5 * sum(sizes.values()), dict(weights), {}
    while open_:
        total = sum(open_.values())
        over = [s for s, w in open_.items() if left * w / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * w / total for s, w in open_.items()}
        for s in over:
            out[s] = 2.0 * sizes[s]
            del open_[s]
        left = 1.5 * sum(sizes.values()) - sum(out.values())
    return out


@pytest.mark.parametrize("block, shard", [(64, 65_536), (3, 10)])
def test_mix_meets_its_targets(documents, block, shard):
    chance = random.Random(8)
    rows = [(i, " ".join("w" * chance.randint(0, 40)), chance.choice(["a", "b", "c", "é", None]))
            for i in range(300)]
    rows += [(400, None, "a"), (401, "", "b"), (402, "one two", "tiny"), (7, "x y z", "c")]
    found = mixing.Mix(documents(rows), block, shard).taken().collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    ordered = {s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))}
    expected = level_targets(ordered)
    by_target = Counter()
    for row in found:
        assert 0 <= row.taken <= 2 * row.size
        by_target[row.target] += row.taken
    for target in expected.values():
        same = sum(t for t in expected.values() if abs(t - target) < 1e-9)
        assert abs(sum(n for t, n in by_target.items() if abs(t - target) < 1e-6) - same) <= 3
    again = mixing.Mix(documents(rows), block, shard).taken().collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F

    for length in (1, 2, 7, 64, 1000):
        there = mixing.permuted(F.col("id"), F.lit(length), F.lit(3))
        back = mixing.permuted(F.col("there"), F.lit(length), F.lit(3), inverse=True)
        rows = spark.range(length).withColumn("there", there).withColumn("back", back).collect()
        assert {r.there for r in rows} == set(range(length))
        assert all(r.id == r.back for r in rows)


def test_mixed_documents_hold_the_words_taken(documents):
    rows = [(i, f"  d{i} " + "\n".join(f"w{k}" for k in range(i % 50)), "ab"[i % 2]) for i in range(120)]
    docs = documents([*rows, (500, None, "a"), (501, "same", "b"), (501, "same", "b")])
    mix = mixing.Mix(docs).taken()
    taken = Counter()
    for row in mix.collect():
        taken[row.doc_id] += row.taken
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = Counter()
    for row in out.collect():
        words[row.doc_id] += len(row.text.split())
        assert row.n_chars == len(row.text)
    assert sum(words.values()) == sum(taken.values())


def test_mix_of_an_empty_table(documents):
    assert mixing.Mix(documents([])).taken().count() == 0
    assert mixing.mixed(documents([])).count() == 0
