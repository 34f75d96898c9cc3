"""Odd columns and values that earlier versions crashed on or left out."""

import math
import random

import pytest

from plumbline.llm import exact_dedup, mixing, ngram_join, topk_search, toxicity

DOTTED = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` string, "
    "`score` double, `doc.text` int, digest string, label int, words int"
)


def dotted(spark, rows):
    full = [(i, t, "en", s, len(t or ""), "x.y", 0.5, 7, "d", 1, 2) for i, t, s in rows]
    return spark.createDataFrame(full, DOTTED)


def test_dotted_and_clashing_columns_pass_the_stages(spark):
    chance = random.Random(1)
    texts = [" ".join(chance.choice("abcdefghij") * 3 for _ in range(40)) for _ in range(30)]
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate([*texts, texts[0], "", None])]
    docs = dotted(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(20)], "doc_id bigint, toxic int")
    kept = exact_dedup.survivors(docs, exact_dedup.new_index(spark))
    assert kept.columns == docs.columns and kept.count() == 31
    for stage in (
        toxicity.accepted(docs, labels), ngram_join.representatives(docs), mixing.mixed(docs)
    ):
        assert stage.columns == docs.columns
        found = stage.collect()
        assert found and {(r["a.b"], r["doc.text"]) for r in found} == {("x.y", 7)}
    # No rows at all: the classifier then learns from none.
    for stage in (
        exact_dedup.survivors(docs.limit(0), exact_dedup.new_index(spark)),
        ngram_join.representatives(docs.limit(0)),
        mixing.mixed(docs.limit(0)),
    ):
        assert stage.columns == docs.columns and stage.count() == 0


def test_a_very_long_text_is_mixed_and_deduplicated_whole(spark):
    long = "word and another " * 60_000
    docs = dotted(spark, [(1, long, "a"), (2, long + " ", "a"), (3, "short text here", "b")])
    kept = exact_dedup.survivors(docs, exact_dedup.new_index(spark)).collect()
    assert {r.doc_id for r in kept} == {2, 3}
    out = mixing.mixed(docs).collect()
    known = set(long.split()) | {"short", "text", "here"}
    assert out and all(set(r.text.split()) <= known for r in out)


def brute(rows, k):
    own = {
        i: [math.floor(256 * x) for x in v]
        for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    best = set()
    for i, q in own.items():
        if i % 50 == 0:
            scored = sorted(
                (-sum(a * b for a, b in zip(q, v)), j) for j, v in own.items() if j != i
            )
            best |= {(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)}
    return best


@pytest.mark.parametrize("scale", [3e5, 1e6])
def test_every_finite_vector_takes_part(spark, scale):
    chance = random.Random(int(scale))
    rows = [(i, [chance.uniform(-1, 1) * scale for _ in range(4)]) for i in range(120)]
    rows += [(150, [300000.0, 1.0, 0.0, -2.5]), (200, [1e6, -1e6, 0.0, 0.25]), (201, [0.0, 0.0, 0.0, 0.0])]
    rows += [(250, [float("inf"), 0.0, 0.0, 0.0]), (251, [float("nan")] * 4), (252, None)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    queries = topk_search.quantised(frame.where("vec_id % 50 = 0"))
    found = topk_search.search(topk_search.build_index(frame), queries, 5).collect()
    assert {tuple(r) for r in found} == brute(rows, 5)


def test_scores_and_components_beyond_64_bits_raise(spark):
    schema = "vec_id bigint, embedding array<double>"
    wide = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1.0, 2.0])], schema)
    queries = topk_search.quantised(wide.where("vec_id = 0"))
    found = topk_search.search(topk_search.build_index(wide), queries, 5).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 256 * 256 * 1_000_000_002)]
    both = spark.createDataFrame([(0, [1e9]), (1, [1e9])], schema)
    queries = topk_search.quantised(both.where("vec_id = 0"))
    with pytest.raises(Exception, match="64 bits"):
        topk_search.search(topk_search.build_index(both), queries, 5).collect()
    with pytest.raises(Exception, match="beyond"):
        topk_search.quantised(spark.createDataFrame([(0, [1e300])], schema)).collect()
