"""The bootstrap against a plain loop, its gates, and independence of partitioning."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import forecast
from tests.conftest import rows_of

P = 2_147_483_647


def plain_draw(seed, i, k):
    x = (i * 1_000_003 + k * 7_919 + seed) % P
    x = (x * x + 12_345) % P
    x = (x * 48_271 + i * 31 + k) % P
    x = (x * x + k * 101 + seed) % P
    return (x * 69_621 + i) % P


def plain_periods(sample, scope, seed, iterations, limit=520):
    out = []
    for i in range(iterations):
        delivered = k = 0
        while delivered < scope and k < limit:
            k += 1
            delivered += sample[plain_draw(seed, i, k) % len(sample)]
        out.append(k)
    return sorted(out)


def rank(values, percent):
    return values[max(1, -(-percent * len(values) // 100)) - 1]


def samples(spark, **teams):
    return spark.createDataFrame(list(teams.items()), "team_id string, sample array<bigint>")


def scopes(spark, **teams):
    return spark.createDataFrame(list(teams.items()), "team_id string, scope bigint")


WEEKS = [3, 0, 5, 2, 4, 1, 0, 6, 3, 2, 4, 5, 0, 2]


def test_bootstrap_matches_a_plain_loop(spark):
    gate = forecast.forecast_eligibility(samples(spark, a=WEEKS), scopes(spark, a=25))
    got = {
        r["scenario"]: (r["remaining_items"], r["iterations"], r["p50_periods"], r["p85_periods"])
        for r in forecast.bootstrap_forecast(gate, seed=7, iterations=1_200).collect()
    }
    for name, scope in (("scope", 25), ("scope_plus_20", 30)):
        taken = plain_periods(WEEKS, scope, 7, 1_200)
        assert got[name] == (scope, 1_200, rank(taken, 50), rank(taken, 85))


def test_same_seed_same_result_for_any_partitioning(spark):
    gate = forecast.forecast_eligibility(
        samples(spark, a=WEEKS, b=WEEKS[::-1]), scopes(spark, a=25, b=40)
    )
    first = rows_of(forecast.bootstrap_forecast(gate.repartition(1), iterations=700))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = rows_of(forecast.bootstrap_forecast(gate.repartition(3), iterations=700))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first == again
    other = rows_of(forecast.bootstrap_forecast(gate, seed=1, iterations=700))
    assert len(other) == len(first)


@pytest.mark.parametrize(
    ("sample", "scope", "reasons"),
    [
        ([5, 9, 9, 9, 9], 10, ["too_few_weeks"]),
        ([1] * 14, 10, ["too_few_completions"]),
        ([0] * 5, 10, ["too_few_weeks", "too_few_completions"]),
        ([3] * 14, 0, ["no_sample_or_scope"]),
        ([3] * 14, 10, []),
    ],
)
def test_gate(spark, sample, scope, reasons):
    row = forecast.forecast_eligibility(samples(spark, a=sample), scopes(spark, a=scope)).first()
    assert (row["reasons"], row["eligible"]) == (reasons, not reasons)
    relaxed = forecast.forecast_eligibility(
        samples(spark, a=[0] * 14), scopes(spark, a=5), min_weeks=0, min_completions=0
    ).first()
    assert relaxed["reasons"] == ["no_completion"]


def test_scope_plus_twenty_rounds_half_to_even(spark):
    frame = spark.createDataFrame([(n,) for n in (5, 12, 25, 0)], "scope bigint")
    larger = frame.select(forecast.scope_scenarios()[1]["remaining_items"].alias("n"))
    assert [r["n"] for r in larger.collect()] == [6, 14, 30, 0]


def test_a_scope_out_of_reach_stops_at_the_limit(spark):
    gate = forecast.forecast_eligibility(samples(spark, a=[3] * 14), scopes(spark, a=10_000))
    row = forecast.bootstrap_forecast(gate, iterations=50, max_periods=40).first()
    assert (row["p50_periods"], row["p85_periods"]) == (40, 40)


def test_draws_are_even(spark):
    grid = spark.range(2_000).withColumn("period", F.explode(F.expr("sequence(1L, 50L)")))
    drawn = grid.select((forecast.draw(20260913, F.col("id"), F.col("period")) % 10).alias("d"))
    counts = [row["count"] for row in drawn.groupBy("d").count().collect()]
    assert len(counts) == 10 and min(counts) > 9_600 and max(counts) < 10_400


def test_samples_follow_week_order(spark):
    weeks = spark.createDataFrame(
        [("a", 3, 30), ("a", 1, 10), ("a", 2, 20)], "team_id string, week int, completed bigint"
    )
    for n in (1, 3):
        assert forecast.throughput_samples(weeks.repartition(n)).first()["sample"] == [10, 20, 30]
    assert weeks.select(F.sum("completed")).first()[0] == 60
