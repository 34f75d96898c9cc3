"""Throughput forecast: a bootstrap over every team, scenario and iteration.

Each iteration draws weeks with replacement until the scope is delivered. A draw depends
only on (seed, iteration, period), so results do not change with partitioning. Iterations
are rows; Spark folds the draws of each in its own expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import vocabulary as v

_PRIME = 2_147_483_647
# Periods of the first stretch of draws.
STRETCH = 16


def draw(seed: int, iteration: Column, period: Column) -> Column:
    """A pseudo-random integer in [0, 2^31 - 1) for an iteration and period.

    Squarings modulo a prime with the inputs mixed in; all products stay below 2^63. Each
    step is an array of one, so that it is computed once for both of its uses.
    """

    def step(x: Column, then) -> Column:
        return F.transform(F.array(x), then)[0]

    first = (iteration * 1_000_003 + period * 7_919 + seed) % _PRIME
    second = step(first, lambda x: ((x * x + 12_345) % _PRIME * 48_271 + iteration * 31 + period) % _PRIME)
    return step(second, lambda x: ((x * x + period * 101 + seed) % _PRIME * 69_621 + iteration) % _PRIME)


def scope_scenarios(scope: str = "scope") -> list:
    """The scope as given and twenty percent larger, ties rounded to even."""
    given = F.col(scope)
    larger = F.bround(given.cast("decimal(18,0)") * F.lit("1.2").cast("decimal(2,1)"), 0)
    return [
        F.struct(F.lit("scope").alias("scenario"), given.cast("bigint").alias("remaining_items")),
        F.struct(
            F.lit("scope_plus_20").alias("scenario"), larger.cast("bigint").alias("remaining_items")
        ),
    ]


def throughput_samples(throughput: DataFrame) -> DataFrame:
    """Weekly counts of each team in week order; a team's weeks bound the array."""
    return throughput.groupBy("team_id").agg(
        F.array_sort(F.collect_list(F.struct("week", "completed"))).alias("weeks")
    ).select("team_id", F.col("weeks.completed").cast("array<bigint>").alias("sample"))


def forecast_eligibility(
    samples: DataFrame,
    scopes: DataFrame,
    min_weeks: int = v.MIN_WEEKS,
    min_completions: int = v.MIN_COMPLETIONS,
) -> DataFrame:
    """Whether each team can be forecast, with every reason that speaks against it."""
    total = F.aggregate("sample", F.lit(0).cast("bigint"), lambda a, b: a + b)
    weeks = F.size("sample")
    short = F.array_compact(
        F.array(
            F.when(weeks < min_weeks, "too_few_weeks"),
            F.when(F.col("completions") < min_completions, "too_few_completions"),
        )
    )
    nothing = (weeks == 0) | (F.col("scope") <= 0)
    reasons = (
        F.when(F.size("short") > 0, F.col("short"))
        .when(nothing, F.array(F.lit("no_sample_or_scope")))
        .when(F.col("completions") == 0, F.array(F.lit("no_completion")))
        .otherwise(F.array().cast("array<string>"))
    )
    return (
        samples.join(scopes, "team_id")
        .withColumn("completions", total)
        .withColumn("short", short)
        .select(
            "team_id",
            "sample",
            "scope",
            weeks.cast("bigint").alias("weeks"),
            "completions",
            reasons.alias("reasons"),
        )
        .withColumn("eligible", F.size("reasons") == 0)
    )


def bootstrap_forecast(
    eligibility: DataFrame,
    seed: int = v.DEFAULT_SEED,
    iterations: int = v.FORECAST_ITERATIONS,
    max_periods: int = v.MAX_PERIODS,
) -> DataFrame:
    """P50 and P85 periods to deliver each scope scenario, per eligible team.

    One fold per iteration serves both scenarios; once the larger scope is delivered the
    state passes through. The percentiles count distinct durations, of which there are at
    most ``max_periods``.
    """
    spark = eligibility.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = F.expr(f"sequence(0L, {iterations - 1}L)")
    grid = (
        eligibility.where("eligible")
        .select("team_id", "sample", F.array(*scope_scenarios()).alias("scenarios"))
        .select("*", F.explode(numbers).alias("iteration"))
        .repartition(tasks, "team_id", "iteration")
    )
    scopes = [F.col("scenarios")[at]["remaining_items"] for at in (0, 1)]
    zero = F.lit(0).cast("bigint")

    def one_more(state: Column, period: Column) -> Column:
        drawn = F.col("sample")[
            (draw(seed, F.col("iteration"), period) % F.size("sample")).cast("int")
        ]
        count = [
            state[name] + F.when(state["delivered"] < scope, 1).otherwise(0)
            for name, scope in zip(("first", "second"), scopes, strict=True)
        ]
        following = F.struct(
            (state["delivered"] + drawn).alias("delivered"),
            count[0].cast("bigint").alias("first"),
            count[1].cast("bigint").alias("second"),
        )
        return F.when(state["delivered"] >= F.greatest(*scopes), state).otherwise(following)

    start = F.struct(zero.alias("delivered"), zero.alias("first"), zero.alias("second"))
    taken = grid.withColumn("taken", start)
    begin = 0
    while begin < max_periods:  # longer stretches for the iterations still short
        end = min(max_periods, 4 * begin + STRETCH)
        periods = F.expr(f"sequence({begin + 1}L, {end}L)")
        done = F.col("taken.delivered") >= F.greatest(*scopes)
        further = F.aggregate(periods, F.col("taken"), one_more)
        taken = taken.withColumn("taken", F.when(done, F.col("taken")).otherwise(further))
        begin = end
    each = F.array(
        *[
            F.struct(
                F.col("scenarios")[at]["scenario"].alias("scenario"),
                scopes[at].alias("remaining_items"),
                F.col("taken")[name].alias("periods"),
            )
            for at, name in enumerate(("first", "second"))
        ]
    )
    durations = (
        taken.select("team_id", F.inline(each))
        .groupBy("team_id", "scenario", "remaining_items", "periods")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    return _percentiles(durations, ["team_id", "scenario", "remaining_items"])


def _percentiles(durations: DataFrame, by: list[str]) -> DataFrame:
    """Nearest-rank P50 and P85 of counted durations."""
    counted = durations.groupBy(*by, "periods").agg(F.sum("times").alias("times"))
    # At most one entry per possible duration.
    histogram = counted.groupBy(*by).agg(
        F.sum("times").alias("n"),
        F.array_sort(F.collect_list(F.struct("periods", "times"))).alias("bins"),
    )

    def ranked(percent: int):
        rank = F.greatest(F.lit(1), F.floor((F.col("n") * percent + 99) / 100))
        step = F.aggregate(
            "bins",
            F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("at")),
            lambda state, b: F.struct(
                (state["seen"] + b["times"]).alias("seen"),
                F.coalesce(
                    state["at"], F.when(state["seen"] + b["times"] >= rank, b["periods"])
                ).alias("at"),
            ),
        )
        return step["at"]

    return histogram.select(
        *by,
        F.col("n").alias("iterations"),
        ranked(50).alias("p50_periods"),
        ranked(85).alias("p85_periods"),
    )
