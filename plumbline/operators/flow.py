"""Flow out of revision history: throughput, cycle and lead time, ageing, percentiles.

``windows`` has one row per team with since, until and as_of. Cohorts are closed
intervals [since, until]; weeks and days are read in UTC. Gate the revisions with
``usable_revisions`` first: a team without complete history must not appear.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline import vocabulary as v
from plumbline.functions.columns import elapsed_days, week_start
from plumbline.operators.history import ITEM, ORDER, completion_transitions
from plumbline.operators.skew import attach, day_slice


def _in_cohort(moment: str) -> Column:
    return F.col(moment).between(F.col("since"), F.col("until"))


def item_milestones(revisions: DataFrame) -> DataFrame:
    """First start and first completion of every item, in one partial aggregation.

    The first completed row is always a transition, so no ordered pass is needed.
    """
    category = F.col("state_category")
    return revisions.groupBy(*ITEM).agg(
        F.min(F.when(category == v.IN_PROGRESS, F.col("changed_at"))).alias("started_at"),
        F.min(F.when(category == v.COMPLETED, F.col("changed_at"))).alias("completed_at"),
    )


def completed_cohort(revisions: DataFrame, windows: DataFrame) -> DataFrame:
    """Milestones of the items first completed in their team's window.

    Throughput, cycle and lead time all read it; compute it once and pass it to each.
    """
    frame = windows.select("team_id", "since", "until")
    return attach(item_milestones(revisions), frame, "team_id", "inner").where(
        _in_cohort("completed_at")
    )


def throughput_by_week(
    revisions: DataFrame, windows: DataFrame, cohort: DataFrame | None = None
) -> DataFrame:
    """First completions per Monday week of every team in ``windows``, zero weeks kept."""
    if cohort is None:
        cohort = completed_cohort(revisions, windows)
    counts = (
        cohort.groupBy("team_id", week_start(F.col("completed_at")).alias("week"))
        .agg(F.count(F.lit(1)).alias("completed"))
    )
    weeks = F.sequence(
        week_start(F.col("since")), week_start(F.col("until")), F.expr("interval 7 days")
    )
    spine = windows.where("since <= until").select("team_id", F.explode(weeks).alias("week"))
    return spine.join(counts, ["team_id", "week"], "left").select(
        "team_id", "week", F.coalesce("completed", F.lit(0)).alias("completed")
    )


def reopened_completions(revisions: DataFrame, windows: DataFrame) -> DataFrame:
    """Items completed again, after a first completion, inside the window."""
    transitions = attach(
        completion_transitions(revisions),
        windows.select("team_id", "since", "until"),
        "team_id",
        "inner",
    )
    inside = _in_cohort("changed_at")
    per_item = transitions.groupBy(*ITEM).agg(
        F.count(F.when(inside, 1)).alias("inside"),
        F.min(F.struct(F.struct(*ORDER).alias("at"), inside.alias("inside"))).alias("first"),
    )
    again = F.col("inside") - F.when(F.col("first.inside"), 1).otherwise(0)
    return per_item.where(again > 0).select(*ITEM, again.alias("completions"))


def cycle_times(
    revisions: DataFrame, windows: DataFrame, cohort: DataFrame | None = None
) -> DataFrame:
    """First start to first completion in days, for items first completed in the window.

    An item not seen to start before it completed has no days, and the reason.
    """
    if cohort is None:
        cohort = completed_cohort(revisions, windows)
    started = F.col("started_at") <= F.col("completed_at")
    return cohort.select(
        *ITEM,
        "completed_at",
        F.when(started, elapsed_days(F.col("started_at"), F.col("completed_at"))).alias("days"),
        F.when(~F.coalesce(started, F.lit(False)), "no_observed_start").alias("reason"),
    )


def lead_times(
    revisions: DataFrame,
    created: DataFrame,
    windows: DataFrame,
    cohort: DataFrame | None = None,
) -> DataFrame:
    """Creation to first completion in days, for the same cohort.

    ``created`` has one row per (organization, item_id) with created_at.
    """
    if cohort is None:
        cohort = completed_cohort(revisions, windows)
    born = created.select("item_id", "organization", "created_at")
    return cohort.join(born, ["item_id", "organization"], "left").select(
        *ITEM,
        "completed_at",
        elapsed_days(F.col("created_at"), F.col("completed_at")).alias("days"),
        F.when(F.col("created_at").isNull(), "unknown_creation").alias("reason"),
    )


def aging_wip(revisions: DataFrame, windows: DataFrame, only_started: bool = True) -> DataFrame:
    """Age of each open item's current episode at the team's as_of.

    The episode starts at the first start after the last completion. Each item is
    summarised per day first and the days are combined, so a long history never sits in
    one task. The age is missing when no start was seen since.
    """
    category, key = F.col("state_category"), F.struct(*ORDER)
    done = F.when(category == v.COMPLETED, key)
    started = F.when(category == v.IN_PROGRESS, key)
    in_day = W.partitionBy(*ITEM, "day")
    days = (
        revisions.select(
            *ITEM, *ORDER, "state_category", day_slice(F.col("changed_at")).alias("day")
        )
        .withColumn("day_done", F.max(done).over(in_day))
        .groupBy(*ITEM, "day")
        .agg(
            F.max("day_done").alias("done"),
            F.min(started).alias("first_start"),
            F.min(
                F.when(F.col("day_done").isNull() | (started > F.col("day_done")), started)
            ).alias("start_after_done"),
            F.max(F.struct(key.alias("at"), category.alias("category"))).alias("last"),
        )
    )
    done_day = day_slice(F.col("last_done.changed_at"))
    start = F.when(
        F.col("last_done").isNull() | (F.col("day") > done_day), F.col("first_start")
    ).when(F.col("day") == done_day, F.col("start_after_done"))
    items = (
        days.withColumn("last_done", F.max("done").over(W.partitionBy(*ITEM)))
        .groupBy(*ITEM)
        .agg(
            F.min(start).alias("start"),
            F.max("last_done").alias("last_done"),
            F.max("last").alias("last"),
        )
    )
    current = F.col("last.category")
    is_wip = (
        current.eqNullSafe(F.lit(v.IN_PROGRESS))
        if only_started
        else ~F.coalesce(current, F.lit("")).isin(*v.CLOSED)
    )
    started_at = F.col("start.changed_at")
    return attach(items.where(is_wip), windows.select("team_id", "as_of"), "team_id", "inner").select(
        *ITEM,
        started_at.alias("episode_started_at"),
        elapsed_days(started_at, F.col("as_of")).alias("days"),
        (started_at.isNotNull() & F.col("last_done").isNotNull()).alias("reopened"),
        F.when(started_at.isNull(), "unknown_episode_start").alias("reason"),
    )


def nearest_rank_percentile(
    samples: DataFrame, by: Sequence[str], percents: Sequence[int]
) -> DataFrame:
    """Nearest-rank percentiles of ``days`` per group, with the sample size.

    Rows without days are no samples. The aggregation keeps one counter per distinct
    hundredth of a day, so its state is bounded by the range of values, not by the rows.
    """
    ranks = [
        F.expr(f"percentile_disc({p / 100}) within group (order by days)").alias(f"p{p}")
        for p in percents
    ]
    size = F.col("sample_size")
    return (
        samples.groupBy(*by)
        .agg(F.count("days").alias("sample_size"), *ranks)
        .select(
            *by,
            "sample_size",
            *[F.col(f"p{p}") for p in percents],
            ((size > 0) & (size < v.SMALL_SAMPLE)).alias("small_sample"),
            F.when(size == 0, "empty_sample")
            .when(size < v.SMALL_SAMPLE, "small_sample")
            .alias("reason"),
        )
    )
