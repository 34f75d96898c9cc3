"""The history part of a team report: commitment and flow side by side, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import vocabulary as v
from plumbline.functions.columns import elapsed_days, ratio, week_start
from plumbline.operators.history import ITEM
from plumbline.operators.history_fold import item_folds


def _percentile(days: str, percent: int) -> Column:
    return F.expr(f"percentile_disc({percent / 100}) within group (order by {days})")


def item_measures(
    revisions: DataFrame, requested: DataFrame, windows: DataFrame, slice_by: Column | None = None
) -> DataFrame:
    """One row per item seen or asked for, with what it adds to its team's block.

    ``requested`` has the items whose history was asked for and their created_at, null where
    it is unknown; rows that repeat an item count once.
    """
    c = F.col
    asked = requested.groupBy(*ITEM).agg(F.min("created_at").alias("created_at")).withColumn(
        "requested", F.lit(True)
    )
    seen = item_folds(revisions, windows, slice_by).withColumn("seen", F.lit(True))
    items = seen.join(asked, ITEM, "full")
    committed = c("at_cut.inside") & ~F.coalesce("at_cut.category", F.lit("")).isin(*v.CLOSED)
    completed = c("completed_at").between(c("since"), c("until"))
    cycle = elapsed_days(c("started_at"), c("completed_at"))
    ageing = c("category").eqNullSafe(F.lit(v.IN_PROGRESS))
    frozen, final = c("at_cut.story_points"), c("at_end.story_points")
    return items.select(
        *ITEM,
        F.coalesce("requested", F.lit(False)).alias("requested"),
        F.coalesce("seen", F.lit(False)).alias("seen"),
        F.coalesce(committed, F.lit(False)).alias("committed"),
        (c("at_end.category") == v.COMPLETED).alias("delivered"),
        frozen.alias("committed_points"),
        final.alias("current_points"),
        (final != frozen).alias("repointed"),
        "entered",
        "exited",
        (c("recompletions") > 0).alias("reopened"),
        F.coalesce(completed, F.lit(False)).alias("completed"),
        F.when(completed & (c("started_at") <= c("completed_at")), cycle).alias("cycle_days"),
        F.when(completed, elapsed_days(c("created_at"), c("completed_at"))).alias("lead_days"),
        ageing.alias("ageing"),
        F.when(ageing, elapsed_days(c("episode_started_at"), c("as_of"))).alias("age_days"),
    )


def history_block(
    revisions: DataFrame, requested: DataFrame, windows: DataFrame, slice_by: Column | None = None
) -> DataFrame:
    """One row per team; unavailable without complete history or without a sprint.

    A team's history is complete if every item asked for was seen. Item lists are not packed
    into the row. They are the tables of ``scope_changes``, ``scope_round_trips``,
    ``repointed_items``, ``reopened_completions`` and ``aging_wip``; the row has their counts.
    The revisions are read once: see :mod:`plumbline.operators.history_fold`.
    """
    c = F.col
    sprints = windows.where("iteration_path is not null")

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    committed = c("committed")
    amount = "decimal(28,4)"
    has_points = F.count(F.when(committed, c("committed_points"))) > 0
    current = F.sum(F.when(committed, c("current_points")))
    cycle_size, lead_size = F.count("cycle_days"), F.count("lead_days")
    teams = item_measures(revisions, requested, sprints, slice_by).groupBy("team_id").agg(
        (count(c("requested")) > 0).alias("asked"),
        (count(c("requested") & ~c("seen")) == 0).alias("complete"),
        count(committed).alias("baseline_size"),
        count(committed & c("delivered")).alias("say_do_numerator"),
        F.sum(F.when(committed, c("committed_points"))).cast(amount).alias("committed_points"),
        F.when(has_points, F.coalesce(current, F.lit(0).cast(amount)))
        .cast(amount)
        .alias("current_points"),
        count(committed & c("repointed")).alias("changed_items"),
        F.coalesce(F.sum("entered"), F.lit(0)).alias("scope_entered"),
        F.coalesce(F.sum("exited"), F.lit(0)).alias("scope_exited"),
        count((c("entered") > 0) & (c("exited") > 0)).alias("scope_round_trips"),
        count(c("completed")).alias("completed"),
        count(c("reopened")).alias("reopened_items"),
        _percentile("cycle_days", 50).alias("cycle_time_p50"),
        _percentile("cycle_days", 85).alias("cycle_time_p85"),
        cycle_size.alias("cycle_time_sample"),
        _percentile("lead_days", 50).alias("lead_time_p50"),
        lead_size.alias("lead_time_sample"),
        (cycle_size.between(1, v.SMALL_SAMPLE - 1) | lead_size.between(1, v.SMALL_SAMPLE - 1))
        .alias("small_sample"),
        F.max("age_days").alias("oldest_aging_days"),
        (count(c("ageing")) - F.count("age_days")).alias("aging_unknown"),
    )
    size = c("baseline_size")
    ordered = c("since") <= c("until")
    weeks = F.sequence(week_start(c("since")), week_start(c("until")), F.expr("interval 7 days"))
    stated = teams.where("asked and complete").join(
        sprints.select("team_id", "since", "until"), "team_id"
    ).select(
        F.lit(True).alias("available"),
        "team_id",
        "baseline_size",
        ratio(c("say_do_numerator"), size).alias("say_do"),
        "say_do_numerator",
        ratio(size - c("say_do_numerator"), size).alias("carry_over"),
        *("committed_points", "current_points", "changed_items"),
        *("scope_entered", "scope_exited", "scope_round_trips"),
        F.when(ordered, c("completed")).alias("throughput"),
        F.when(ordered, F.size(weeks).cast("bigint")).alias("weeks"),
        "reopened_items",
        *("cycle_time_p50", "cycle_time_p85", "cycle_time_sample"),
        *("lead_time_p50", "lead_time_sample"),
        "small_sample",
        *("oldest_aging_days", "aging_unknown"),
    )
    return (
        windows.select("team_id")
        .join(stated, "team_id", "left")
        .withColumn("available", F.coalesce("available", F.lit(False)))
        .withColumn("reason", F.when(~c("available"), "history_unavailable"))
    )
