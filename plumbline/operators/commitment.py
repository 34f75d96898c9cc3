"""Commitment, scope change and carry-over out of revision history.

``windows`` has one row per team with iteration_path, commitment_at and as_of. Gate the
revisions with ``usable_revisions`` first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import vocabulary as v
from plumbline.functions.columns import ratio
from plumbline.operators.history import ITEM, ORDER, revision_at
from plumbline.operators.skew import attach, day_slice, previous_row


def build_baseline(
    revisions: DataFrame,
    windows: DataFrame,
    item_types: DataFrame | None = None,
    committed_types: Sequence[str] = (),
) -> DataFrame:
    """Items in the sprint and not closed at the commitment instant, points frozen.

    A state without a category stays in. With ``committed_types``, only items whose type
    (organization, item_id, item_type) is one of them.
    """
    at_cut = revision_at(revisions, windows, "commitment_at")
    scoped = attach(
        at_cut, windows.select("team_id", F.col("iteration_path").alias("sprint")), "team_id", "inner"
    ).where(
        (F.col("iteration_path") == F.col("sprint"))
        & ~F.coalesce("state_category", F.lit("")).isin(*v.CLOSED)
    )
    if committed_types and item_types is not None:
        typed = item_types.where(F.col("item_type").isin(*committed_types))
        scoped = scoped.join(
            typed.select("item_id", "organization").distinct(),
            ["item_id", "organization"],
            "left_semi",
        )
    return scoped.select(*ITEM, "story_points", "state_category", "iteration_path")


def scope_changes(
    revisions: DataFrame, windows: DataFrame, slice_by: Column | None = None
) -> DataFrame:
    """Items entering and leaving the sprint after the commitment, up to as_of.

    The row before an item's first row after the cut is its state at the cut, so
    comparing each row with the one before it is enough.
    """
    pieces = slice_by if slice_by is not None else day_slice(F.col("changed_at"))
    frame = windows.select(
        "team_id", F.col("iteration_path").alias("sprint"), "commitment_at", "as_of"
    )
    marked = (
        attach(revisions, frame, "team_id", "inner")
        .where("changed_at <= as_of")
        .select(
            *ITEM,
            *ORDER,
            "commitment_at",
            F.col("iteration_path").eqNullSafe(F.col("sprint")).alias("inside"),
            "iteration_path",
        )
    )
    compared = previous_row(marked, ITEM, ORDER, ["inside"], pieces)
    before = F.coalesce("previous_inside", F.lit(False))
    direction = F.when(F.col("inside") & ~before, "entered").when(
        ~F.col("inside") & before, "exited"
    )
    return (
        compared.where("changed_at > commitment_at")
        .select(*ITEM, *ORDER, "iteration_path", direction.alias("direction"))
        .where("direction is not null")
    )


def scope_round_trips(changes: DataFrame) -> DataFrame:
    """Items that both entered and left."""
    entered = changes.where("direction = 'entered'").select(*ITEM)
    exited = changes.where("direction = 'exited'").select(*ITEM)
    return entered.intersect(exited)


def baseline_outcomes(
    baseline: DataFrame, revisions: DataFrame, windows: DataFrame
) -> DataFrame:
    """Each baseline item beside its state and points at as_of."""
    final = revision_at(revisions, windows, "as_of").select(
        *ITEM,
        F.col("state_category").alias("final_category"),
        F.col("story_points").alias("final_points"),
    )
    frozen = F.col("story_points")
    return baseline.join(final, ITEM, "left").select(
        *ITEM,
        frozen.alias("committed_points"),
        F.col("final_points").alias("current_points"),
        F.coalesce(F.col("final_category") == v.COMPLETED, F.lit(False)).alias("completed"),
        F.coalesce(F.col("final_points") != frozen, F.lit(False)).alias("points_changed"),
    )


def _share(windows: DataFrame, outcomes: DataFrame, counted: Column) -> DataFrame:
    per_team = outcomes.groupBy("team_id").agg(
        F.count(F.when(counted, 1)).alias("numerator"), F.count(F.lit(1)).alias("denominator")
    )
    zero = F.lit(0).cast("bigint")
    return windows.select("team_id").join(per_team, "team_id", "left").select(
        "team_id",
        F.coalesce("numerator", zero).alias("numerator"),
        F.coalesce("denominator", zero).alias("denominator"),
        ratio(F.col("numerator"), F.col("denominator")).alias("value"),
        F.when(F.col("denominator").isNull(), "no_baseline").alias("reason"),
    )


def say_do(windows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Baseline items completed at as_of, over the baseline."""
    return _share(windows, outcomes, F.col("completed"))


def carry_over(windows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Baseline items not completed at as_of, over the baseline."""
    return _share(windows, outcomes, ~F.col("completed"))


def committed_points(outcomes: DataFrame) -> DataFrame:
    """Points frozen at the cut and points now, per team.

    Both are missing when no baseline item had points. ``current`` includes items that
    had none at the cut. The re-estimated items themselves are :func:`repointed_items`.
    """
    has_points = F.count("committed_points") > 0
    none = F.lit(0).cast("decimal(28,4)")
    return outcomes.groupBy("team_id").agg(
        F.sum("committed_points").cast("decimal(28,4)").alias("committed"),
        F.when(has_points, F.coalesce(F.sum("current_points"), none))
        .cast("decimal(28,4)")
        .alias("current"),
        F.count(F.when(F.col("points_changed"), 1)).alias("changed_items"),
        (F.count(F.lit(1)) - F.count("committed_points")).alias("items_without_points"),
    )


def repointed_items(outcomes: DataFrame) -> DataFrame:
    """Baseline items whose points changed after the cut."""
    return outcomes.where("points_changed").select(*ITEM, "committed_points", "current_points")
