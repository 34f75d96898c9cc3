"""Revision history: coverage, state at an instant, and completion transitions.

``revisions`` has one row per observed change with team_id, organization, item_id,
revision, changed_at, state_category, iteration_path and story_points. Rows of an item
are ordered by (changed_at, revision).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import vocabulary as v
from plumbline.operators.skew import attach, day_slice, previous_row

ITEM = ["item_id", "organization", "team_id"]
ORDER = ["changed_at", "revision"]


def history_coverage(requested: DataFrame, revisions: DataFrame) -> DataFrame:
    """Per team: items asked for, items with a usable revision, and whether they agree.

    ``intraday`` tells that some item changed twice on one day.
    """
    daily = revisions.groupBy(*ITEM, F.to_date("changed_at").alias("day")).agg(
        F.count(F.lit(1)).alias("changes")
    )
    seen = daily.groupBy(*ITEM).agg(F.max("changes").alias("changes"))
    return (
        requested.select(*ITEM)
        .distinct()
        .join(seen, ITEM, "left")
        .groupBy("team_id")
        .agg(
            F.count(F.lit(1)).alias("requested_items"),
            F.count("changes").alias("items_with_revisions"),
            F.coalesce(F.max(F.col("changes") > 1), F.lit(False)).alias("intraday"),
        )
        .withColumn(
            "is_usable",
            (F.col("requested_items") > 0)
            & (F.col("requested_items") == F.col("items_with_revisions")),
        )
    )


def usable_revisions(revisions: DataFrame, coverage: DataFrame) -> DataFrame:
    """Revisions of the teams whose history is complete; other teams yield nothing."""
    usable = coverage.where("is_usable").select("team_id")
    return attach(revisions, usable, "team_id", "left_semi")


def revision_at(revisions: DataFrame, moments: DataFrame, moment: str) -> DataFrame:
    """The last revision of every item at its team's instant.

    ``moment`` names the instant column of ``moments``. An item without a row did not
    exist then. The maximum is aggregated, so no item's history is sorted.
    """
    kept = [c for c in revisions.columns if c not in ITEM]
    return (
        attach(revisions, moments.select("team_id", moment), "team_id", "inner")
        .where(F.col("changed_at") <= F.col(moment))
        .groupBy(*ITEM)
        .agg(F.max(F.struct(F.struct(*ORDER).alias("at"), F.struct(*kept).alias("row"))).alias("r"))
        .select(*ITEM, "r.row.*")
    )


def first_transition(revisions: DataFrame, category: str) -> DataFrame:
    """Each item's first row in the category."""
    return (
        revisions.where(F.col("state_category") == category)
        .groupBy(*ITEM)
        .agg(F.min(F.struct(*ORDER)).alias("first"))
        .select(*ITEM, "first.*")
    )


def completion_transitions(revisions: DataFrame, slice_by: Column | None = None) -> DataFrame:
    """Rows where an item becomes completed; a first row already completed counts.

    ``slice_by`` cuts an item's history into ordered pieces that are worked on apart
    (the UTC day unless given), so one item may hold any share of all revisions.
    """
    pieces = slice_by if slice_by is not None else day_slice(F.col("changed_at"))
    known = previous_row(
        revisions.select(*ITEM, *ORDER, "state_category"), ITEM, ORDER, ["state_category"], pieces
    )
    done = F.lit(v.COMPLETED)
    return known.where(
        (F.col("state_category") == done)
        & ~F.col("previous_state_category").eqNullSafe(done)
    ).select(*ITEM, *ORDER)
