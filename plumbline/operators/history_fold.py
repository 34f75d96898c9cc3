"""One ordered pass over revision history that gives every item all its milestones at once.

The rows of an item are cut into slices of its order, by default UTC days. Rows meet by
(item, slice), where a sort and one window see each row beside the one before it, and every
slice folds to one row of bounded size. Slices meet by item, where a second window hands
every slice the last row of the slice before, and they fold to one row per item. An item
with any share of all revisions is thus spread over its slices, and the table is read once
and shuffled once, whatever the number of measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline import vocabulary as v
from plumbline.operators.history import ITEM, ORDER
from plumbline.operators.skew import attach, day_slice

_SLICE = [*ITEM, "slice"]
# A team's instants travel with the folds: joining them anew would shuffle those by team.
FRAME = ["commitment_at", "since", "until", "as_of"]


def _first(condition: Column, value: Column) -> Column:
    return F.min(F.when(condition, value))


def _last(condition: Column, value: Column) -> Column:
    return F.max(F.when(condition, value))


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _frame() -> list[Column]:
    return [F.min(name).alias(name) for name in FRAME]


def slice_folds(
    revisions: DataFrame, windows: DataFrame, slice_by: Column | None = None
) -> DataFrame:
    """One row per item and slice: its ends, its inner changes and its states at the cuts.

    ``slice_by`` must not decrease along an item's order. A change at a slice's first row is
    not counted: it depends on the slice before.
    """
    c = F.col
    pieces = slice_by if slice_by is not None else day_slice(c("changed_at"))
    frame = windows.select("team_id", F.col("iteration_path").alias("sprint"), *FRAME)
    rows = attach(revisions, frame, "team_id", "inner").select(
        *ITEM,
        pieces.alias("slice"),
        F.struct(*ORDER).alias("at"),
        c("state_category").alias("category"),
        c("iteration_path").eqNullSafe(c("sprint")).alias("inside"),
        "story_points",
        *FRAME,
    )
    in_order = W.partitionBy(*_SLICE).orderBy("at")
    done = c("category") == v.COMPLETED
    started = c("category") == v.IN_PROGRESS
    before = F.lag(F.struct("category", "inside")).over(in_order)
    seen = rows.withColumn("before", before).withColumn(
        "slice_done", F.max(F.when(done, c("at"))).over(W.partitionBy(*_SLICE))
    )
    moment = c("at.changed_at")
    known = c("before").isNotNull()
    completed = done & known & ~c("before.category").eqNullSafe(F.lit(v.COMPLETED))
    crossed = (
        known & (c("inside") != c("before.inside"))
        & (moment > c("commitment_at")) & (moment <= c("as_of"))
    )
    in_window = moment.between(c("since"), c("until"))
    end = F.struct("at", "category", "inside")
    state = F.struct("at", "category", "inside", "story_points")
    after_done = c("slice_done").isNull() | (c("at") > c("slice_done"))
    return seen.groupBy(*_SLICE).agg(
        F.min(end).alias("first"),
        F.max(end).alias("last"),
        _first(started, c("at")).alias("first_start"),
        _first(done, moment).alias("completed_at"),
        F.max("slice_done").alias("done"),
        _first(started & after_done, c("at")).alias("start_after_done"),
        _count(completed & in_window).alias("completions"),
        _first(completed, F.struct("at", in_window.alias("in_window"))).alias("first_completion"),
        _count(crossed & c("inside")).alias("entered"),
        _count(crossed & ~c("inside")).alias("exited"),
        _last(moment <= c("commitment_at"), state).alias("at_cut"),
        _last(moment <= c("as_of"), state).alias("at_end"),
        *_frame(),
    )


def item_folds(
    revisions: DataFrame, windows: DataFrame, slice_by: Column | None = None
) -> DataFrame:
    """One row per item of the teams in ``windows``.

    ``started_at`` and ``completed_at`` are the first ones. ``recompletions`` counts the
    completions inside the window but the item's first one. ``entered`` and ``exited`` count
    sprint crossings after the commitment, up to as_of. ``at_cut`` and ``at_end`` hold
    category, inside and story_points at the commitment and at as_of, null before the item
    existed. ``category`` is the last one, ``episode_started_at`` the first start after the
    last completion, ``reopened`` whether there was one.
    """
    c = F.col
    in_order = W.partitionBy(*ITEM).orderBy("slice")
    slices = (
        slice_folds(revisions, windows, slice_by)
        .withColumn("before", F.lag("last").over(in_order))
        .withColumn("last_done", F.max("done").over(W.partitionBy(*ITEM)))
    )
    moment = c("first.at.changed_at")
    # What the first row of a slice changes against the last row of the slice before.
    opens = (c("first.category") == v.COMPLETED) & ~c("before.category").eqNullSafe(
        F.lit(v.COMPLETED)
    )
    crosses = (
        (c("first.inside") != F.coalesce("before.inside", F.lit(False)))
        & (moment > c("commitment_at")) & (moment <= c("as_of"))
    )
    in_window = moment.between(c("since"), c("until"))
    opening = F.when(opens, F.struct(c("first.at").alias("at"), in_window.alias("in_window")))
    # The last completion's own slice counts from it on, later slices as a whole.
    start = F.when(
        c("last_done").isNull() | (c("done").isNull() & (c("first.at") > c("last_done"))),
        c("first_start"),
    ).when(c("done") == c("last_done"), c("start_after_done"))
    items = slices.groupBy(*ITEM).agg(
        F.min("first_start").alias("first_start"),
        F.min("completed_at").alias("completed_at"),
        (F.sum("completions") + _count(opens & in_window)).alias("completions"),
        F.min(F.coalesce(opening, "first_completion")).alias("first_completion"),
        (F.sum("entered") + _count(crosses & c("first.inside"))).alias("entered"),
        (F.sum("exited") + _count(crosses & ~c("first.inside"))).alias("exited"),
        F.max("at_cut").alias("at_cut"),
        F.max("at_end").alias("at_end"),
        F.max("last").alias("last"),
        F.min(start).alias("start"),
        F.max("last_done").alias("last_done"),
        *_frame(),
    )
    first_inside = F.when(c("first_completion.in_window"), 1).otherwise(0)
    return items.select(
        *ITEM,
        c("first_start.changed_at").alias("started_at"),
        "completed_at",
        (c("completions") - first_inside).alias("recompletions"),
        "entered",
        "exited",
        "at_cut",
        "at_end",
        c("last.category").alias("category"),
        c("start.changed_at").alias("episode_started_at"),
        c("last_done").isNotNull().alias("reopened"),
        *FRAME,
    )
