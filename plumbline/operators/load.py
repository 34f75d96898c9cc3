"""Known open work: what counts, how much of it is known, and how it compares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import vocabulary as v
from plumbline.functions.columns import codes, is_open, ratio
from plumbline.operators.skew import attach


def accountable_items(items: DataFrame, relations: DataFrame, settings: DataFrame) -> DataFrame:
    """One accounting level per team, so a parent and its child never add up.

    ``leaf_task`` leaves out every item that is a hierarchy parent, ``requirement``
    every hierarchy child; other levels keep all. An edge counts even when its other
    end is not among the items.
    """
    edges = relations.where(F.col("relation") == v.HIERARCHY)
    yes, no = F.lit(True), F.lit(False)
    ends = (
        edges.select(
            "organization",
            F.inline(
                F.array(
                    F.struct(F.col("parent_id").alias("item_id"), yes.alias("p"), no.alias("c")),
                    F.struct(F.col("child_id").alias("item_id"), no.alias("p"), yes.alias("c")),
                )
            ),
        )
        .groupBy("item_id", "organization")
        .agg(F.max("p").alias("is_parent"), F.max("c").alias("is_child"))
    )
    levels = settings.select("team_id", "accounting_level")
    other_level = F.when(F.col("accounting_level") == v.LEAF_TASK, F.col("is_parent")).when(
        F.col("accounting_level") == v.REQUIREMENT, F.col("is_child")
    )
    return (
        attach(items, levels, "team_id")
        .join(ends, ["item_id", "organization"], "left")
        .where(~F.coalesce(other_level, no))
        .select(*items.columns)
    )


def open_items(accountable: DataFrame) -> DataFrame:
    """Accountable items in a known category that is not a closed one."""
    return accountable.where(is_open(F.col("state_category")))


class _LoadCase:
    """Where an accountable item falls when load is summed."""

    def __init__(self, unit: Column):
        category, value = F.col("state_category"), F.col("remaining")
        self.unmapped = category.isNull()
        self.closed_with_work = F.coalesce(category.isin(*v.CLOSED), F.lit(False)) & (
            F.coalesce(value, F.lit(0)) > 0
        )
        self.open = is_open(category)
        self.missing = self.open & value.isNull()
        other_unit = ~F.col("remaining_unit").eqNullSafe(unit)
        self.other_unit = self.open & value.isNotNull() & other_unit
        self.negative = self.open & value.isNotNull() & ~other_unit & (value < 0)
        self.known = self.open & value.isNotNull() & ~other_unit & (value >= 0)


def known_load(
    accountable: DataFrame,
    settings: DataFrame | None,
    by: Sequence[str],
    unit: str | None = None,
    *more: Column,
) -> DataFrame:
    """Sum of valid remaining work of open items, with what had to be left out.

    ``accountable`` already sits on one accounting level; ``by`` is the grain, e.g.
    team or team and person. The unit is each team's own, or ``unit`` for all. Missing work never becomes zero: without a single known
    item the value is missing. ``more`` are aggregates of the same items out of the same pass.
    """
    if unit is not None:
        measured = accountable.withColumn("unit", F.lit(unit))
    else:
        measured = attach(accountable, settings.select("team_id", "unit"), "team_id", "inner")
    return measured.groupBy(*by, F.col("unit").alias("load_unit")).agg(*_load_tallies(), *more)


def _load_tallies() -> list[Column]:
    case = _LoadCase(F.col("unit"))

    def tally(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    return [
        F.sum(F.when(case.known, F.col("remaining"))).cast("decimal(28,4)").alias("load_value"),
        tally(case.open).alias("eligible"),
        tally(case.known).alias("known"),
        tally(case.missing).alias("missing"),
        tally(case.other_unit | case.negative).alias("invalid"),
        tally(case.unmapped | case.closed_with_work).alias("excluded"),
    ]


def load_findings(accountable: DataFrame, settings: DataFrame) -> DataFrame:
    """One finding per accountable item whose state or work contradicts the load."""
    case = _LoadCase(F.col("unit"))
    rules = codes(
        [
            (case.unmapped, "unmapped_state"),
            (case.closed_with_work, "completed_with_remaining_work"),
            (case.negative, "negative_remaining_work"),
        ]
    )
    return (
        attach(accountable, settings.select("team_id", "unit"), "team_id", "inner")
        .select("team_id", "organization", "item_id", F.explode(rules).alias("rule_id"))
        .select(
            "team_id",
            "organization",
            "item_id",
            F.concat_ws(":", "rule_id", "item_id").alias("finding_id"),
            "rule_id",
            F.lit("attention").alias("severity"),
        )
    )


def classify_load(compared: DataFrame) -> DataFrame:
    """Load class, ratio, lower-bound flag and reason for each load and capacity pair.

    Expects load_value, load_unit, eligible, known, capacity_value, capacity_unit (missing
    when there is no capacity at all) and the thresholds below, within, attention. Class
    boundaries are compared by multiplication, so no rounded ratio decides a class.
    """
    load, capacity = F.col("load_value"), F.col("capacity_value")
    complete = F.col("known") == F.col("eligible")
    exact = "decimal(24,8)"
    direction = F.when(capacity < 0, F.lit(-1)).otherwise(F.lit(1))
    # ratio < t is load < t * capacity, with both sides turned for a negative capacity.
    side = (load * direction).cast(exact)

    def limit(name: str) -> Column:
        return F.abs(capacity).cast(exact) * F.col(name).cast("decimal(9,4)")

    above = side > limit("attention")

    # First condition that holds decides: (condition, class, has ratio, lower bound, reason).
    no, yes = F.lit(False), F.lit(True)
    ladder: list[tuple[Column, str, bool, Column, str | None]] = [
        (
            F.col("capacity_unit").isNotNull() & (F.col("capacity_unit") != F.col("load_unit")),
            v.INSUFFICIENT_DATA, False, no, "unit_mismatch",
        ),
        (capacity.isNull(), v.INSUFFICIENT_DATA, False,
         F.coalesce(load > 0, no), "capacity_unknown"),
        (load.isNull() & (F.col("eligible") == 0), v.NO_RECORDED_LOAD, False, no, "no_open_item"),
        (load.isNull(), v.INSUFFICIENT_DATA, False, no, "no_known_work"),
        ((capacity == 0) & (load == 0), v.NO_RECORDED_LOAD, False, no, "zero_load_and_capacity"),
        (capacity == 0, v.LOAD_WITHOUT_CAPACITY, False, ~complete, "load_without_capacity"),
        (~complete & above, v.ABOVE, True, yes, "partial_ratio"),
        (~complete, v.INSUFFICIENT_DATA, True, yes, "partial_ratio"),
        (load == 0, v.NO_RECORDED_LOAD, True, no, "zero_load"),
        (side < limit("below"), v.BELOW, True, no, None),
        (side <= limit("within"), v.WITHIN, True, no, None),
        (side <= limit("attention"), v.ATTENTION, True, no, None),
        (yes, v.ABOVE, True, no, None),
    ]

    def pick(values: list[Column]) -> Column:
        chosen = F.when(ladder[0][0], values[0])
        for (condition, *_), value in zip(ladder[1:], values[1:], strict=True):
            chosen = chosen.when(condition, value)
        return chosen

    divided = ratio(load, capacity)
    return compared.select(
        "*",
        pick([F.lit(step[1]) for step in ladder]).alias("load_class"),
        pick([divided if step[2] else F.lit(None) for step in ladder]).alias("ratio"),
        pick([step[3] for step in ladder]).alias("is_lower_bound"),
        pick([F.lit(step[4]) for step in ladder]).alias("reason"),
    )


_THRESHOLDS = ("below", "within", "attention")


def person_load(
    people: DataFrame,
    accountable: DataFrame,
    settings: DataFrame,
    capacities: DataFrame,
) -> DataFrame:
    """Load against capacity for every known person, plus one row for unassigned work.

    Assignees stand in for the people of a team that has none.

    A person without items still has a row. Unassigned items get a row only when some
    of them are open, and never a capacity. ``accountable`` was reduced with the whole
    team's hierarchy before it is split by person.
    """
    team = settings.select("team_id", "unit", *_THRESHOLDS)
    loads = (
        known_load(accountable, settings, ["team_id", "assigned_to"])
        .withColumn("person_id", F.coalesce("assigned_to", F.lit(v.UNASSIGNED_PERSON)))
        .drop("load_unit", "assigned_to")
    )
    known_people = people.select("team_id", "person_id", "display_name")
    # A team without known people lists the assignees of its work.
    assignees = (
        accountable.where("assigned_to is not null")
        .select("team_id", F.col("assigned_to").alias("person_id"))
        .distinct()
        .join(people.select("team_id").distinct(), "team_id", "left_anti")
        .withColumn("display_name", F.lit(None).cast("string"))
    )
    named = known_people.unionByName(assignees)
    roster = named.unionByName(
        settings.select(
            "team_id",
            F.lit(v.UNASSIGNED_PERSON).alias("person_id"),
            F.lit(None).cast("string").alias("display_name"),
        )
    )
    zero = F.lit(0).cast("bigint")
    compared = (
        attach(roster, team, "team_id", "inner")
        .withColumnRenamed("unit", "load_unit")
        .join(loads, ["team_id", "person_id"], "left")
        .join(
            capacities.withColumnRenamed("capacity_unit", "load_unit"),
            ["team_id", "person_id", "load_unit"],
            "left",
        )
        .withColumns(
            {
                "capacity_unit": F.when(F.col("capacity_value").isNotNull(), F.col("load_unit")),
                **{c: F.coalesce(c, zero) for c in ("eligible", "known", "missing")},
            }
        )
    )
    nobody = F.col("person_id") == v.UNASSIGNED_PERSON
    return (
        classify_load(compared)
        .where(~nobody | (F.col("eligible") > 0))
        .select(
            "team_id",
            "person_id",
            "display_name",
            "load_value",
            "load_unit",
            F.when(~nobody, F.col("capacity_value")).alias("capacity_value"),
            F.when(~nobody, F.col("ratio")).alias("ratio"),
            F.when(nobody, v.UNASSIGNED).otherwise(F.col("load_class")).alias("load_class"),
            (~nobody & F.col("is_lower_bound")).alias("is_lower_bound"),
            "eligible",
            "known",
            "missing",
            F.when(nobody, "no_assignee").otherwise(F.col("reason")).alias("reason"),
        )
    )


def item_counts(accountable: DataFrame) -> DataFrame:
    """Per team, the counters behind the open and blocked item counts.

    Blocked covers every accountable item, closed ones included; an item whose
    blocked state is unknown is missing, not unblocked.
    """
    return accountable.groupBy("team_id").agg(*_count_tallies())


def _count_tallies() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("accountable"),
        F.count(F.when(is_open(F.col("state_category")), 1)).alias("open"),
        F.count("blocked").alias("blocked_known"),
        F.count(F.when(F.col("blocked"), 1)).alias("blocked"),
    ]


def team_tallies(accountable: DataFrame, settings: DataFrame) -> DataFrame:
    """Load and item counters of every team out of one pass over the items."""
    return (
        attach(accountable, settings.select("team_id", "unit"), "team_id", "inner")
        .groupBy("team_id")
        .agg(*_load_tallies(), *_count_tallies())
    )


def open_items_count(accountable: DataFrame) -> DataFrame:
    """Open accountable items; every accountable item is both eligible and known."""
    return item_counts(accountable).select(
        "team_id",
        F.col("open").alias("value"),
        F.col("accountable").alias("eligible"),
        F.col("accountable").alias("known"),
    )


def blocked_items_count(accountable: DataFrame) -> DataFrame:
    """Blocked accountable items and how many have no blocked state."""
    return item_counts(accountable).select(
        "team_id",
        F.col("blocked").alias("value"),
        F.col("accountable").alias("eligible"),
        F.col("blocked_known").alias("known"),
        (F.col("accountable") - F.col("blocked_known")).alias("missing"),
    )
