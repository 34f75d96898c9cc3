"""Items and people seen through several teams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import ratio, text
from plumbline.operators.load import known_load
from plumbline.operators.skew import attach


#: An item's key; the numeric id leads, so that sorting inside an aggregation compares
#: numbers first.
ITEM_KEY = ("item_id", "organization")


def arrivals_state(items: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """First arrival and number of arrivals per item and list of teams it was seen in.

    States of several batches merge into that of all their rows, in whichever order. What
    orders the arrivals stands in ``first.at`` alone, the other columns in ``first.row``.
    """
    held = (*ITEM_KEY, "team_memberships", *arrival)
    payload = F.struct(*[c for c in items.columns if c not in held])
    memberships = F.coalesce("team_memberships", F.array().cast("array<string>"))
    arrived = F.struct(F.struct(*arrival).alias("at"), payload.alias("row"))
    return (
        items.withColumn("team_memberships", memberships)
        .groupBy(*ITEM_KEY, "team_memberships")
        .agg(F.min(arrived).alias("first"), F.count(F.lit(1)).alias("arrivals"))
    )


def merged_state(states: DataFrame) -> DataFrame:
    """One state from the rows of several."""
    return states.groupBy(*ITEM_KEY, "team_memberships").agg(
        F.min("first").alias("first"), F.sum("arrivals").alias("arrivals")
    )


def arrived_items(state: DataFrame) -> DataFrame:
    """The items of a state, or of several in one table, as :func:`deduplicate_items` has them."""
    first = state.schema["first"].dataType
    held = (*ITEM_KEY, "team_memberships", *first["row"].dataType.names)
    ordering = [f"first.at.{c}" for c in first["at"].dataType.names if c not in held]
    # The same list of teams may stand in several states; its first arrival is the least.
    seen = F.array_sort(F.collect_list(F.struct("first.at", "team_memberships")))
    return (
        state.groupBy(*ITEM_KEY)
        .agg(
            F.min("first").alias("first"),
            F.sum("arrivals").alias("arrivals"),
            seen.alias("seen"),
        )
        .withColumn(
            "team_memberships", F.array_distinct(F.flatten(F.col("seen.team_memberships")))
        )
        .select(
            *ITEM_KEY,
            "first.row.*",
            *ordering,
            "team_memberships",
            ((F.col("arrivals") > 1) | (F.size("team_memberships") > 1)).alias("overlapping"),
        )
    )


def deduplicate_items(items: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """One row per (organization, item): the first arrival, with every team it was seen in.

    Memberships keep the order in which they were first seen. ``overlapping`` marks an
    item that arrived more than once or belongs to several teams. A hot item collapses to
    one row per distinct membership before those are collected.
    """
    rows = arrived_items(arrivals_state(items, arrival))
    listed = [c for c in items.columns if c not in (*ITEM_KEY, "team_memberships")]
    return rows.select(*ITEM_KEY, *listed, "team_memberships", "overlapping")


def identity_aliases(people: DataFrame) -> DataFrame:
    """Lower-cased login, display name and "name <login>" of each person, per team.

    The first registration of an alias keeps it; ``people`` carries arrival and position.
    """
    login, name = text(F.col("unique_name")), text(F.col("display_name"))
    both = F.when(
        name.isNotNull() & login.isNotNull(), F.concat(name, F.lit(" <"), login, F.lit(">"))
    )
    aliases = F.array_compact(F.array(*[F.lower(a) for a in (login, name, both)]))
    return (
        people.select("team_id", "person_id", "arrival", "position", F.explode(aliases).alias("alias"))
        .groupBy("team_id", "alias")
        .agg(F.min_by("person_id", F.struct("arrival", "position")).alias("person_id"))
    )


def reconcile_identity(items: DataFrame, people: DataFrame) -> DataFrame:
    """Replace the source's assignee text by the stable person id of the team.

    The login is looked up first, then the display name, then the whole text. What
    matches nobody keeps its text and is marked. Each distinct text is resolved once.
    """
    raw = F.trim("assigned_to")
    angled = F.endswith(raw, F.lit(">")) & F.contains(raw, F.lit("<"))
    # The last "<" splits "name <login>".
    name = F.when(angled, F.regexp_extract(raw, r"(?s)^(.*)<[^<]*>$", 1)).otherwise(raw)
    login = F.when(angled, F.regexp_extract(raw, r"(?s)^.*<([^<]*)>$", 1))
    candidates = F.array(text(login), text(name), raw)
    references = items.where("assigned_to is not null").select("team_id", "assigned_to").distinct()
    resolved = (
        references.select("team_id", "assigned_to", F.posexplode(candidates).alias("at", "alias"))
        .withColumn("alias", F.lower("alias"))
        .join(identity_aliases(people), ["team_id", "alias"])
        .groupBy("team_id", "assigned_to")
        .agg(F.min_by("person_id", "at").alias("person_id"))
    )
    return attach(items, resolved, ["team_id", "assigned_to"]).select(
        *[c for c in items.columns if c != "assigned_to"],
        F.coalesce("person_id", "assigned_to").alias("assigned_to"),
        (F.col("assigned_to").isNull() | F.col("person_id").isNotNull()).alias("reconciled"),
    )


def merge_people(people: DataFrame, items: DataFrame) -> DataFrame:
    """People known from capacity, and assignees that are not among them."""
    key = ["team_id", "person_id"]
    known = people.select(*key, "display_name", "unique_name").dropDuplicates(key)
    none = F.lit(None).cast("string")
    assigned = (
        items.where("assigned_to is not null")
        .select("team_id", F.col("assigned_to").alias("person_id"))
        .distinct()
        .join(known, key, "left_anti")
        .select(*key, none.alias("display_name"), none.alias("unique_name"))
    )
    return known.unionByName(assigned)


def over_reserved(reserved: str = "reserved_total", available: str = "availability"):
    """Reservations above the declared availability; unknown on either side is not over."""
    return F.coalesce(F.col(reserved) > F.col(available), F.lit(False))


def consolidate_person(
    people: DataFrame,
    reservations: DataFrame,
    factors: DataFrame,
    accountable: DataFrame,
    availability: DataFrame,
    unit: str,
) -> DataFrame:
    """Reservations, load and declared availability of each person over all teams.

    ``people`` is (team_id, person_id) for every observed pair, ``factors`` the day
    factors of those pairs, ``accountable`` the deduplicated items on one level and
    ``availability`` the declared (person_id, per_day, availability_unit). A team that
    reserves in another unit is left out and counted. Availability uses the union of the
    teams' days, each at its largest factor, and is never inferred.
    """
    days = factors.groupBy("team_id", "person_id").agg(
        F.sum("factor").cast("decimal(12,4)").alias("days")
    )
    zero_days = F.lit(0).cast("decimal(12,4)")
    per_team = (
        reservations.groupBy("team_id", "person_id")
        .agg(
            F.when(F.count(F.lit(1)) == F.count("per_day"), F.sum("per_day"))
            .cast("decimal(18,4)")
            .alias("per_day"),
            (F.count(F.when(F.col("unit") != unit, 1)) == 0).alias("comparable"),
        )
        .join(days, ["team_id", "person_id"], "left")
        .withColumn(
            "reserved",
            F.when(
                F.col("comparable"), F.col("per_day") * F.coalesce("days", zero_days)
            ).cast("decimal(38,8)"),
        )
        .select("team_id", "person_id", "reserved", "comparable")
    )
    observed = (
        people.select("team_id", "person_id")
        .distinct()
        .join(per_team, ["team_id", "person_id"], "left")
        .groupBy("person_id")
        .agg(
            F.count(F.lit(1)).alias("observed_teams"),
            F.count(F.when(F.col("comparable"), 1)).alias("reserving_teams"),
            F.count(F.when(~F.col("comparable"), 1)).alias("other_unit_teams"),
            F.sum("reserved").cast("decimal(38,8)").alias("reserved_total"),
        )
    )
    union_days = (
        factors.groupBy("person_id", "day")
        .agg(F.max("factor").alias("factor"))
        .groupBy("person_id")
        .agg(F.sum("factor").cast("decimal(12,4)").alias("available_days"))
    )
    overlapping = F.count(F.when(F.col("overlapping"), 1)).alias("overlapping_items")
    loads = known_load(accountable, None, ["assigned_to"], unit, overlapping).select(
        F.col("assigned_to").alias("person_id"),
        "load_value", "eligible", "known", "missing", "overlapping_items",
    )
    comparable = F.col("availability_unit") == unit
    declared = F.when(
        comparable,
        F.col("per_day").cast("decimal(18,4)") * F.coalesce("available_days", zero_days),
    ).cast("decimal(38,8)")
    zero = F.lit(0).cast("bigint")
    wide = (
        observed.join(loads, "person_id", "left")
        .join(availability, "person_id", "left")
        .join(union_days, "person_id", "left")
        .withColumn("availability", declared)
        .withColumns(
            {c: F.coalesce(c, zero) for c in ("eligible", "known", "missing", "overlapping_items")}
        )
    )
    reason = (
        F.when(F.col("availability_unit").isNull(), "availability_not_declared")
        .when(~comparable, "unit_mismatch")
        .when(F.col("load_value").isNull(), "no_known_work")
        .when(F.col("availability") == 0, "zero_availability")
        .when(F.col("known") != F.col("eligible"), "partial_ratio")
    )
    return wide.select(
        "person_id",
        "observed_teams",
        "reserving_teams",
        "other_unit_teams",
        "reserved_total",
        "availability",
        "load_value",
        "eligible",
        "known",
        "missing",
        "overlapping_items",
        ratio(F.col("load_value"), F.col("availability")).alias("utilization"),
        over_reserved().alias("over_reserved"),
        reason.alias("reason"),
    )
