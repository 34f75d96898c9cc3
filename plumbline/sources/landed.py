"""Landed JSON payloads to typed tables.

A payload table has one JSON text per row in ``payload`` beside its context (team_id,
organization, arrival ...). Records are read on demand: an absent field stays absent,
and nothing is guessed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import vocabulary as v
from plumbline.functions.columns import codes, day, instant
from plumbline.functions.json import (
    as_id,
    as_label,
    as_list,
    as_object,
    as_quantity,
    as_text,
    fields_of,
    first_of,
    member,
    pick,
    picked,
)
from plumbline.operators.skew import attach

# Keys under which a payload may hold its records.
RECORD_KEYS = ("value", "items", "workItems", "teamMembers", "teamCapacities", "capacities")


def read_landed_payloads(
    spark: SparkSession, path: str, whole_files: bool = False, context: Sequence[str] = ()
) -> DataFrame:
    """Landed files as payloads: one per line, or one per file, with the file as ``source``.

    ``context`` names what the folders below ``path`` say of a payload (``team_id=7/...``);
    it is read as text, so an id keeps its leading zeros. Blank lines and files are none.
    Payloads come as they are: see :func:`malformed_payloads`.
    """
    folders = "".join(f", `{name}` string" for name in context)
    text = spark.read.schema(f"value string{folders}").text(path, wholetext=whole_files)
    return text.where(F.trim("value") != "").select(
        *context, F.col("value").alias("payload"), F.col("_metadata.file_path").alias("source")
    )


def malformed_payloads(payloads: DataFrame) -> DataFrame:
    """The payloads that hold no record source, with the ``reason``: nothing is dropped unseen.

    ``not_json`` does not parse as a whole, as a line that was cut off; ``no_records`` is a
    lone number, text or null. What follows a whole document is not looked at.
    """
    holds = F.substring(F.ltrim("payload"), 1, 1).isin("{", "[")
    reason = F.when(F.try_parse_json("payload").isNull(), "not_json").when(~holds, "no_records")
    return payloads.withColumn("reason", reason).where("reason is not null")


def well_formed_payloads(payloads: DataFrame) -> DataFrame:
    """The payloads that parse as a whole; the others are :func:`malformed_payloads`."""
    return payloads.where(F.try_parse_json("payload").isNotNull())


def payload_records(payloads: DataFrame, *keys: str) -> DataFrame:
    """One row per record of each payload, as ``record`` with its ``position``.

    Records are the payload itself when it is a list, else the first listed key that
    holds a list, else the lone object. What is not an object is dropped.
    """
    listed = [as_list(member(F.col("__root"), key)) for key in (*keys, *RECORD_KEYS)]
    records = F.coalesce(
        as_list(F.col("payload")),
        *listed,
        F.when(F.col("__root").isNotNull(), F.array("payload")),
    )
    context = [c for c in payloads.columns if c != "payload"]
    return (
        payloads.withColumn("__root", as_object(F.col("payload")))
        .select(*context, F.posexplode(records).alias("position", "__record"))
        .where(F.startswith(F.ltrim("__record"), F.lit("{")))
        # Exploded, a record is parsed once: what callers filter by is not pushed below that.
        .select(*context, "position", F.explode(F.array(as_object(F.col("__record")))).alias("record"))
    )


def _kept(value: Column) -> Column:
    """The value, without the rows that have none.

    A filter would be pushed below the column's expression and parse each record again.
    """
    return F.explode(F.array_compact(F.array(value)))


def map_state_category(items: DataFrame, state_map: DataFrame) -> DataFrame:
    """Add state_category by (team_id, state); an unmapped state has none, and a reason.

    The label of a missing state is no state: it is neither mapped nor given a reason.
    """
    known = state_map.where(F.col("state") != v.UNKNOWN_LABEL)
    mapped = attach(
        items, known.select("team_id", "state", "state_category"), ["team_id", "state"]
    )
    stated = ~F.coalesce("state", F.lit("")).isin("", v.UNKNOWN_LABEL)
    unmapped = F.col("state_category").isNull() & stated
    return mapped.withColumn("state_reason", F.when(unmapped, "unmapped_state"))


def blocked_flag(state: Column, tags: Column, blocked_states: Column, source: Column) -> Column:
    """Blocked by state when states are listed, else by tag, else unknown.

    With a tag configured, an item without tags is known not to be blocked.
    """
    by_tag = F.contains(
        F.lower(F.coalesce(tags, F.lit(""))), F.lower(F.substr(source, F.lit(5)))
    )
    return F.when(
        F.size(F.coalesce(blocked_states, F.array())) > 0,
        F.coalesce(F.array_contains(blocked_states, F.coalesce(state, F.lit(""))), F.lit(False)),
    ).when(F.startswith(source, F.lit("tag:")), by_tag)


def derive_blocked(items: DataFrame, settings: DataFrame) -> DataFrame:
    """Add blocked from the team's listed states or impediment tag."""
    team = settings.select("team_id", "blocked_states", "impediment_source")
    flag = blocked_flag(
        F.col("state"), F.col("tags"), F.col("blocked_states"), F.col("impediment_source")
    )
    return attach(items, team, "team_id").withColumn("blocked", flag).drop(
        "blocked_states", "impediment_source"
    )


def normalize_work_items(payloads: DataFrame, settings: DataFrame) -> DataFrame:
    """Work items out of payloads with team_id, organization and arrival.

    Records without an id are dropped. Quantities carry the team's unit; quantity field
    names are the team's. ``assigned_to`` is the text of the source, still unresolved,
    and ``parent_id`` the parent the record names.
    """
    team = settings.select(
        "team_id",
        "unit",
        "remaining_field",
        "original_estimate_field",
        "completed_work_field",
        "story_points_field",
        "blocked_states",
        "impediment_source",
        F.array_contains("capabilities", F.lit("allocation")).alias("allocates"),
    )
    rows = attach(payload_records(payloads, "workItems"), team, "team_id", "inner").withColumn(
        "fields", fields_of(F.col("record"))
    )
    labels = {
        "type": ("System.WorkItemType", "workItemType"),
        "state": ("System.State", "state"),
        "title": ("System.Title", "title"),
        "assigned_to": ("System.AssignedTo", "assignedTo"),
        "area_path": ("System.AreaPath", "areaPath"),
        "iteration_path": ("System.IterationPath", "iterationPath"),
        "activity": ("Microsoft.VSTS.Common.Activity", "activity"),
        "tags": ("System.Tags", "tags"),
    }
    record, fields = F.col("record"), F.col("fields")
    targets = [f"Microsoft.VSTS.Scheduling.{n}" for n in ("TargetDate", "FinishDate", "DueDate")]
    raw = pick(rows, **labels).withColumns(
        {
            **{
                f"raw_{name}": member(fields, F.col(f"{name}_field"))
                for name in ("remaining", "original_estimate", "completed_work", "story_points")
            },
            **{f"raw_target_{i}": member(fields, n) for i, n in enumerate(targets)},
            **{f"raw_id_{i}": member(record, n) for i, n in enumerate(("id", "workItemId", "Id"))},
            "raw_start": member(fields, "Microsoft.VSTS.Scheduling.StartDate"),
            "raw_created": member(fields, "System.CreatedDate"),
            "raw_changed": member(fields, "System.ChangedDate"),
            "raw_parent": member(fields, "System.Parent"),
            "raw_other_parent": member(record, "parentId"),
        }
    )
    texts = raw.select(
        "organization",
        "team_id",
        "arrival",
        "position",
        "unit",
        "allocates",
        "remaining_field",
        "blocked_states",
        "impediment_source",
        picked(as_id, "raw_id", 3).alias("item_id"),
        *[picked(as_label, alias, 2).alias(alias) for alias in labels],
        as_quantity(F.col("raw_remaining")).alias("remaining"),
        as_quantity(F.col("raw_original_estimate")).alias("original_estimate"),
        as_quantity(F.col("raw_completed_work")).alias("completed_work"),
        as_quantity(F.col("raw_story_points")).alias("story_points"),
        as_text(F.col("raw_start")).alias("start_text"),
        F.coalesce(*[as_text(F.col(f"raw_target_{i}")) for i in range(3)]).alias("target_text"),
        as_text(F.col("raw_created")).alias("created_text"),
        as_text(F.col("raw_changed")).alias("changed_text"),
        F.coalesce(as_id(F.col("raw_parent")), as_id(F.col("raw_other_parent"))).alias("parent_id"),
    )
    identified = texts.withColumn("item_id", _kept(F.col("item_id")))
    unknown = F.lit(v.UNKNOWN_LABEL)
    owes_work = F.col("allocates") & F.col("remaining_field").isNotNull()
    return identified.select(
        "organization",
        "team_id",
        "item_id",
        "arrival",
        "position",
        F.coalesce("type", unknown).alias("item_type"),
        F.coalesce("state", unknown).alias("state"),
        "title",
        "assigned_to",
        "area_path",
        "iteration_path",
        "remaining",
        F.col("unit").alias("remaining_unit"),
        "original_estimate",
        "completed_work",
        "story_points",
        "activity",
        "tags",
        blocked_flag(
            F.col("state"), F.col("tags"), F.col("blocked_states"), F.col("impediment_source")
        ).alias("blocked"),
        day(F.col("start_text")).alias("start_date"),
        day(F.col("target_text")).alias("target_date"),
        instant(F.col("created_text")).alias("created_at"),
        instant(F.col("changed_text")).alias("changed_at"),
        "parent_id",
        F.array("team_id").alias("team_memberships"),
        codes([(owes_work & F.col("remaining").isNull(), "missing_remaining_work")]).alias(
            "reasons"
        ),
    )


def capacity_members(payloads: DataFrame) -> DataFrame:
    """One row per person entry of the teams' capacity payloads.

    The person is the member's id, unique name or descriptor, else the entry's own id;
    a name never stands in for it, and an entry without one has no person_id.
    """
    rows = payload_records(payloads, "teamMembers", "teamCapacities", "capacities").withColumn(
        "member", as_object(member(F.col("record"), "teamMember"))
    )
    record, person = F.col("record"), F.col("member")
    name = F.when(
        person.isNotNull(), first_of(as_label, person, ("displayName", "uniqueName"))
    ).otherwise(as_label(member(record, "displayName")))
    return rows.select(
        "team_id",
        "arrival",
        "position",
        F.coalesce(
            first_of(as_text, person, ("id", "uniqueName", "descriptor")),
            first_of(as_text, record, ("personId", "memberId", "id")),
        ).alias("person_id"),
        name.alias("display_name"),
        as_text(member(person, "uniqueName")).alias("unique_name"),
        as_list(member(record, "activities")).alias("activities"),
        as_list(member(record, "daysOff")).alias("days_off"),
    )


def capacity_people(members: DataFrame) -> DataFrame:
    """People a team's capacity names."""
    return members.where("person_id is not null").select(
        "team_id", "person_id", "display_name", "unique_name", "arrival", "position"
    )


def normalize_capacity(members: DataFrame, settings: DataFrame) -> DataFrame:
    """One reservation per person and activity, in the team's unit.

    A missing daily capacity stays missing. A person without activities has no row.
    """
    rows = members.where("person_id is not null").select(
        "team_id", "person_id", F.explode(F.transform("activities", as_object)).alias("activity")
    )
    units = settings.select("team_id", "unit")
    activity = F.col("activity")
    return attach(rows.where("activity is not null"), units, "team_id", "inner").select(
        "team_id",
        "person_id",
        first_of(as_label, activity, ("name", "activity")).alias("activity"),
        as_quantity(member(activity, "capacityPerDay")).alias("per_day"),
        "unit",
    )


def capacity_problems(members: DataFrame) -> DataFrame:
    """What a capacity payload left open: (team_id, person_id, reason)."""
    activities = F.transform("activities", as_object)
    no_daily = F.exists(
        activities,
        lambda a: a.isNotNull() & as_quantity(member(a, "capacityPerDay")).isNull(),
    )
    undated = F.exists(
        F.transform("days_off", as_object), lambda d: d.isNotNull() & ~_has_dates(d)
    )
    reasons = F.when(F.col("person_id").isNull(), F.array(F.lit("no_person_id"))).otherwise(
        codes(
            [
                (F.size(F.coalesce("activities", F.array())) == 0, "no_activity"),
                (no_daily, "no_daily_capacity"),
                (undated, "undated_day_off"),
            ]
        )
    )
    return members.select("team_id", "person_id", F.explode(reasons).alias("reason")).distinct()


def _dates(entry: Column) -> tuple[Column, Column]:
    """Start and inclusive end as text."""
    return (
        first_of(as_text, entry, ("start", "startDate")),
        first_of(as_text, entry, ("end", "endDate")),
    )


def _has_dates(entry: Column) -> Column:
    start, end = _dates(entry)
    return day(start).isNotNull() & day(end).isNotNull()


def normalize_days_off(members: DataFrame, payloads: DataFrame) -> DataFrame:
    """Personal and team-wide days off with an exclusive end.

    The source's end is inclusive, so a day is added. Entries without valid dates are
    dropped.
    """
    personal = members.where("person_id is not null").select(
        "team_id", "person_id", F.explode("days_off").alias("entry")
    )
    team_wide = team_days_off_lists(payloads).select(
        "team_id", F.lit(None).cast("string").alias("person_id"), F.explode("listed").alias("entry")
    )
    rows = personal.unionByName(team_wide).select(
        "team_id", "person_id", as_object(F.col("entry")).alias("entry")
    )
    start, end = _dates(F.col("entry"))
    texts = rows.select("team_id", "person_id", start.alias("start"), end.alias("end"))
    return texts.select(
        "team_id",
        "person_id",
        day(F.col("start")).alias("start"),
        F.date_add(day(F.col("end")), 1).alias("end"),
        F.lit(None).cast("decimal(5,4)").alias("fraction"),
    ).where("start is not null and end is not null")


def team_days_off_lists(payloads: DataFrame) -> DataFrame:
    """The team-wide list of each payload; a missing list makes the source partial."""
    root = F.col("root")
    listed = F.coalesce(
        as_list(member(root, "teamDaysOff")),
        as_list(member(root, "daysOff")),
        as_list(F.col("payload")),
    )
    return payloads.withColumn("root", as_object(F.col("payload"))).select(
        "team_id",
        listed.alias("listed"),
        F.when(listed.isNull(), "team_days_off").alias("partial_source"),
    )


def normalize_iterations(payloads: DataFrame) -> DataFrame:
    """Path, start and inclusive finish of every listed iteration, in source order."""
    record = F.col("record")
    rows = payload_records(payloads, "iterations").withColumns(
        {
            "dated": F.coalesce(as_object(member(record, "attributes")), record),
            "fields": fields_of(record),
        }
    )
    dated = F.col("dated")
    texts = pick(rows, path=("path", "name", "iterationPath")).select(
        "team_id",
        as_text(member(record, "id")).alias("iteration_id"),
        picked(as_label, "path", 3).alias("path"),
        first_of(as_text, dated, ("startDate", "start")).alias("start"),
        first_of(as_text, dated, ("finishDate", "endDate", "finish")).alias("finish"),
        "arrival",
        "position",
    )
    return texts.withColumns({"start": day(F.col("start")), "finish": day(F.col("finish"))})


def iteration_links(payloads: DataFrame) -> DataFrame:
    """Items a sprint listing names, with the source of the link when it has one."""
    rows = payload_records(payloads, "workItemRelations", "workItems")
    record = F.col("record")
    target = F.coalesce(as_object(member(record, "target")), record)
    raw = rows.select(
        "organization",
        "team_id",
        member(as_object(member(record, "source")), "id").alias("raw_parent"),
        member(target, "id").alias("raw_id"),
        as_text(member(record, "rel")).alias("link"),
    )
    return raw.select(
        "organization",
        "team_id",
        as_id(F.col("raw_parent")).alias("parent_id"),
        _kept(as_id(F.col("raw_id"))).alias("item_id"),
        "link",
    )


def hierarchy_relations(links: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct hierarchy edges from sprint links and from the items' own parent field."""
    kind = F.lit(v.HIERARCHY).alias("relation")
    linked = links.where(
        F.col("parent_id").isNotNull() & F.contains("link", F.lit("Hierarchy"))
    ).select("organization", "parent_id", F.col("item_id").alias("child_id"), kind)
    named = items.where("parent_id is not null").select(
        "organization", "parent_id", F.col("item_id").alias("child_id"), kind
    )
    return linked.unionByName(named).dropDuplicates()


def batch_completeness(requested: DataFrame, items: DataFrame) -> DataFrame:
    """Per team: ids asked for, ids not returned, and the source that makes partial."""
    key = ["team_id", "organization", "item_id"]
    asked = requested.select(*key).distinct()
    returned = items.select(*key, F.lit(True).alias("returned")).distinct()
    return (
        asked.join(returned, key, "left")
        .groupBy("team_id")
        .agg(
            F.count(F.lit(1)).alias("requested"),
            F.count("returned").alias("returned"),
        )
        .withColumn("missing", F.col("requested") - F.col("returned"))
        .withColumn("partial_source", F.when(F.col("missing") > 0, "work_items"))
    )


def normalize_revisions(payloads: DataFrame, settings: DataFrame, state_map: DataFrame) -> DataFrame:
    """Revisions out of payloads with team_id, organization and item_id.

    A record without a usable change instant is dropped; a missing revision number is 0.
    """
    rows = payload_records(payloads, "revisions", "value").withColumn(
        "fields", fields_of(F.col("record"))
    )
    team = settings.select("team_id", "story_points_field", "remaining_field")
    record, fields = F.col("record"), F.col("fields")
    raw = attach(rows, team, "team_id", "inner").withColumns(
        {
            "raw_rev": member(record, "rev"),
            "raw_revision": member(record, "revision"),
            "raw_changed": member(fields, "System.ChangedDate"),
            "raw_other_changed": member(record, "changedDate"),
            "raw_state": member(fields, "System.State"),
            "raw_iteration": member(fields, "System.IterationPath"),
            "raw_area": member(fields, "System.AreaPath"),
            "raw_assignee": member(fields, "System.AssignedTo"),
            "raw_points": member(fields, F.col("story_points_field")),
            "raw_remaining": member(fields, F.col("remaining_field")),
            "person": as_object(member(fields, "System.AssignedTo")),
        }
    )
    number = F.coalesce(F.nullif(as_id(F.col("raw_rev")), F.lit(0)), as_id(F.col("raw_revision")))
    parsed = raw.select(
        "organization",
        "team_id",
        "item_id",
        F.coalesce(number, F.lit(0)).alias("revision"),
        F.coalesce(as_text(F.col("raw_changed")), as_text(F.col("raw_other_changed"))).alias(
            "changed_text"
        ),
        as_text(F.col("raw_state")).alias("state"),
        as_text(F.col("raw_iteration")).alias("iteration_path"),
        as_text(F.col("raw_area")).alias("area_path"),
        F.coalesce(
            first_of(as_text, F.col("person"), ("id", "uniqueName", "descriptor")),
            as_text(F.col("raw_assignee")),
        ).alias("assigned_to"),
        as_quantity(F.col("raw_points")).alias("story_points"),
        as_quantity(F.col("raw_remaining")).alias("remaining"),
    ).withColumn("changed_at", instant(F.col("changed_text")))
    usable = parsed.drop("changed_text").where("changed_at is not null")
    return map_state_category(usable, state_map).drop("state_reason")
