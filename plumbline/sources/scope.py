"""Team configuration tables: sprint choice, process discovery, layered settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import vocabulary as v
from plumbline.functions.columns import local_date, local_midnight
from plumbline.functions.json import as_id, as_list, as_object, as_text, first_of, member
from plumbline.operators.skew import attach

# Source state categories (lower case) and their category here.
SOURCE_CATEGORIES = {
    "proposed": v.PROPOSED,
    "inprogress": v.IN_PROGRESS,
    "resolved": v.RESOLVED,
    "completed": v.COMPLETED,
    "removed": v.REMOVED,
}

# Numeric bug behaviour of a team and its label.
BUG_BEHAVIOR = {0: "excluded", 1: "as_requirement", 2: "as_task"}

# Settings name and the scheduling field it is discovered from.
SCHEDULING_FIELDS = {
    "remaining_field": "Microsoft.VSTS.Scheduling.RemainingWork",
    "original_estimate_field": "Microsoft.VSTS.Scheduling.OriginalEstimate",
    "completed_work_field": "Microsoft.VSTS.Scheduling.CompletedWork",
    "story_points_field": "Microsoft.VSTS.Scheduling.StoryPoints",
}


def _lookup(mapping: dict):
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def select_iteration(teams: DataFrame, iterations: DataFrame) -> DataFrame:
    """The sprint each team is read against, and the source that is partial without one.

    ``teams`` has team_id, timezone, as_of and wanted_path. The wanted path wins when it
    is listed; otherwise the first listed iteration whose local date range contains
    as_of. Ties follow source order (arrival, position).
    """
    here = local_date(F.col("as_of"), F.col("timezone"))
    wanted = F.col("path") == F.col("wanted_path")
    rank = F.when(wanted, 0).when(here.between(F.col("start"), F.col("finish")), 1)
    chosen = (
        attach(iterations, teams, "team_id", "inner")
        .withColumn("rank", rank)
        .where("rank is not null")
        .groupBy("team_id")
        .agg(
            F.min_by(
                F.struct("path", "iteration_id", "start", "finish"),
                F.struct("rank", "arrival", "position"),
            ).alias("chosen")
        )
    )
    undated = F.col("chosen.start").isNull() | F.col("chosen.finish").isNull()
    return teams.join(chosen, "team_id", "left").select(
        "team_id",
        F.coalesce("chosen.path", "wanted_path").alias("iteration_path"),
        F.col("chosen.iteration_id").alias("iteration_id"),
        F.col("chosen.start").alias("start"),
        F.col("chosen.finish").alias("finish"),
        "timezone",
        F.when(undated, "iterations").alias("partial_source"),
    )


def resolve_window(iterations: DataFrame) -> DataFrame:
    """Instants of a dated iteration: local midnight to the midnight after its last day.

    The day is added before the time zone applies, so a clock change inside the window
    does not move its end.
    """
    zone = F.col("timezone")
    return iterations.where("start is not null and finish is not null").select(
        "team_id",
        local_midnight(F.col("start"), zone).alias("window_start"),
        local_midnight(F.date_add("finish", 1), zone).alias("window_end"),
        "timezone",
    )


def _type_states(definitions: DataFrame) -> DataFrame:
    root = as_object(F.col("payload"))
    state = F.col("state")
    return (
        definitions.select(
            "team_id", "type_order", F.posexplode(as_list(member(root, "states"))).alias("at", "s")
        )
        .select("team_id", "type_order", "at", as_object(F.col("s")).alias("state"))
        .select(
            "team_id",
            "type_order",
            "at",
            as_text(member(state, "name")).alias("state"),
            F.lower(F.coalesce(as_text(member(state, "category")), F.lit(""))).alias("source"),
        )
        .where("state is not null")
        .withColumn("state_category", F.try_element_at(_lookup(SOURCE_CATEGORIES), F.col("source")))
    )


def discover_state_map(definitions: DataFrame) -> DataFrame:
    """Category of every state the team's item types define; the last type wins.

    ``definitions`` has team_id, type_order and the type's JSON in payload. States in an
    unknown category are not mapped; see :func:`unmapped_states`.
    """
    return (
        _type_states(definitions)
        .where("state_category is not null")
        .groupBy("team_id", "state")
        .agg(F.max_by("state_category", F.struct("type_order", "at")).alias("state_category"))
    )


def unmapped_states(definitions: DataFrame) -> DataFrame:
    """States whose source category is not known."""
    return (
        _type_states(definitions)
        .where("state_category is null")
        .select("team_id", "type_order", "state", "source")
        .distinct()
    )


def discover_fields(definitions: DataFrame) -> DataFrame:
    """Scheduling fields that at least one of the team's types has."""
    root = as_object(F.col("payload"))
    names = F.transform(
        as_list(member(root, "fields")), lambda f: as_text(member(as_object(f), "referenceName"))
    )
    known = _lookup({reference: name for name, reference in SCHEDULING_FIELDS.items()})
    return (
        definitions.select("team_id", F.explode(names).alias("field"))
        .withColumn("setting", F.try_element_at(known, F.col("field")))
        .where("setting is not null")
        .select("team_id", "setting", "field")
        .distinct()
    )


def discover_team_scope(payloads: DataFrame) -> DataFrame:
    """Areas, descendants flag, working days and bug behaviour from team settings JSON.

    Descendants count only when every area says so, and are unknown when none says.
    Weekdays turn from Sunday = 0 to Monday = 0.
    """
    root = as_object(F.col("payload"))
    listed = F.coalesce(
        *[as_list(member(F.col("root"), k)) for k in ("teamFieldValues", "areaPaths", "areas", "values")]
    )
    areas = F.transform(listed, as_object)
    named = F.filter(
        F.transform(
            areas,
            lambda a: F.struct(
                first_of(as_text, a, ("value", "path", "areaPath", "name")).alias("path"),
                member(a, "includeChildren").try_cast("boolean").alias("children"),
            ),
        ),
        lambda a: a["path"].isNotNull(),
    )
    said = F.filter(F.transform("areas", lambda a: a["children"]), lambda c: c.isNotNull())
    days = F.transform(as_list(member(F.col("root"), "workingDays")), as_id)
    valid = F.filter(days, lambda d: d.between(0, 6))
    return (
        payloads.select("team_id", root.alias("root"))
        .select("team_id", "root", named.alias("areas"))
        .select(
            "team_id",
            F.transform(F.coalesce("areas", F.array()), lambda a: a["path"]).alias("area_paths"),
            F.when(F.size(said) > 0, F.forall(said, lambda c: c)).alias("include_descendants"),
            F.array_sort(
                F.array_distinct(F.transform(valid, lambda d: F.pmod(d + 6, F.lit(7)).cast("int")))
            ).alias("working_days"),
            F.try_element_at(
                _lookup(BUG_BEHAVIOR), as_id(member(F.col("root"), "bugsBehavior")).cast("int")
            ).alias("bug_behavior"),
        )
    )


# Settings layers from weakest to strongest.
LAYERS = ("default", "profile", "team", "local", "run_all", "run")


def effective_settings(layers: DataFrame) -> DataFrame:
    """Value of every settings key per team, and the layer it came from.

    ``layers`` is (team_id, layer, key, value): one row per leaf, lists as one value. The
    strongest layer that has the key wins.
    """
    order = F.array_position(F.array(*[F.lit(name) for name in LAYERS]), F.col("layer"))
    return (
        layers.withColumn("rank", order)
        .where("rank > 0")
        .groupBy("team_id", "key")
        .agg(F.max_by(F.struct("value", "layer"), "rank").alias("won"))
        .select("team_id", "key", "won.value", "won.layer")
    )
