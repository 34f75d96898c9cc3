"""Planning rules as a registry of predicates, evaluated in one pass over the items.

A team's settings decide which rules run, how severe they are, how many days they
tolerate and which items they leave alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import vocabulary as v
from plumbline.functions.columns import is_open, path_in_scope
from plumbline.operators.skew import attach

_REQUIRE = "require:"
STORY_TYPES = ("Product Backlog Item", "User Story")


@dataclass(frozen=True)
class Rule:
    """A rule: its defaults and, given its settings column, when it fires for an item.

    A rule that needs the children states in ``asks`` what it asks of the item beforehand.
    What it fires by are then the summary of the children and the target date alone.
    """

    rule_id: str
    enabled: bool
    severity: str
    fires: Callable[[Column], Column]
    needs: str | None = None
    version: str = "1.0"
    asks: Callable[[Column], Column] | None = None


def _missing_fields(rule: Column) -> Column:
    """Fields named ``require:<field>`` in the rule's exceptions that the item lacks."""
    required = F.transform(
        F.filter(rule["exceptions"], lambda e: F.startswith(e, F.lit(_REQUIRE))),
        lambda e: F.substring(e, F.lit(len(_REQUIRE) + 1), F.length(e)),
    )
    return F.filter(
        required, lambda name: F.coalesce(F.try_element_at("item_values", name), F.lit("")) == ""
    )


RULES: dict[str, Rule] = {
    rule.rule_id: rule
    for rule in (
        Rule(
            "inverted_dates", True, "attention",
            lambda rule: F.col("start_date") > F.col("target_date"),
        ),
        Rule(
            "overdue_open_item", True, "attention",
            lambda rule: is_open(F.col("state_category"))
            & (F.datediff("today", "target_date") > rule["tolerance_days"]),
        ),
        Rule(
            "parent_ends_before_children", True, "attention",
            lambda rule: F.col("last_child_target") > F.col("target_date"),
            needs="children",
            asks=lambda rule: F.col("target_date").isNotNull(),
        ),
        Rule(
            "open_work_in_closed_sprint", True, "attention",
            lambda rule: is_open(F.col("state_category")) & F.col("iteration_closed"),
            needs="closed_iterations",
        ),
        Rule(
            "missing_required_fields", True, "info",
            lambda rule: F.size(_missing_fields(rule)) > 0,
            needs="item_values",
        ),
        Rule(
            "story_without_task", False, "info",
            lambda rule: ~F.col("has_child"),
            needs="children",
            asks=lambda rule: (F.col("accounting_level") == v.LEAF_TASK)
            & F.col("item_type").isin(*STORY_TYPES),
        ),
        Rule(
            "missing_estimate", False, "info",
            lambda rule: is_open(F.col("state_category")) & F.col("remaining").isNull(),
        ),
        Rule(
            "area_or_iteration_mismatch", False, "info",
            lambda rule: F.col("area_path").isNotNull()
            & (F.size("area_paths") > 0)
            & ~path_in_scope(
                F.col("area_path"), F.col("area_paths"), F.col("include_descendants")
            ),
        ),
    )
}


def _column(rule: Rule) -> str:
    return f"rule_{rule.rule_id}"


def effective_rules(teams: DataFrame, overrides: DataFrame) -> DataFrame:
    """Every rule per team with the team's overrides over the defaults.

    ``overrides`` has team_id, rule_id, enabled, severity, tolerance_days, exceptions.
    """
    defaults = F.array(
        *[
            F.struct(
                F.lit(r.rule_id).alias("rule_id"),
                F.lit(r.version).alias("rule_version"),
                F.lit(r.enabled).alias("default_enabled"),
                F.lit(r.severity).alias("default_severity"),
            )
            for r in RULES.values()
        ]
    )
    return (
        teams.select("team_id", F.inline(defaults))
        .join(overrides, ["team_id", "rule_id"], "left")
        .select(
            "team_id",
            "rule_id",
            "rule_version",
            F.coalesce("enabled", "default_enabled").alias("enabled"),
            F.coalesce("severity", "default_severity").alias("severity"),
            F.coalesce("tolerance_days", F.lit(0)).alias("tolerance_days"),
            F.coalesce("exceptions", F.array().cast("array<string>")).alias("exceptions"),
        )
    )


def enabled_rules(rules: DataFrame) -> DataFrame:
    """Rules that run for each team."""
    return rules.where("enabled").select("team_id", "rule_id", "severity", "tolerance_days")


def filter_area_scope(items: DataFrame, settings: DataFrame) -> DataFrame:
    """Items inside their team's areas."""
    areas = settings.select("team_id", "area_paths", "include_descendants")
    return (
        attach(items, areas, "team_id", "inner")
        .where(
            path_in_scope(F.col("area_path"), F.col("area_paths"), F.col("include_descendants"))
        )
        .select(*items.columns)
    )


def children_summary(items: DataFrame, relations: DataFrame) -> DataFrame:
    """Per parent: that it has a child, and the last target among its hierarchy children.

    The maximum is enough to tell whether any child ends later, so a parent with any
    number of children is reduced before it reaches one task.
    """
    # Inlined, so that what the join asks of its key is not pushed into the items' source:
    # their shuffles then equal those of the caller's own use of the items, and run once.
    target = F.struct(
        "organization",
        F.col("item_id").alias("child_id"),
        F.col("target_date").alias("child_target"),
    )
    targets = items.select(F.inline(F.array(target))).where("child_target is not null")
    # An edge that comes twice changes neither a maximum nor that there is a child.
    edges = relations.select("organization", "parent_id", "child_id", "relation")
    return (
        edges.join(targets, ["child_id", "organization"], "left")
        .groupBy(F.col("parent_id").alias("item_id"), "organization")
        .agg(
            F.lit(True).alias("has_child"),
            F.max(F.when(F.col("relation") == v.HIERARCHY, F.col("child_target"))).alias(
                "last_child_target"
            ),
        )
    )


def late_children(items: DataFrame, relations: DataFrame) -> DataFrame:
    """(parent, child) pairs whose child's target is after the parent's."""
    dated = items.where("target_date is not null")
    parents = dated.select(
        "team_id", "organization", F.col("item_id").alias("parent_id"),
        F.col("target_date").alias("parent_target"),
    )
    children = dated.select(
        "organization", F.col("item_id").alias("child_id"), F.col("target_date").alias("child_target")
    )
    edges = (
        relations.where(F.col("relation") == v.HIERARCHY)
        .select("organization", "parent_id", "child_id")
        .distinct()
    )
    # Each child row is looked up by its own id; only then does the parent's date arrive.
    return (
        edges.join(children, ["child_id", "organization"])
        .join(parents, ["parent_id", "organization"])
        .where("child_target > parent_target")
        .select("team_id", "organization", "parent_id", "child_id", "parent_target", "child_target")
    )


def evaluate_planning(
    items: DataFrame,
    relations: DataFrame,
    settings: DataFrame,
    rules: DataFrame,
    today: DataFrame,
    closed_iterations: DataFrame,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """One finding per enabled rule and item it fires for.

    ``rules`` comes from :func:`effective_rules`, ``today`` is (team_id, today) and
    ``closed_iterations`` is (team_id, iteration_path). ``only`` narrows the registry;
    what none of its rules needs is not joined. Teams and their closed iterations are tables
    that fit a task: they go to the items, which are not dealt by team.

    An item meets its children with what is left of it: the rules that fired or still may, as
    the bits of a number, and its target date. Its other columns are not shuffled for that.
    """
    evaluated = [RULES[rule_id] for rule_id in only] if only is not None else list(RULES.values())
    needed = {rule.needs for rule in evaluated}
    # One column of settings per rule; a rule that is off has none.
    own_settings = F.struct("rule_version", "severity", "tolerance_days", "exceptions")
    per_team = (
        rules.where("enabled")
        .groupBy("team_id")
        .agg(
            *[
                F.max(F.when(F.col("rule_id") == r.rule_id, own_settings)).alias(_column(r))
                for r in evaluated
            ]
        )
    )
    team = (
        settings.select("team_id", "accounting_level", "area_paths", "include_descendants")
        .join(per_team, "team_id")
        .join(today.select("team_id", "today"), "team_id")
    )
    values = [
        c for f in items.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")
        for c in (F.lit(f.name), F.col(f.name).cast("string"))
    ]
    no = F.lit(False)
    joined = attach(items, team, "team_id", "inner", bounded=True)
    if "closed_iterations" in needed:
        closed = closed_iterations.select(
            "team_id", "iteration_path", F.lit(True).alias("iteration_closed")
        ).distinct()
        joined = attach(
            joined, closed, ["team_id", "iteration_path"], bounded=True
        ).withColumn("iteration_closed", F.coalesce("iteration_closed", no))
    if "item_values" in needed:
        # After the joins, so that the texts of all columns do not travel beside the columns.
        joined = joined.withColumn("item_values", F.create_map(*values))

    def fires(rule: Rule, condition: Callable[[Column], Column]) -> Column:
        own = F.col(_column(rule))
        excepted = F.array_contains(own["exceptions"], F.col("item_id").cast("string"))
        return own.isNotNull() & ~excepted & condition(own)

    def finding(rule: Rule, fired: Column) -> Column:
        own = F.col(_column(rule))
        return F.when(
            fired,
            F.struct(
                F.lit(rule.rule_id).alias("rule_id"),
                own["rule_version"].alias("rule_version"),
                own["severity"].alias("severity"),
            ),
        )

    if "children" in needed:
        bits = [
            F.when(fires(rule, rule.asks or rule.fires), F.lit(1 << at)).otherwise(F.lit(0))
            for at, rule in enumerate(evaluated)
        ]
        narrow = joined.select(
            "team_id", "organization", "item_id", "target_date",
            reduce(Column.bitwiseOR, bits).alias("__rules"),
        ).where(F.col("__rules") != 0)
        joined = narrow.join(
            children_summary(items, relations), ["item_id", "organization"], "left"
        ).withColumn("has_child", F.coalesce("has_child", no))
        # Once more the rules' settings, which are one row per team.
        joined = attach(joined, per_team, "team_id", "inner", bounded=True)

        def fired(at: int, rule: Rule) -> Column:
            bit = F.col("__rules").bitwiseAND(F.lit(1 << at)) != 0
            return bit & rule.fires(F.col(_column(rule))) if rule.asks else bit

        findings = [finding(rule, fired(at, rule)) for at, rule in enumerate(evaluated)]
    else:
        findings = [finding(rule, fires(rule, rule.fires)) for rule in evaluated]
    found = F.array_compact(F.array(*findings))
    return joined.select("team_id", "organization", "item_id", F.inline(found)).select(
        "team_id",
        "organization",
        "item_id",
        F.concat_ws(":", "rule_id", "item_id").alias("finding_id"),
        "rule_id",
        "rule_version",
        "severity",
    )
