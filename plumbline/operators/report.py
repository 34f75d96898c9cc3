"""What a report says about the numbers: gaps, verdicts, candidates, ranked findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline import vocabulary as v
from plumbline.functions.columns import excerpt


def capacity_gap(rows: DataFrame) -> DataFrame:
    """Load minus capacity, and both as percent of the larger of the two.

    ``rows`` are teams or people with load_value, capacity_value, eligible and known. The
    gap is a lower bound while open items lack a value, and missing when either side is.
    """
    load = F.col("load_value").cast("decimal(20,4)")
    capacity = F.col("capacity_value").cast("decimal(20,8)")
    both = load.isNotNull() & capacity.isNotNull()
    larger = F.when(both, F.greatest(load.cast("decimal(20,8)"), capacity))
    hundred = F.lit(100).cast("decimal(3,0)")

    def percent(part: Column) -> Column:
        share = F.try_divide(part.cast("decimal(20,8)"), larger.cast("decimal(20,8)"))
        return (share.cast("decimal(24,14)") * hundred).cast("decimal(24,10)")

    nothing = F.lit(0).cast("decimal(20,8)")
    return rows.select(
        "*",
        (load - capacity).cast("decimal(24,8)").alias("gap"),
        (both & (F.col("known") < F.col("eligible"))).alias("is_partial"),
        percent(F.least(load.cast("decimal(20,8)"), capacity)).alias("fits_percent"),
        percent(F.greatest(nothing, (load - capacity).cast("decimal(20,8)"))).alias(
            "excess_percent"
        ),
    )


def _side(metric_id: str, column: str, alias: str) -> Column:
    return F.max(F.when(F.col("metric_id") == metric_id, F.col(column))).alias(alias)


def _load_beside_capacity(metrics: DataFrame) -> DataFrame:
    load, capacity = "known_remaining_work", "reserved_remaining_capacity"
    return metrics.groupBy("team_id").agg(
        _side(load, "status", "load_status"),
        _side(load, "value", "load_value"),
        _side(load, "unit", "load_unit"),
        _side(load, "missing", "load_missing"),
        _side(load, "coverage_eligible", "load_eligible"),
        _side(load, "coverage_known", "load_known"),
        _side(capacity, "status", "capacity_status"),
        _side(capacity, "value", "capacity_value"),
        _side(capacity, "unit", "capacity_unit"),
    )


def load_verdict(metrics: DataFrame) -> DataFrame:
    """One verdict per team: not_applicable, not_comparable, over, exact or fits."""
    difference = F.col("load_value") - F.col("capacity_value")
    none = F.lit(v.NOT_APPLICABLE)
    verdict = (
        F.when(
            F.col("load_status").eqNullSafe(none) & F.col("capacity_status").eqNullSafe(none),
            "not_applicable",
        )
        .when(difference.isNull(), "not_comparable")
        .when(difference > 0, "over")
        .when(difference == 0, "exact")
        .otherwise("fits")
    )
    return _load_beside_capacity(metrics).select(
        "team_id", verdict.alias("verdict"), difference.cast("decimal(38,8)").alias("difference")
    )


def action_candidates(metrics: DataFrame, people: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates for action per team, by fixed rules and priorities.

    ``people`` are person load rows; ``items`` are all collected items, not only the
    accountable ones. ``amount`` is the number of items or people, or the gap.
    """
    pair = _load_beside_capacity(metrics)
    nothing = F.lit(False)

    def candidate(rows: DataFrame, prefix: str, rule: str, priority: int, amount, partial=nothing):
        return rows.select(
            "team_id",
            F.concat_ws(":", F.lit(prefix), "team_id").alias("candidate_id"),
            F.lit(rule).alias("rule_id"),
            F.lit(priority).alias("priority"),
            amount.cast("decimal(38,8)").alias("amount"),
            partial.alias("is_partial"),
        )

    blocked = items.where("blocked").groupBy("team_id").agg(F.count(F.lit(1)).alias("n"))
    gap = F.col("load_value") - F.col("capacity_value")
    over = pair.where((F.col("load_unit") == F.col("capacity_unit")) & (gap > 0))
    partial = F.coalesce(F.col("load_known") < F.col("load_eligible"), nothing)
    idle = (
        people.where(
            (F.col("load_class") == v.NO_RECORDED_LOAD)
            & (F.col("person_id") != v.UNASSIGNED_PERSON)
        )
        .groupBy("team_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    unestimated = pair.where("load_missing > 0")
    parts = [
        candidate(blocked, "impediment", "active_impediment", 1, F.col("n")),
        candidate(over, "capacity_gap", "known_load_above_capacity", 2, gap, partial),
        candidate(idle, "no_recorded_load", "no_recorded_load", 3, F.col("n")),
        candidate(
            unestimated, "missing_remaining_work", "missing_remaining_work", 4,
            F.col("load_missing"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def top_decisions(candidates: DataFrame, count: int = v.TOP_DECISIONS) -> DataFrame:
    """The first candidates of each team by (priority, id).

    Spark limits each task's rows per team before the shuffle.
    """
    order = W.partitionBy("team_id").orderBy("priority", "candidate_id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def severity_rank(severity: Column) -> Column:
    """Position of a severity, most severe first; an unlisted one is last."""
    ranked = F.when(severity == v.SEVERITIES[0], 0)
    for rank, name in enumerate(v.SEVERITIES[1:], start=1):
        ranked = ranked.when(severity == name, rank)
    return ranked.otherwise(v.UNRANKED_SEVERITY)


def rank_findings(findings: DataFrame) -> DataFrame:
    """Findings of every team by severity, rule and id."""
    return findings.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy(
        "team_id", "severity_rank", "rule_id", "finding_id"
    )


# JSON of a finding in a summary. Missing fields are left out, so the fewest bytes of one
# are those of an empty object and the comma after it.
_FINDING_FIELDS = ("finding_id", "rule_id", "severity", "item_id")
_FEWEST_BYTES = len("{},")
_SALTS = 32


def summarize_within_budget(
    findings: DataFrame,
    fixed: DataFrame,
    limit_bytes: int = v.SUMMARY_BYTES,
    reference_bytes: int = 64,
) -> DataFrame:
    """The longest ranked prefix of each team's findings that fits the byte budget.

    ``fixed`` is (team_id, fixed_bytes): metrics and limitations, which are never cut. A
    cut summary also spends ``reference_bytes`` on pointing at the full list. A team of
    which no finding fits, or that has none, keeps one row without a finding.

    A finding takes at least a known number of bytes, so nothing beyond a fixed rank can
    fit; only that many per team are ordered, spread over salts first.
    """
    size = F.octet_length(F.to_json(F.struct(*_FINDING_FIELDS))) + 1
    rank = severity_rank(F.col("severity"))
    sized = findings.select(
        "team_id", *_FINDING_FIELDS, rank.alias("severity_rank"), size.cast("bigint").alias("bytes")
    )
    totals = sized.groupBy("team_id").agg(
        F.sum("bytes").alias("all_bytes"), F.count(F.lit(1)).alias("all_findings")
    )
    deepest = limit_bytes // _FEWEST_BYTES + 1
    order = ["severity_rank", "rule_id", "finding_id"]
    spread = F.pmod(F.xxhash64("finding_id"), F.lit(_SALTS))
    near = (
        sized.withColumn("salt", spread)
        .withColumn("at", F.row_number().over(W.partitionBy("team_id", "salt").orderBy(*order)))
        .where(F.col("at") <= deepest)
        .drop("salt", "at")
    )
    running = W.partitionBy("team_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    budget = F.lit(limit_bytes) - F.col("fixed_bytes") + 1
    teams = (
        fixed.select("team_id", "fixed_bytes")
        .join(totals, "team_id", "left")
        .select(
            "team_id",
            (F.coalesce("all_bytes", F.lit(0)) > budget).alias("truncated"),
            (budget - reference_bytes).alias("cut_budget"),
        )
    )
    fitting = (
        near.withColumn("rank", F.row_number().over(W.partitionBy("team_id").orderBy(*order)))
        .where(F.col("rank") <= deepest)
        .withColumn("running", F.sum("bytes").over(running))
        .join(teams, "team_id")
        .where(~F.col("truncated") | (F.col("running") <= F.col("cut_budget")))
        .select("team_id", "rank", *_FINDING_FIELDS, "bytes")
    )
    return teams.join(fitting, "team_id", "left").select(
        "team_id", "rank", *_FINDING_FIELDS, "bytes", "truncated"
    )


def evidence_page(
    evidence: DataFrame, cursor: int = 0, limit: int = v.EVIDENCE_PAGE, id_slice: int = 65_536
) -> DataFrame:
    """One page of every run's evidence in numeric id order, with the next cursor.

    ``evidence`` is (run_id, item_id). Items are counted per slice of ids, and only those of
    the slices that the page meets are ordered.
    """
    sliced = evidence.select("run_id", "item_id").withColumn(
        "slice", F.floor(F.col("item_id") / id_slice)
    )
    every = W.partitionBy("run_id")
    before = every.orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.lit(cursor + limit)
    near = (
        sliced.groupBy("run_id", "slice")
        .agg(F.count(F.lit(1)).alias("size"))
        .withColumn("offset", F.sum("size").over(before) - F.col("size"))
        .withColumn("total", F.sum("size").over(every))
        .where((F.col("offset") < upto) & (F.col("offset") + F.col("size") > cursor))
    )
    inside = W.partitionBy("run_id", "slice").orderBy("item_id")
    return (
        sliced.join(near, ["run_id", "slice"])
        .withColumn("position", F.col("offset") + F.row_number().over(inside))
        .where((F.col("position") > cursor) & (F.col("position") <= upto))
        .select(
            "run_id",
            "item_id",
            "position",
            "total",
            F.when(upto < F.col("total"), upto).alias("next_cursor"),
        )
    )


def merge_decisions(*logs: DataFrame) -> DataFrame:
    """Union of decision logs; the first occurrence of an id wins.

    Rows carry log_order and position, which also give the merged order.
    """
    merged = reduce(DataFrame.unionByName, logs)
    payload = [c for c in merged.columns if c not in ("id", "log_order", "position")]
    return (
        merged.groupBy("id")
        .agg(F.min(F.struct("log_order", "position", F.struct(*payload).alias("row"))).alias("first"))
        .select("id", "first.log_order", "first.position", "first.row.*")
    )


def replay_diff(stored: DataFrame, recomputed: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run, whether recomputed rows equal the stored ones, as multisets.

    One aggregation counts both directions: a row on one side only has a balance.
    """
    columns = stored.columns
    balance = (
        stored.withColumn("__side", F.lit(1))
        .unionByName(recomputed.select(*columns).withColumn("__side", F.lit(-1)))
        .groupBy(*columns)
        .agg(F.sum("__side").alias("balance"))
    )
    zero = F.lit(0).cast("bigint")
    return balance.groupBy(run).agg(
        F.sum(F.greatest(F.col("balance"), zero)).alias("only_stored"),
        F.sum(F.greatest(-F.col("balance"), zero)).alias("only_recomputed"),
        (F.max(F.abs("balance")) == 0).alias("identical"),
    )


def minimize_evidence(items: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """The audit record of each item: what reconciles a total, and no more.

    The title is an excerpt, quantities carry their unit, and provenance, when given by
    (organization, item_id), keeps source, tool, action and collection instant.
    """
    have = set(items.columns)

    def own(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind).alias(name)

    def measured(name: str) -> Column:
        if name not in have:
            return F.lit(None).cast("struct<value:string,unit:string>").alias(name)
        return F.when(
            F.col(name).isNotNull(),
            F.struct(
                F.col(name).cast("string").alias("value"), F.col("remaining_unit").alias("unit")
            ),
        ).alias(name)

    title = excerpt(F.col("title")) if "title" in have else F.lit(None).cast("string")
    record = items.select(
        "item_id",
        "organization",
        own("project_id"),
        "item_type",
        "state",
        "state_category",
        title.alias("title_excerpt"),
        "assigned_to",
        own("area_path"),
        own("iteration_path"),
        own("activity"),
        own("blocked", "boolean"),
        measured("remaining"),
        measured("original_estimate"),
        measured("completed_work"),
        own("story_points", "decimal(18,4)"),
        own("changed_at", "timestamp"),
        "team_memberships",
    )
    if provenance is None:
        return record
    kept = provenance.select(
        "organization",
        "item_id",
        F.struct("source", "tool", "action", "collected_at").alias("provenance"),
    )
    return record.join(kept, ["organization", "item_id"], "left")
