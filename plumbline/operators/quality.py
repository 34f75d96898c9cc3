"""Whether a metric can be stated for a team, how completely, and why not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import vocabulary as v
from plumbline.functions.columns import ratio
from plumbline.operators.calendar import team_capacity
from plumbline.operators.load import classify_load, team_tallies
from plumbline.operators.skew import attach

_REQUIREMENTS_SCHEMA = T.StructType(
    [
        T.StructField("metric_id", T.StringType(), False),
        T.StructField("capability", T.StringType(), False),
        T.StructField("required_fields", T.ArrayType(T.StringType()), False),
        T.StructField("any_of_fields", T.ArrayType(T.StringType()), False),
        T.StructField("required_sources", T.ArrayType(T.StringType()), False),
        T.StructField("requires_reservations", T.BooleanType(), False),
        T.StructField("zero_is_meaningful", T.BooleanType(), False),
    ]
)

# What each metric needs before it can be stated.
REQUIREMENTS = [
    ("open_items_count", "current_status", [], [], ["work_items"], False, True),
    (
        "blocked_items_count", "current_status", [],
        ["impediment_source", "blocked_states"], ["work_items"], False, True,
    ),
    ("known_remaining_work", "allocation", ["remaining_field"], [], ["work_items"], False, False),
    ("reserved_remaining_capacity", "allocation", [], [], ["capacity"], True, False),
    (
        "observed_utilization", "allocation", ["remaining_field"], [],
        ["work_items", "capacity"], True, False,
    ),
]


def metric_requirements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUIREMENTS, _REQUIREMENTS_SCHEMA)


def _configured_fields() -> Column:
    """Names of the process fields a team has configured."""
    filled = {
        "remaining_field": F.col("remaining_field").isNotNull(),
        "impediment_source": F.col("impediment_source").isNotNull(),
        "blocked_states": F.size(F.coalesce("blocked_states", F.array())) > 0,
    }
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in filled.items()]))


# Columns of a measured metric that the assessment itself publishes or consumes.
_ASSESSED = ("team_id", "metric_id", "value", "has_reservations")


def assess_metric(measured: DataFrame, settings: DataFrame, requirements: DataFrame) -> DataFrame:
    """Status, coverage and reasons for measured metrics, one row per (team, metric).

    ``measured`` carries metric_id, value, eligible, known and has_reservations.
    Reasons are codes. A partial source never leaves a metric ``available``, and an
    unavailable metric has no value.
    """
    team = settings.select(
        "team_id",
        "capabilities",
        "partial_sources",
        _configured_fields().alias("configured_fields"),
    )
    rows = measured.join(requirements, "metric_id").join(team, "team_id")
    eligible, known = F.col("eligible"), F.col("known")

    no_capability = ~F.array_contains("capabilities", F.col("capability"))
    lacks_field = (F.size(F.array_except("required_fields", "configured_fields")) > 0) | (
        (F.size("any_of_fields") > 0) & ~F.arrays_overlap("any_of_fields", "configured_fields")
    )
    no_reservation = F.col("requires_reservations") & ~F.col("has_reservations")
    not_applicable = (
        F.when(no_capability, "capability_not_enabled")
        .when(lacks_field, "process_field_not_configured")
        .when(no_reservation, "no_reserved_capacity")
    )
    blocking = F.arrays_overlap("required_sources", "partial_sources")
    own_status = (
        F.when(eligible.isNull(), v.PARTIAL)
        .when((eligible == 0) & F.col("zero_is_meaningful"), v.AVAILABLE)
        .when(eligible == 0, v.UNAVAILABLE)
        .when(known == 0, v.UNAVAILABLE)
        .when(known < eligible, v.PARTIAL)
        .otherwise(v.AVAILABLE)
    )
    own_reason = F.when(
        (eligible == 0) & ~F.col("zero_is_meaningful"), "empty_eligible_sample"
    ).when((eligible > 0) & (known == 0), "no_valid_value")

    staged = rows.select(
        "*",
        not_applicable.alias("__na"),
        blocking.alias("__blocking"),
        own_status.alias("__own"),
        own_reason.alias("__reason"),
    )
    lowered = F.when(F.col("known") > 0, v.PARTIAL).otherwise(v.UNAVAILABLE)
    status = (
        F.when(F.col("__na").isNotNull(), v.NOT_APPLICABLE)
        .when(F.col("__blocking") & (F.col("__own") == v.AVAILABLE), lowered)
        .otherwise(F.col("__own"))
    )
    reasons = F.when(F.col("__na").isNotNull(), F.array("__na")).otherwise(
        F.array_compact(F.array("__reason", F.when(F.col("__blocking"), "partial_source")))
    )
    applicable = F.col("status") != v.NOT_APPLICABLE
    return staged.select("*", status.alias("status"), reasons.alias("reasons")).select(
        "team_id",
        "metric_id",
        "status",
        F.when(F.col("status").isin(v.AVAILABLE, v.PARTIAL), F.col("value")).alias("value"),
        *[c for c in measured.columns if c not in _ASSESSED],
        F.when(applicable, F.col("eligible")).alias("coverage_eligible"),
        F.when(applicable, F.col("known")).otherwise(0).cast("bigint").alias("coverage_known"),
        F.when(applicable, ratio(known, eligible)).alias("coverage_ratio"),
        "reasons",
    )


def _utilization() -> dict[str, Column]:
    """Status, ratio and reason of load over capacity, over a team's compared row."""
    disabled = ~F.array_contains("capabilities", F.lit("allocation"))
    status = (
        F.when(disabled, v.NOT_APPLICABLE)
        .when(F.col("capacity_value").isNull() | F.col("ratio").isNull(), v.UNAVAILABLE)
        .when(F.col("known") != F.col("eligible"), v.PARTIAL)
        .otherwise(v.AVAILABLE)
    )
    reason = (
        F.when(disabled, "capability_not_enabled")
        .when(F.col("capacity_value").isNull(), "capacity_unknown")
        .when(F.col("ratio").isNull(), "not_comparable")
    )
    return {"status": status, "ratio": F.when(~disabled, F.col("ratio")), "reason": reason}


def observed_utilization(compared: DataFrame, settings: DataFrame) -> DataFrame:
    """Load over capacity per team, with its own status order.

    ``compared`` is the team's row out of ``classify_load``. Not applicable comes first,
    then unknown capacity, then a missing ratio, then partial load.
    """
    team = settings.select("team_id", "capabilities")
    parts = [column.alias(name) for name, column in _utilization().items()]
    return compared.join(team, "team_id").select("team_id", *parts)


def team_comparison(
    accountable: DataFrame,
    settings: DataFrame,
    reservations: DataFrame,
    capacities: DataFrame,
) -> DataFrame:
    """Every team's load beside its capacity, classified, with its item counters."""
    tallies = team_tallies(accountable, settings)
    capacity = team_capacity(settings, reservations, capacities).select(
        "team_id",
        F.when(F.col("eligible") > 0, F.col("capacity_unit")).alias("capacity_unit"),
        "capacity_value",
        F.col("eligible").alias("capacity_eligible"),
        F.col("known").alias("capacity_known"),
        F.col("missing").alias("capacity_missing"),
    )
    zero = F.lit(0).cast("bigint")
    counters = [c for c in tallies.columns if c not in ("team_id", "load_value")]
    compared = (
        settings.select(
            "team_id", F.col("unit").alias("load_unit"), "below", "within", "attention"
        )
        .join(tallies, "team_id", "left")
        .join(capacity, "team_id", "left")
        .withColumns({c: F.coalesce(c, zero) for c in counters})
    )
    return classify_load(compared)


def team_metrics(
    accountable: DataFrame,
    settings: DataFrame,
    reservations: DataFrame,
    capacities: DataFrame,
    comparison: DataFrame | None = None,
) -> DataFrame:
    """The long metrics table: five metrics per team with value, status and quality.

    Every team's items are tallied in one pass, and its row is spread into the metrics.
    """
    zero = F.lit(0).cast("bigint")
    if comparison is None:
        comparison = team_comparison(accountable, settings, reservations, capacities)
    has_reservations = F.col("capacity_eligible") > 0

    def metric(name, value, unit, eligible, known, missing=zero, invalid=zero, excluded=zero):
        return F.struct(
            F.lit(name).alias("metric_id"),
            value.cast("decimal(38,8)").alias("value"),
            unit.alias("unit"),
            eligible.alias("eligible"),
            known.alias("known"),
            missing.alias("missing"),
            invalid.alias("invalid"),
            excluded.alias("excluded"),
        )

    c = F.col
    load_quality = [c("eligible"), c("known"), c("missing"), c("invalid"), c("excluded")]
    items = F.lit(v.ITEMS_UNIT)
    none = F.lit(None)
    measured_on = comparison.join(settings.select("team_id", "capabilities"), "team_id")
    long = measured_on.select(
        "team_id",
        has_reservations.alias("has_reservations"),
        *[column.alias(f"use_{name}") for name, column in _utilization().items()],
        F.inline(
            F.array(
                metric("open_items_count", c("open"), items, c("accountable"), c("accountable")),
                metric(
                    "blocked_items_count", c("blocked"), items, c("accountable"),
                    c("blocked_known"), c("accountable") - c("blocked_known"),
                ),
                metric("known_remaining_work", c("load_value"), c("load_unit"), *load_quality),
                metric(
                    "reserved_remaining_capacity", c("capacity_value"), c("load_unit"),
                    c("capacity_eligible"), c("capacity_known"), c("capacity_missing"),
                ),
                metric("observed_utilization", none, none.cast("string"), *load_quality),
            )
        ),
    )
    assessed = assess_metric(long, settings, metric_requirements(accountable.sparkSession))
    # Utilization has its own status; it travels with the row that it was measured on.
    own = (c("metric_id") == "observed_utilization") & (c("status") != v.NOT_APPLICABLE)
    return assessed.select(
        "team_id",
        "metric_id",
        F.when(own, c("use_status")).otherwise(c("status")).alias("status"),
        "value",
        F.when(c("value").isNotNull(), c("unit")).alias("unit"),
        F.when(own, c("use_ratio")).alias("ratio"),
        "coverage_eligible",
        "coverage_known",
        "coverage_ratio",
        "eligible",
        "known",
        "missing",
        "invalid",
        "excluded",
        F.when(own, F.array_compact(F.array("use_reason"))).otherwise(c("reasons")).alias("reasons"),
    )


def limitations_rollup(*sources: DataFrame) -> DataFrame:
    """Distinct reason codes per team. Each source is (team_id, reason).

    Codes form a closed vocabulary, so a team's array stays small whatever the rows.
    """
    seen = reduce(DataFrame.unionByName, [s.select("team_id", "reason") for s in sources])
    return (
        seen.where("reason is not null")
        .distinct()
        .groupBy("team_id")
        .agg(F.array_sort(F.collect_list("reason")).alias("reasons"))
    )
