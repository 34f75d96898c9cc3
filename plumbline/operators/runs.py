"""Run snapshots: state, fingerprints, latest, expiry, scheduling and freshness."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import vocabulary as v
from plumbline.operators.skew import attach, day_slice, previous_row


def source_identity(*parts: Column) -> Column:
    """Opaque identity of a source: no name can be read back from it."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))


def run_state(metrics: DataFrame, partial_sources: DataFrame) -> DataFrame:
    """State of each run, and why it is partial.

    Any partial source and any partial or unavailable metric makes a run partial. Both
    inputs carry run_id; the reasons of a run are a closed set of codes.
    """
    incomplete = metrics.where(F.col("status").isin(v.PARTIAL, v.UNAVAILABLE)).select(
        "run_id", F.concat(F.lit("metric:"), "metric_id").alias("reason")
    )
    reasons = (
        partial_sources.select("run_id", F.col("source").alias("reason"))
        .unionByName(incomplete)
        .distinct()
        .groupBy("run_id")
        .agg(F.array_sort(F.collect_list("reason")).alias("partial_reasons"))
    )
    empty = F.array().cast("array<string>")
    return (
        metrics.select("run_id")
        .distinct()
        .join(reasons, "run_id", "left")
        .select(
            "run_id",
            F.when(F.col("partial_reasons").isNull(), "complete").otherwise("partial").alias("state"),
            F.coalesce("partial_reasons", empty).alias("partial_reasons"),
        )
    )


def artifact_fingerprint(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fingerprint of the rows of each group, whatever their order.

    Each row is hashed as JSON with its columns in name order and nulls kept, so different
    rows differ; pieces of the hashes are summed, which needs no ordering and no gathering
    of the group, and counts repeated rows.
    """
    columns = [F.col(f"`{c}`") for c in sorted(rows.columns) if c not in by]
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    hashed = rows.select(*by, F.sha2(text, 256).alias("h"))

    def piece(at: int) -> Column:
        chunk = F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(20,0)")
        return F.sum(chunk).cast("string")

    combined = F.concat_ws("|", F.count(F.lit(1)).cast("string"), *[piece(a) for a in (1, 16, 31, 46)])
    return (
        hashed.groupBy(*by)
        .agg(combined.alias("combined"))
        .select(*by, F.concat(F.lit("sha256:"), F.sha2("combined", 256)).alias("fingerprint"))
    )


def divergent_artifacts(stored: DataFrame, recomputed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Recorded artifacts that are gone or whose fingerprint is no longer the same."""
    now = recomputed.withColumnRenamed("fingerprint", "current")
    return (
        stored.join(now, list(by), "left")
        .where(~F.col("fingerprint").eqNullSafe(F.col("current")))
        .select(*by, F.when(F.col("current").isNull(), "missing").otherwise("changed").alias("problem"))
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of each team; run_id settles equal instants."""
    kept = [c for c in runs.columns if c not in ("team_id", "as_of", "run_id")]
    newest = F.max(F.struct("as_of", "run_id", F.struct(*kept).alias("row")))
    return (
        runs.groupBy("team_id")
        .agg(newest.alias("newest"))
        .select("team_id", "newest.run_id", "newest.as_of", "newest.row.*")
    )


def expired_runs(
    runs: DataFrame, now: datetime, retention_days: int = v.RETENTION_DAYS
) -> DataFrame:
    """Runs older than the retention at ``now``."""
    limit = F.lit(now.isoformat(sep=" ")).cast("timestamp") - F.make_dt_interval(
        F.lit(retention_days)
    )
    return runs.where(F.col("as_of") < limit)


def schedule_key(config: Column, team: Column, window: Column, day: Column) -> Column:
    """Key of a scheduled run: changes with settings, team, window and day."""
    window_or_current = F.coalesce(window, F.lit("current"))
    return F.substring(
        F.sha2(F.concat_ws("|", config, team, window_or_current, day.cast("string")), 256), 1, 32
    )


def pending_runs(planned: DataFrame, succeeded: DataFrame, force: bool = False) -> DataFrame:
    """Planned runs without a success marker for their key; ``force`` keeps them all."""
    keyed = planned.withColumn(
        "schedule_key",
        schedule_key(F.col("config_hash"), F.col("team_id"), F.col("window"), F.col("day")),
    )
    if force:
        return keyed
    return keyed.join(succeeded.select("schedule_key").distinct(), "schedule_key", "left_anti")


def run_state_changes(finished: DataFrame, slice_by: Column | None = None) -> DataFrame:
    """Runs worth a notice: a key's first run, and each whose state differs from the last.

    ``finished`` has schedule_key, run_id, finished_at and state.
    """
    pieces = slice_by if slice_by is not None else day_slice(F.col("finished_at"))
    compared = previous_row(
        finished.select("schedule_key", "run_id", "finished_at", "state"),
        ["schedule_key"],
        ["finished_at", "run_id"],
        ["state"],
        pieces,
    )
    return compared.where(
        ~F.col("previous_exists") | ~F.col("state").eqNullSafe(F.col("previous_state"))
    ).select("schedule_key", "run_id", "finished_at", "state", "previous_state")


def report_freshness(
    runs: DataFrame, now: datetime, stale_after_hours: int = v.STALE_AFTER_HOURS
) -> DataFrame:
    """Each team's latest run with its whole hours of age and whether it is stale."""
    micros = F.unix_micros(F.lit(now.isoformat(sep=" ")).cast("timestamp")) - F.unix_micros("as_of")
    hour = 3_600_000_000
    return latest_run(runs).select(
        "team_id",
        "run_id",
        "as_of",
        "state",
        F.floor(micros / F.lit(hour).cast("decimal(20,0)")).cast("bigint").alias("age_hours"),
        (micros > stale_after_hours * hour).alias("is_stale"),
    )


def teams_with_runs(runs: DataFrame) -> DataFrame:
    return runs.select("team_id").distinct()


def authorized_reports(reports: DataFrame, grants: DataFrame, principal: str) -> DataFrame:
    """Reports of the teams granted to the principal; an unknown one sees nothing."""
    granted = grants.where(F.col("principal") == principal).select("team_id").distinct()
    return attach(reports, granted, "team_id", "left_semi")
