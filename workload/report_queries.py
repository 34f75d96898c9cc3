"""Report, claim and run snapshot queries."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from plumbline.operators import claims, report, runs
from plumbline.session import shared_folder
from plumbline.sources import sinks
from workload.bindings import Tables
from workload.catalog import query
from workload.load_queries import METRICS_SQL, PERSON_LOAD_SQL, person_load, team_metrics
from workload.views import VIEWS, with_views

NOW = datetime(2024, 1, 31, 12, 0)
# Wording taken as banned over the documents, which carry little of the default list.
BANNED = (r"\bthe\b", r"proves that")

_PAIR = (
    METRICS_SQL
    + """,
    pair as (
      select team_id,
        max(case when metric_id = 'known_remaining_work' then status end) as load_status,
        max(case when metric_id = 'known_remaining_work' then value end) as load,
        max(case when metric_id = 'known_remaining_work' then missing end) as load_missing,
        max(case when metric_id = 'known_remaining_work' then coverage_eligible end) as eligible,
        max(case when metric_id = 'known_remaining_work' then coverage_known end) as known,
        max(case when metric_id = 'reserved_remaining_capacity' then status end) as cap_status,
        max(case when metric_id = 'reserved_remaining_capacity' then value end) as cap
      from metrics group by team_id)
    """
)


@query(
    "capacity_gap",
    f"""
    with people_rows as ({PERSON_LOAD_SQL})
    select team_id, person_id, load_value, capacity_value, round(load_value - capacity_value, 6) as gap,
      load_value is not null and capacity_value is not null and known < eligible as is_partial,
      round(least(load_value, capacity_value) * 100 / nullif(greatest(load_value, capacity_value), 0), 4)
        + case when load_value is null or capacity_value is null then null else 0 end as fits_percent,
      round(greatest(0, load_value - capacity_value) * 100
        / nullif(greatest(load_value, capacity_value), 0), 4)
        + case when load_value is null or capacity_value is null then null else 0 end as excess_percent
    from people_rows
    """,
)
def _(t: Tables):
    rows = report.capacity_gap(person_load(t))
    return rows.select(
        "team_id", "person_id", "load_value", "capacity_value", "gap", "is_partial",
        F.round("fits_percent", 4).alias("fits_percent"),
        F.round("excess_percent", 4).alias("excess_percent"),
    )


@query(
    "load_verdict",
    _PAIR
    + """
    select team_id, round(load - cap, 6) as difference,
      case when load_status = 'not_applicable' and cap_status = 'not_applicable' then 'not_applicable'
        when load is null or cap is null then 'not_comparable' when load > cap then 'over'
        when load = cap then 'exact' else 'fits' end as verdict
    from pair
    """,
)
def _(t: Tables):
    return report.load_verdict(team_metrics(t))


_CANDIDATES = (
    _PAIR
    + f""",
    candidates as (
      select i.team_id, 'impediment' as prefix, 'active_impediment' as rule_id, cast(1 as bigint) as priority,
        cast(count(*) as double) as amount, false as is_partial
      from children i where blocked group by i.team_id
      union all
      select team_id, 'capacity_gap', 'known_load_above_capacity', 2, round(load - cap, 6),
        coalesce(known < eligible, false) from pair where load > cap
      union all
      select team_id, 'no_recorded_load', 'no_recorded_load', 3, cast(count(*) as double), false
      from ({PERSON_LOAD_SQL}) where load_class = 'NO_RECORDED_LOAD' group by team_id
      union all
      select team_id, 'missing_remaining_work', 'missing_remaining_work', 4,
        cast(load_missing as double), false from pair where load_missing > 0)
    """
)


def _candidates(t: Tables):
    return report.action_candidates(team_metrics(t), person_load(t), t.items)


@query(
    "action_candidates",
    _CANDIDATES
    + """
    select team_id, prefix || ':' || team_id as candidate_id, rule_id, priority, amount, is_partial
    from candidates
    """,
)
def _(t: Tables):
    return _candidates(t)


@query(
    "top_decisions",
    _CANDIDATES
    + """
    select * from (
      select team_id, prefix || ':' || team_id as candidate_id, rule_id, priority, amount, is_partial,
        row_number() over (partition by team_id order by priority, prefix) as rank
      from candidates) where rank <= 3
    """,
)
def _(t: Tables):
    return report.top_decisions(_candidates(t))


VIEWS["findings"] = (
    ("accountable",),
    """
    select team_id, item_id, rule_id || ':' || item_id as finding_id, rule_id, severity, severity_rank
    from (
      select *, case when state_category is null then 'unmapped_state'
          when state_category in ('completed', 'removed') and remaining > 0
            then 'completed_with_remaining_work'
          when state_category not in ('completed', 'removed') and remaining < 0
            then 'negative_remaining_work' end as rule_id,
        case when state_category is null then 'unheard'
          when state_category in ('completed', 'removed') then 'attention' else 'critical' end as severity,
        case when state_category is null then 99
          when state_category in ('completed', 'removed') then 2 else 0 end::bigint as severity_rank
      from accountable)
    where rule_id is not null
    """,
)


@query("rank_findings", with_views("select * from findings", "findings"))
def _(t: Tables):
    return report.rank_findings(t.findings).drop("organization")


@query(
    "summarize_within_budget",
    with_views(
        """
        , sized as (
          select *, length('{"finding_id":"' || finding_id || '","rule_id":"' || rule_id || '","severity":"'
            || severity || '","item_id":' || item_id || '}') + 1 as bytes from findings),
        ranked as (
          select *, row_number() over w as rank, sum(bytes) over w as running,
            sum(bytes) over (partition by team_id) as all_bytes
          from sized window w as (partition by team_id order by severity_rank, rule_id, finding_id
            rows between unbounded preceding and current row)),
        budgets as (
          select team_id, 24576 + 1 - case when cast(team_id as int) % 7 = 0 then 24560 else 1000 end as budget
          from settings)
        select b.team_id, rank, finding_id, rule_id, severity, item_id, bytes,
          coalesce((select max(a.all_bytes) from ranked a where a.team_id = b.team_id), 0) > budget as truncated
        from budgets b left join ranked r
          on r.team_id = b.team_id and (r.all_bytes <= budget or r.running <= budget - 64)
        """,
        "settings", "findings",
    ),
)
def _(t: Tables):
    # The fixed part of some teams leaves no room for a finding.
    large = F.col("team_id").cast("int") % 7 == 0
    fixed = t.settings.select("team_id", F.when(large, 24_560).otherwise(1_000).alias("fixed_bytes"))
    return report.summarize_within_budget(t.findings, fixed)


@query(
    "evidence_page",
    """
    select * from (
      select cast(o_custkey % 25 as varchar) as run_id, o_orderkey * 10 as item_id,
        row_number() over (partition by o_custkey % 25 order by o_orderkey) as position,
        count(*) over (partition by o_custkey % 25) as total,
        case when count(*) over (partition by o_custkey % 25) > 90 then cast(90 as bigint) end as next_cursor
      from orders where o_orderstatus = 'O')
    where position > 40 and position <= 90
    """,
)
def _(t: Tables):
    return report.evidence_page(t.evidence, cursor=40, limit=50)


@query(
    "merge_decisions",
    """
    select id, cast(log_order as bigint) as log_order, position, status, statement from (
      select *, row_number() over (partition by id order by log_order, position) as n from (
        select 'd' || conv_id as id, 0 as log_order, turn as position, role as status,
          text as statement from conversations where role = 'user'
        union all
        select 'd' || conv_id, 1, turn, role, text from conversations)) where n = 1
    """,
)
def _(t: Tables):
    return report.merge_decisions(*t.decision_logs)


@query(
    "replay_diff",
    """
    select run_id, cast(sum(greatest(balance, 0)) as bigint) as only_stored,
      cast(sum(greatest(-balance, 0)) as bigint) as only_recomputed, max(abs(balance)) = 0 as identical
    from (
      select run_id, item_id, value, sum(side) as balance from (
        select cast(l_suppkey as varchar) as run_id, l_orderkey as item_id,
          cast(l_quantity as bigint) as value, 1 as side from lineitem
        union all
        select cast(l_suppkey as varchar), l_orderkey, cast(l_quantity as bigint)
          + case when l_returnflag = 'R' and l_tax = 0.08 and l_discount = 0.1 then 1 else 0 end, -1
        from lineitem) group by all)
    group by run_id
    """,
)
def _(t: Tables):
    return report.replay_diff(*t.replay_pair)


@query(
    "minimize_evidence",
    with_views(
        r"""
        select item_id, team_id, state, state_category, assigned_to,
          case when length(title) <= 80 then title else substr(title, 1, 79) || '…' end as title_excerpt,
          cast(cast(remaining as decimal(18,4)) as varchar) as remaining_value,
          case when remaining is not null then 'hours' end as remaining_unit
        from (select c.*, trim(regexp_replace(p_name || chr(10) || repeat(p_name || ' ', 8), '[\x00-\x1f\x7f]',
            ' ', 'g')) as title
          from children c join lineitem l on l.l_orderkey * 10 + l.l_linenumber = c.item_id
            join part on p_partkey = l.l_partkey
          where l.l_partkey = (select min(m.l_partkey) from lineitem m
            where m.l_orderkey = l.l_orderkey and m.l_linenumber = l.l_linenumber)
          qualify row_number() over (partition by c.item_id order by p_name) = 1)
        """,
        "children",
    ),
)
def _(t: Tables):
    """Items titled after the part of their first arrival, which has the lowest part key."""
    part = t.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lowest = (
        t.read("lineitem")
        .groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"))
        .agg(F.min("l_partkey").alias("l_partkey"))
        .join(part, "l_partkey")
        .select(
            "item_id",
            F.concat("p_name", F.lit("\n"), F.repeat(F.concat("p_name", F.lit(" ")), F.lit(8))).alias(
                "title"
            ),
        )
    )
    record = report.minimize_evidence(t.children.join(lowest, "item_id"))
    return record.select(
        "item_id", F.get("team_memberships", 0).alias("team_id"), "state", "state_category",
        "assigned_to", "title_excerpt", F.col("remaining.value").alias("remaining_value"),
        F.col("remaining.unit").alias("remaining_unit"),
    )


# -- claims -------------------------------------------------------------------


def _run_metrics(t: Tables):
    return team_metrics(t).withColumnRenamed("team_id", "run_id")


_CANON = r"""
  regexp_replace(case when contains(raw, '.') then regexp_replace(raw, '\.?0+$', '') else raw end,
    '^(-?)0+([0-9])', '\1\2')
"""
# Ratios are compared after rounding to six decimals, which is how the oracle states them.
_NUMBERS = (
    METRICS_SQL
    + f""",
    people_rows as ({PERSON_LOAD_SQL}),
    evidence as (
      select cast(o_custkey % 25 as varchar) as run_id, o_orderkey * 10 as item_id
      from orders where o_orderstatus = 'O'),
    decimals as (
      select team_id as run_id, unnest([value, ratio, ratio * 100, round_even(ratio * 100, 0),
        round_even(ratio * 100, 1), coverage_eligible, coverage_known, missing, invalid, excluded]) as x
      from metrics
      union all
      select team_id, unnest([load_value, capacity_value, ratio, ratio * 100,
        round_even(ratio * 100, 0), round_even(ratio * 100, 1), eligible, known, missing])
      from people_rows),
    numbers as (
      select distinct run_id, {_CANON} as number from (
        select run_id, cast(cast(x as decimal(28,6)) as varchar) as raw from decimals where x is not null
        union all select run_id, cast(item_id as varchar) from evidence
        union all select team_id, cast(item_id as varchar) from findings))
    """
)


def _with_findings(sql: str) -> str:
    body = VIEWS["findings"][1]
    whole = VIEWS["accountable"][1]
    return sql.replace(
        "people_rows as (", f"findings as (with accountable as ({whole}) {body}), people_rows as (", 1
    )


@query(
    "allowed_numbers",
    _with_findings(_NUMBERS)
    + """
    select distinct run_id, """
    + _CANON
    + """ as number from (
      select run_id, cast(cast(cast(number as decimal(28,6)) as decimal(28,4)) as varchar) as raw from numbers)
    """,
)
def _(t: Tables):
    """Every number of every run, its decimals to the fourth: the oracle's ratios have six."""
    four = F.round(F.col("number").cast("decimal(38,14)"), 4).cast("string")
    return (
        t.outputs.numbers()
        .select("run_id", claims.canonical_number(four).alias("number"))
        .distinct()
    )


def _verdicts(t: Tables):
    patterns = F.array(*[F.lit(pattern) for pattern in BANNED])
    banned = t.spark.range(1).select(F.explode(patterns).alias("pattern"))
    return t.outputs.verdicts(t.claims, banned)


_CLAIMS = (
    _with_findings(_NUMBERS)
    + r""",
    claims as (
      select substr(source, 4) as run_id, case when n_chars % 2 = 0 then 'action' else 'hypothesis' end as kind,
        doc_id as position, trim(coalesce(text, ''), ' ') as statement, lang,
        n_chars % 3 > 0 as has_condition
      from documents),
    spoken as (
      select run_id, position, unnest(regexp_extract_all(statement, '\p{Nd}+(?:[.,]\p{Nd}+)?')) as token
      from claims),
    unsupported as (
      select distinct run_id, position from (
        select run_id, position, """
    + _CANON.replace("raw", "replace(token, ',', '.')")
    + r""" as number from spoken)
      anti join numbers using (run_id, number)),
    judged as (
      select c.*, case when statement = '' then 'empty'
          when regexp_matches(statement, '(?i)\bthe\b|proves that') then 'banned_wording'
          when lang = 'fr' then 'no_reference'
          when lang = 'es' then 'unknown_reference'
          when c.run_id not in (select team_id from settings) then 'unknown_reference'
          when lang = 'de' and not exists (select 1 from evidence e where e.run_id = c.run_id
            and e.item_id = c.position * 10) then 'unknown_reference'
          when u.position is not null then 'unsupported_number'
          when kind = 'action' and not has_condition then 'no_condition' end as own
      from claims c left join unsupported u on u.run_id = c.run_id and u.position = c.position),
    verdicts as (
      select run_id, kind, position, lang, case when own is null and kind = 'action' and
          count(*) filter (where own is null and kind = 'action') over (partition by run_id
            order by position) > 3 then 'action_limit' else own end as reason
      from judged)
    """
)


@query(
    "validate_claims",
    _CLAIMS + "select run_id, kind, position, reason is null as accepted, reason from verdicts",
)
def _(t: Tables):
    return _verdicts(t)


@query(
    "accepted_references",
    _CLAIMS
    + """
    select distinct run_id, unnest(case lang when 'en' then ['known_remaining_work']
        else ['open_items_count', 'evidence/items/' || position * 10 || '.json'] end) as reference,
      unnest(case lang when 'en' then [null] else [null, position * 10] end) as item_id,
      unnest(case lang when 'en' then [true] else [true, false] end) as is_metric
    from verdicts where reason is null
    """,
)
def _(t: Tables):
    return claims.accepted_references(t.claims, _verdicts(t))


# -- runs ---------------------------------------------------------------------

VIEWS["runs"] = (
    (),
    """
    select strftime(day, '%Y%m%d') || '-' || user_id as run_id, cast(user_id as varchar) as team_id,
      epoch_us(last_ts) as as_of, case when failed then 'partial' else 'complete' end as state, day
    from (select user_id, cast(ts as date) as day, max(ts) as last_ts,
            bool_or(event_type = 'error') as failed from events group by all)
    """,
)
_ROW_HASH = """
  select run_id, sha2 as h from (
    select strftime(ts, '%Y%m%d') || '-' || user_id as run_id, sha256('{"item_id":' || event_id
      || ',"metric_id":"' || event_type || '","value":'
      || coalesce('"' || cast(cast(value as decimal(18,4)) as varchar) || '"', 'null') || '}') as sha2
    from events)
"""
_FINGERPRINT = (
    f"""
    select run_id, 'sha256:' || sha256(concat_ws('|', cast(count(*) as varchar), """
    + ", ".join(
        f"cast(sum(cast('0x' || substr(h, {at}, 15) as bigint)) as varchar)" for at in (1, 16, 31, 46)
    )
    + f""")) as fingerprint
    from ({_ROW_HASH}) group by run_id
    """
)


@query("artifact_fingerprint", _FINGERPRINT)
def _(t: Tables):
    return runs.artifact_fingerprint(t.run_values, ["run_id"])


@query(
    "divergent_artifacts",
    """
    select strftime(ts, '%Y%m%d') || '-' || user_id as run_id,
      case when bool_and(event_type = 'error') then 'missing' else 'changed' end as problem
    from events group by 1 having bool_or(event_type = 'error')
    """,
)
def _(t: Tables):
    """Runs whose values no longer match once error events are left out."""
    stored = runs.artifact_fingerprint(t.run_values, ["run_id"])
    now = runs.artifact_fingerprint(t.run_values.where("metric_id <> 'error'"), ["run_id"])
    return runs.divergent_artifacts(stored, now, ["run_id"])


@query(
    "append_snapshot",
    """
    select strftime(ts, '%Y%m%d') || '-' || user_id as run_id, event_type as metric_id, event_id as item_id,
      cast(cast(value as decimal(18,4)) as varchar) as value,
      'sha256:' || substr(sha256('org|' || user_id), 1, 32) as source_identity
    from events
    """,
)
def append_snapshot(t: Tables):
    """Store every run with its values in the shared folder and read them back."""
    root = f"{shared_folder(t.spark)}/snapshots-{uuid.uuid4().hex}"
    manifest = t.runs.withColumn(
        "source_identity", runs.source_identity(F.lit("org"), F.col("team_id"))
    )
    sinks.append_snapshot(manifest, {"values": t.run_values}, root)
    known = sinks.read_runs(t.spark, root).select("run_id", "source_identity")
    return sinks.read_artifact(t.spark, root, "values").join(known, "run_id").select(
        "run_id", "metric_id", "item_id", "value", "source_identity"
    )


@query(
    "remove_runs",
    with_views(
        """
        select r.run_id, event_type as metric_id, event_id as item_id,
          cast(cast(value as decimal(18,4)) as varchar) as value
        from events e join runs r on r.run_id = strftime(e.ts, '%Y%m%d') || '-' || e.user_id
        where as_of >= epoch_us(timestamp '2024-01-31 12:00:00' - interval 15 day)
        """,
        "runs",
    ),
)
def _(t: Tables):
    """Store the runs in a batch per state, let the older ones expire, and read what is left."""
    root = f"{shared_folder(t.spark)}/expiring-{uuid.uuid4().hex}"
    manifest = t.runs.withColumn("partial_reasons", F.array().cast("array<string>"))
    for state in ("complete", "partial"):
        batch = manifest.where(F.col("state") == state)
        values = t.run_values.join(batch.select("run_id"), "run_id", "left_semi")
        sinks.append_snapshot(batch, {"values": values}, root)
    expired = runs.expired_runs(sinks.read_runs(t.spark, root), NOW, retention_days=15)
    sinks.remove_runs(t.spark, root, expired, ["values"])
    return sinks.read_artifact(t.spark, root, "values")


@query(
    "write_report",
    METRICS_SQL
    + "select team_id as run_id, metric_id, status, known, missing from metrics",
)
def _(t: Tables):
    """Write the metrics artifact as JSON by run and read it back."""
    root = f"{shared_folder(t.spark)}/report-{uuid.uuid4().hex}"
    metrics = _run_metrics(t).select("run_id", "metric_id", "status", "known", "missing")
    sinks.write_report({"metrics": metrics}, root)
    schema = "run_id string, metric_id string, status string, known bigint, missing bigint"
    return t.spark.read.schema(schema).json(f"{root}/metrics").drop("attempt")


@query(
    "run_state",
    METRICS_SQL
    + """
    select team_id as run_id, case when count(reason) > 0 then 'partial' else 'complete' end as state,
      coalesce(string_agg(distinct reason, ',' order by reason), '') as partial_reasons
    from (
      select team_id, case when status in ('partial', 'unavailable') then 'metric:' || metric_id end as reason
      from metrics
      union all select team_id, 'capacity' from settings where capacity_is_partial)
    group by team_id
    """,
)
def _(t: Tables):
    sources = t.settings.select(
        F.col("team_id").alias("run_id"), F.explode("partial_sources").alias("source")
    )
    return runs.run_state(_run_metrics(t), sources)


@query(
    "latest_run",
    with_views(
        """
        select team_id, run_id, as_of, state from (
          select *, row_number() over (partition by team_id order by as_of desc, run_id desc) as n from runs)
        where n = 1
        """,
        "runs",
    ),
)
def _(t: Tables):
    return runs.latest_run(t.runs).select("team_id", "run_id", "as_of", "state")


@query(
    "expired_runs",
    with_views(
        "select run_id, as_of from runs where as_of < epoch_us(timestamp '2024-01-31 12:00:00' - interval 15 day)",
        "runs",
    ),
)
def _(t: Tables):
    return runs.expired_runs(t.runs, NOW, retention_days=15).select("run_id", "as_of")


@query(
    "pending_runs",
    with_views(
        """
        select run_id, substr(sha256('cfg|' || team_id || '|current|' || strftime(day, '%Y-%m-%d')), 1, 32)
          as schedule_key
        from runs where state = 'partial'
        """,
        "runs",
    ),
)
def _(t: Tables):
    """Every run is planned; complete ones left a success marker."""
    planned = t.runs.select(
        "run_id", "team_id", F.lit("cfg").alias("config_hash"),
        F.lit(None).cast("string").alias("window"), "day", "state",
    )
    done = planned.where("state = 'complete'").select(
        runs.schedule_key(F.col("config_hash"), F.col("team_id"), F.col("window"), F.col("day")).alias(
            "schedule_key"
        )
    )
    return runs.pending_runs(planned, done).select("run_id", "schedule_key")


@query(
    "run_state_changes",
    with_views(
        """
        select * from (
          select team_id as schedule_key, run_id, as_of as finished_at, state,
            lag(state) over (partition by team_id order by as_of, run_id) as previous_state from runs)
        where state is distinct from previous_state
        """,
        "runs",
    ),
)
def _(t: Tables):
    finished = t.runs.select(
        F.col("team_id").alias("schedule_key"), "run_id", F.col("as_of").alias("finished_at"), "state"
    )
    return runs.run_state_changes(finished)


@query(
    "report_freshness",
    with_views(
        """
        select team_id, run_id, as_of, state, age // 3600000000 as age_hours,
          age > 26 * 3600000000 as is_stale
        from (select *, epoch_us(timestamp '2024-01-31 12:00:00') - as_of as age,
                row_number() over (partition by team_id order by as_of desc, run_id desc) as n from runs)
        where n = 1
        """,
        "runs",
    ),
)
def _(t: Tables):
    return runs.report_freshness(t.runs, NOW)


@query("teams_with_runs", with_views("select distinct team_id from runs", "runs"))
def _(t: Tables):
    return runs.teams_with_runs(t.runs)


@query(
    "authorized_reports",
    with_views(
        """
        select run_id, team_id from runs
        where team_id in (select cast(s_suppkey as varchar) from supplier where s_nationkey = 3)
        """,
        "runs",
    ),
)
def _(t: Tables):
    """Each nation is a principal, granted the teams its suppliers number."""
    grants = t.read("supplier").select(
        F.concat(F.lit("nation-"), "s_nationkey").alias("principal"),
        F.col("s_suppkey").cast("string").alias("team_id"),
    )
    return runs.authorized_reports(t.runs, grants, "nation-3").select("run_id", "team_id")
