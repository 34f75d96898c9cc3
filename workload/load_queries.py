"""Calendar, capacity, load and metric queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.operators import calendar as cal
from plumbline.operators import load, quality
from plumbline.operators.cross_team import deduplicate_items
from plumbline.session import shared_folder
from plumbline.sources import arrivals
from workload.bindings import Tables
from workload.catalog import query
from workload.views import (
    LOAD_BOUND,
    LOAD_CLASS,
    LOAD_RATIO,
    LOAD_REASON,
    LOAD_TALLIES,
    with_views,
)


_DEDUPLICATED = with_views(
    """
    select c.item_id, c.team_id, c.state_category, c.assigned_to,
      cast(c.remaining as double) as remaining, strftime(c.target_date, '%Y-%m-%d') as target_date,
      m.team_memberships, m.arrivals > 1 as overlapping
    from children c join (
      select item_id, sum(n) as arrivals, string_agg(team_id, ',' order by seen) as team_memberships
      from (select item_id, team_id, count(*) as n, min(arrival) as seen
            from raw_children group by all) group by item_id) m using (item_id)
    """,
    "children",
)
_ITEM_COLUMNS = (
    "item_id", "team_id", "state_category", "assigned_to", "remaining", "target_date",
    "team_memberships", "overlapping",
)


@query("deduplicate_items", _DEDUPLICATED)
def _(t: Tables):
    return deduplicate_items(t.raw_children, t.ARRIVAL).select(*_ITEM_COLUMNS)


@query("deduplicate_batches", _DEDUPLICATED)
def _(t: Tables):
    """All items in three batches, one of them delivered twice, by the stored state."""
    root = f"{shared_folder(t.spark)}/arrivals-{uuid.uuid4().hex}"
    known = F.coalesce("state_category", F.lit("none"))
    batches = {
        "open": t.raw_children.where(known.isin("in_progress", "proposed")),
        "completed": t.raw_children.where(known == "completed"),
        "none": t.raw_children.where(known == "none"),
    }
    for name in ("completed", "open", "completed", "none"):
        arrivals.add_batch(batches[name], t.ARRIVAL, name, root, most_parts=2)
    return arrivals.read_items(t.spark, root).select(*_ITEM_COLUMNS)


@query(
    "accountable_items",
    with_views("select item_id, team_id, state_category from accountable", "accountable"),
)
def _(t: Tables):
    return t.accountable.select("item_id", "team_id", "state_category")


@query(
    "open_items",
    with_views(
        """
        select item_id, team_id, state_category from accountable
        where state_category in ('in_progress', 'proposed', 'resolved')
        """,
        "accountable",
    ),
)
def _(t: Tables):
    return load.open_items(t.accountable).select("item_id", "team_id", "state_category")


@query(
    "working_days",
    with_views(
        """
        select team_id, strftime(day, '%Y-%m-%d') as day from window_days
        where isodow(day) - 1 <= last_weekday
        """,
        "window_days",
    ),
)
def _(t: Tables):
    return cal.working_days(t.calendars)


@query(
    "day_off_fractions",
    with_views(
        """
        select team_id, person_id, strftime(day, '%Y-%m-%d') as day, share / 10000.0::double as fraction
        from fractions
        """,
        "fractions",
    ),
)
def _(t: Tables):
    return cal.day_off_fractions(t.days_off)


@query(
    "eligible_day_factors",
    with_views(
        """
        select team_id, person_id, strftime(day, '%Y-%m-%d') as day, share / 10000.0::double as factor
        from factors
        """,
        "factors",
    ),
)
def _(t: Tables):
    return cal.eligible_day_factors(t.calendars, t.people, t.days_off)


@query(
    "reserved_capacity",
    with_views(
        """
        select team_id, person_id, capacity_unit,
          round(cast(capacity_value as double), 6) as capacity_value
        from capacities
        """,
        "capacities",
    ),
)
def _(t: Tables):
    return t.capacities


_TEAM_CAPACITY = """
  team_cap as (
    select s.team_id, count(p.person_id) as eligible, count(c.capacity_value) as known,
      sum(c.capacity_value) as capacity_value
    from settings s
    left join (select distinct team_id, person_id from reservations) p using (team_id)
    left join capacities c on c.team_id = p.team_id and c.person_id = p.person_id
      and c.capacity_unit = s.unit
    group by s.team_id)
"""


@query(
    "team_capacity",
    with_views("", "settings", "capacities").rstrip()
    + ","
    + _TEAM_CAPACITY
    + """
    select team_id, 'hours' as capacity_unit, round(cast(capacity_value as double), 6) as capacity_value,
      eligible, known, eligible - known as missing from team_cap
    """,
)
def _(t: Tables):
    return cal.team_capacity(t.settings, t.reservations, t.capacities)


_DAY_KIND = """
  select d.team_id, d.day, d.day = d.today as is_today,
    case when isodow(d.day) - 1 > d.last_weekday then 'non_working'
      when d.day = d.blocked_day or f.day is not null then 'off'
      when d.day < d.today then 'past' when d.day = d.today then 'today' else 'eligible' end as kind
  from window_days d left join fractions f
    on f.team_id = d.team_id and f.person_id is null and f.day = d.day
"""


@query(
    "day_strip",
    with_views(
        f"select team_id, strftime(day, '%Y-%m-%d') as day, kind, is_today from ({_DAY_KIND})",
        "window_days", "fractions",
    ),
)
def _(t: Tables):
    return cal.day_strip(t.calendars, t.days_off)


@query(
    "day_strip_totals",
    with_views(
        f"""
        select c.team_id,
          (select count(*) from ({_DAY_KIND}) k where k.team_id = c.team_id and kind = 'eligible')
            as remaining_days,
          (select count(*) from fractions f where f.team_id = c.team_id and f.person_id is not null
            and f.day >= c.first_day and f.day < c.end_day) as personal_days_off
        from calendars c
        """,
        "window_days", "fractions",
    ),
)
def _(t: Tables):
    return cal.day_strip_totals(t.calendars, t.days_off)


@query(
    "known_load",
    with_views(
        f"""
        select team_id, assigned_to, 'hours' as load_unit, cast(load_value as double) as load_value,
          eligible, known, missing, invalid, excluded
        from (select team_id, assigned_to, {LOAD_TALLIES} from accountable group by all)
        """,
        "accountable",
    ),
)
def _(t: Tables):
    return load.known_load(t.accountable, t.settings, ["team_id", "assigned_to"])


@query(
    "load_findings",
    with_views(
        """
        select team_id, item_id, rule_id || ':' || item_id as finding_id, rule_id,
          'attention' as severity
        from (select *, case when state_category is null then 'unmapped_state'
            when state_category in ('completed', 'removed') and remaining > 0
              then 'completed_with_remaining_work'
            when state_category not in ('completed', 'removed') and remaining < 0
              then 'negative_remaining_work' end as rule_id from accountable)
        where rule_id is not null
        """,
        "accountable",
    ),
)
def _(t: Tables):
    return load.load_findings(t.accountable, t.settings).drop("organization")


_PERSON_PAIRS = f"""
  pairs as (
    select p.team_id, p.person_id, p.display_name, l.load_value as load, c.capacity_value as cap,
      coalesce(l.eligible, 0) as eligible, coalesce(l.known, 0) as known,
      coalesce(l.missing, 0) as missing, s.below, s.within, s.attention
    from people p join settings s using (team_id)
    left join (select team_id, assigned_to, {LOAD_TALLIES} from {{source}} group by all) l
      on l.team_id = p.team_id and l.assigned_to = p.person_id
    left join capacities c on c.team_id = p.team_id and c.person_id = p.person_id
      and c.capacity_unit = 'hours')
"""
_PERSON_ROWS = f"""
    select team_id, person_id, display_name, cast(load as double) as load_value, 'hours' as load_unit,
      round(cast(cap as double), 6) as capacity_value, {LOAD_RATIO} as ratio,
      {LOAD_CLASS} as load_class, {LOAD_BOUND} as is_lower_bound, eligible, known, missing,
      {LOAD_REASON} as reason
    from pairs
"""
PERSON_LOAD_SQL = (
    with_views("", "sprint_accountable", "capacities", "settings").rstrip()
    + ","
    + _PERSON_PAIRS.format(source="sprint_accountable")
    + _PERSON_ROWS
    + f"""
    union all
    select team_id, '(unassigned)', null, cast(load_value as double), 'hours', null, null, 'UNASSIGNED',
      false, eligible, known, missing, 'no_assignee'
    from (select team_id, {LOAD_TALLIES} from sprint_accountable where assigned_to is null
      group by all) where eligible > 0
    """
)


def person_load(t: Tables):
    return load.person_load(t.people, t.sprint_accountable, t.settings, t.capacities)


query("person_load", PERSON_LOAD_SQL)(person_load)


@query(
    "classify_load",
    with_views("", "accountable", "capacities", "settings").rstrip()
    + ","
    + _PERSON_PAIRS.format(source="accountable")
    + f"""
    select team_id, person_id, {LOAD_CLASS} as load_class, {LOAD_BOUND} as is_lower_bound,
      {LOAD_REASON} as reason, cast(load as double) as load_value from pairs
    """,
)
def _(t: Tables):
    rows = load.person_load(t.people, t.accountable, t.settings, t.capacities)
    return rows.where("load_class <> 'UNASSIGNED'").select(
        "team_id", "person_id", "load_class", "is_lower_bound", "reason", "load_value"
    )


@query(
    "open_items_count",
    with_views(
        """
        select team_id, count(*) filter (where state_category not in ('completed', 'removed')) as value,
          count(*) as eligible, count(*) as known from accountable group by team_id
        """,
        "accountable",
    ),
)
def _(t: Tables):
    return load.open_items_count(t.accountable)


@query(
    "blocked_items_count",
    with_views(
        """
        select team_id, count(*) filter (where blocked) as value, count(*) as eligible,
          count(blocked) as known, count(*) - count(blocked) as missing
        from accountable group by team_id
        """,
        "accountable",
    ),
)
def _(t: Tables):
    return load.blocked_items_count(t.accountable)


_TEAM_PAIRS = f"""
  tallies as (select team_id, {LOAD_TALLIES} from sprint_accountable group by team_id),
  pairs as (
    select s.*, l.load_value as load, c.capacity_value as cap, coalesce(l.eligible, 0) as eligible,
      coalesce(l.known, 0) as known, coalesce(l.missing, 0) as missing,
      coalesce(l.invalid, 0) as invalid, coalesce(l.excluded, 0) as excluded,
      c.eligible as cap_eligible, c.known as cap_known
    from settings s join team_cap c using (team_id) left join tallies l using (team_id))
"""
_TEAM_HEAD = (
    with_views("", "sprint_accountable", "capacities", "settings").rstrip()
    + ","
    + _TEAM_CAPACITY
    + ","
    + _TEAM_PAIRS
)


@query(
    "observed_utilization",
    _TEAM_HEAD
    + f"""
    select team_id,
      case when not allocates then 'not_applicable'
        when cap is null or {LOAD_RATIO} is null then 'unavailable'
        when known <> eligible then 'partial' else 'available' end as status,
      case when allocates then {LOAD_RATIO} end as ratio,
      case when not allocates then 'capability_not_enabled' when cap is null then 'capacity_unknown'
        when {LOAD_RATIO} is null then 'not_comparable' end as reason
    from pairs
    """,
)
def _(t: Tables):
    compared = quality.team_comparison(
        t.sprint_accountable, t.settings, t.reservations, t.capacities
    )
    return quality.observed_utilization(compared, t.settings)


def team_metrics(t: Tables):
    return quality.team_metrics(t.sprint_accountable, t.settings, t.reservations, t.capacities)


ASSESS_SQL = (
    _TEAM_HEAD
    + """,
    counts as (
      select team_id, count(*) as accountable,
        count(*) filter (where state_category not in ('completed', 'removed')) as open,
        count(blocked) as blocked_known, count(*) filter (where blocked) as blocked
      from sprint_accountable group by team_id),
    measured as (
      select p.*, m.metric_id, m.value, m.m_eligible, m.m_known, m.m_missing, m.m_invalid,
        m.m_excluded, m.unit as m_unit
      from pairs p left join counts c using (team_id), lateral (values
        ('open_items_count', cast(coalesce(c.open, 0) as double), coalesce(c.accountable, 0),
          coalesce(c.accountable, 0), 0, 0, 0, 'items'),
        ('blocked_items_count', cast(coalesce(c.blocked, 0) as double), coalesce(c.accountable, 0),
          coalesce(c.blocked_known, 0), coalesce(c.accountable, 0) - coalesce(c.blocked_known, 0),
          0, 0, 'items'),
        ('known_remaining_work', cast(p.load as double), p.eligible, p.known, p.missing, p.invalid,
          p.excluded, 'hours'),
        ('reserved_remaining_capacity', cast(p.cap as double), p.cap_eligible, p.cap_known,
          p.cap_eligible - p.cap_known, 0, 0, 'hours'),
        ('observed_utilization', cast(null as double), p.eligible, p.known, p.missing, p.invalid,
          p.excluded, cast(null as varchar))
      ) m(metric_id, value, m_eligible, m_known, m_missing, m_invalid, m_excluded, unit)),
    staged as (
      select *,
        case when not allocates and metric_id not in ('open_items_count', 'blocked_items_count')
            then 'capability_not_enabled'
          when metric_id = 'blocked_items_count' and not has_impediment_source
            then 'process_field_not_configured'
          when metric_id in ('reserved_remaining_capacity', 'observed_utilization')
            and cap_eligible = 0 then 'no_reserved_capacity' end as na,
        capacity_is_partial and metric_id in ('reserved_remaining_capacity', 'observed_utilization')
          as blocking,
        metric_id in ('open_items_count', 'blocked_items_count') as zero_ok
      from measured),
    graded as (
      select *, case when m_eligible = 0 and zero_ok then 'available'
        when m_eligible = 0 or m_known = 0 then 'unavailable'
        when m_known < m_eligible then 'partial' else 'available' end as own,
        case when m_eligible = 0 and not zero_ok then 'empty_eligible_sample'
          when m_eligible > 0 and m_known = 0 then 'no_valid_value' end as own_reason
      from staged),
    assessed as (
      select *, case when na is not null then 'not_applicable'
          when blocking and own = 'available' then
            case when m_known > 0 then 'partial' else 'unavailable' end
          else own end as status,
        coalesce(na, concat_ws(',', own_reason, case when blocking then 'partial_source' end)) as reasons
      from graded)
    """
)
METRICS_SQL = (
    ASSESS_SQL
    + f""",
    metrics as (
      select team_id, metric_id,
        case when metric_id <> 'observed_utilization' or na is not null then status
          when cap is null or {LOAD_RATIO} is null then 'unavailable'
          when known <> eligible then 'partial' else 'available' end as status,
        case when status in ('available', 'partial') then round(value, 6) end as value,
        case when status in ('available', 'partial') and value is not null then m_unit end as unit,
        case when metric_id = 'observed_utilization' and na is null then {LOAD_RATIO} end as ratio,
        case when na is null then m_eligible end as coverage_eligible,
        case when na is null then m_known else 0 end as coverage_known,
        case when na is null and m_eligible > 0 then
          round(cast(m_known as double) / m_eligible, 6) end as coverage_ratio,
        m_eligible as eligible, m_known as known, m_missing as missing, m_invalid as invalid,
        m_excluded as excluded,
        case when metric_id <> 'observed_utilization' or na is not null then reasons
          when cap is null then 'capacity_unknown' when {LOAD_RATIO} is null then 'not_comparable'
          else '' end as reasons
      from assessed)
    """
)
query("assess_metric", METRICS_SQL + "select * from metrics")(team_metrics)


@query(
    "limitations_rollup",
    METRICS_SQL
    + """
    select team_id, string_agg(distinct code, ',' order by code) as reasons from (
      select team_id, unnest(string_split(reasons, ',')) as code from metrics where reasons <> ''
      union all
      select team_id, 'source:capacity' from settings where capacity_is_partial)
    group by team_id
    """,
)
def _(t: Tables):
    reasons = team_metrics(t).select("team_id", F.explode("reasons").alias("reason"))
    sources = t.settings.select(
        "team_id", F.explode("partial_sources").alias("source")
    ).select("team_id", F.concat(F.lit("source:"), "source").alias("reason"))
    return quality.limitations_rollup(reasons, sources)
