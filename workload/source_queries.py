"""Landed JSON, team configuration, identity and cross-team queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.functions.json import as_text, fields_of, member
from plumbline.operators import cross_team
from plumbline.operators.calendar import eligible_day_factors
from plumbline.session import shared_folder
from plumbline.sources import landed, scope
from workload.bindings import Tables
from workload.catalog import query
from workload.views import LOAD_TALLIES, VIEWS, with_views

VIEWS["landed_items"] = (
    ("settings",),
    """
    select l_orderkey * 10 + l_linenumber as item_id, cast(s_nationkey as varchar) as team_id,
      n_regionkey, l_orderkey * 10 as parent_id, l_partkey, l_suppkey,
      case when l_returnflag <> 'A' then l_linestatus || l_returnflag else 'unknown' end as state,
      case l_returnflag when 'N' then 'Supplier <sup' || l_suppkey || '@org>'
        when 'R' then 'SUP' || l_suppkey || '@ORG' end as assigned_to,
      case when l_discount <> 0 then l_quantity end as remaining,
      case when n_regionkey = 0 and l_tax > 0.02 then l_quantity end as original_estimate,
      case when n_regionkey <> 1 then l_tax > 0 and l_returnflag = 'R' end as blocked,
      cast(l_shipdate as date) as target_date,
      case when allocates and l_discount = 0 then 'missing_remaining_work' else '' end as reasons
    from lineitem join supplier on l_suppkey = s_suppkey
    join settings on team_id = cast(s_nationkey as varchar)
    where l_tax <> 0.08
    """,
)


_LANDED_ID = "case when l_tax <> 0.08 then cast(l_orderkey * 10 + l_linenumber as varchar) end"


@query(
    "read_landed_payloads",
    f"""
    select cast(s_nationkey as varchar) as team_id, 'line' as landed,
      case when l_tax <> 0.06 then cast(0 as bigint) end as position, {_LANDED_ID} as record_id,
      case when l_tax <> 0.06 then 'part ' || l_partkey end as title,
      case when l_tax = 0.06 then 'not_json' end as reason
    from lineitem join supplier on l_suppkey = s_suppkey
    union all
    select cast(n_nationkey as varchar), 'file', i, n_nationkey || '' || i, n_name, null
    from nation, (values (cast(0 as bigint)), (cast(2 as bigint))) p(i)
    """,
)
def read_landed_payloads(t: Tables):
    """Land item payloads as lines, some cut off, and a payload per team as a whole file; read
    both back: every record, and every payload that could not be read."""
    root = f"{shared_folder(t.spark)}/landed-{uuid.uuid4().hex}"
    cut_off = F.expr("substr(payload, 1, length(payload) - 1)")
    t.item_payloads.withColumn(
        "payload", F.when(F.col("tax") == 0.06, cut_off).otherwise(F.col("payload"))
    ).select("team_id", "payload").write.partitionBy("team_id").text(
        f"{root}/lines", compression="gzip"  # a twelfth of the plain text; many files, not split
    )
    document = """{{ "value": [\n  {{"id": "{0}0", "System.Title": "{1}"}},\n  "note",\n
      {{"id": "{0}2", "System.Title": "{1}"}}\n] }}"""
    team = F.col("n_nationkey").cast("string")
    before, between, after = document.format("\0", "\1").split("\0")
    t.read("nation").select(
        team.alias("team_id"),
        F.replace(
            F.concat(F.lit(before), team, F.lit(between), team, F.lit(after)),
            F.lit("\1"), F.col("n_name"),
        ).alias("payload"),
    ).write.partitionBy("team_id").text(f"{root}/files")

    def found(kind: str, **options):
        payloads = landed.read_landed_payloads(
            t.spark, f"{root}/{kind}s", context=["team_id"], **options
        )
        records = landed.payload_records(landed.well_formed_payloads(payloads), "workItems")
        named = F.coalesce(member(F.col("record"), "id"), member(F.col("record"), "workItemId"))
        # Staged: parsing a text looks at it several times, and each would parse the fields again.
        staged = records.withColumn("fields", fields_of(F.col("record"))).select(
            "team_id", "position", named.alias("raw_id"),
            member(F.col("fields"), "System.Title").alias("raw_title"),
        )
        read = staged.select(
            "team_id", F.lit(kind).alias("landed"), "position",
            as_text(F.col("raw_id")).alias("record_id"), as_text(F.col("raw_title")).alias("title"),
            F.lit(None).cast("string").alias("reason"),
        )
        told = r'"(?:id|workItemId)":"?([0-9]+)'
        bad = landed.malformed_payloads(payloads).select(
            "team_id", F.lit(kind).alias("landed"), F.lit(None).cast("int").alias("position"),
            F.nullif(F.regexp_extract("payload", told, 1), F.lit("")).alias("record_id"),
            F.lit(None).cast("string").alias("title"), "reason",
        )
        return read.unionByName(bad)

    return found("line").unionByName(found("file", whole_files=True))


@query(
    "normalize_work_items",
    with_views(
        """
        select item_id, team_id, 'Task' as item_type, state, 'part ' || l_partkey as title, assigned_to,
          remaining, 'hours' as remaining_unit, original_estimate, blocked,
          strftime(target_date, '%Y-%m-%d') as target_date, parent_id, reasons
        from landed_items
        """,
        "landed_items",
    ),
)
def _(t: Tables):
    return landed.normalize_work_items(t.item_payloads, t.settings).select(
        "item_id", "team_id", "item_type", "state", "title", "assigned_to", "remaining",
        "remaining_unit", "original_estimate", "blocked", "target_date", "parent_id", "reasons",
    )


@query(
    "map_state_category",
    with_views(
        """
        select item_id, team_id, state,
          case when state = 'ON' then 'in_progress' when state = 'OR' then 'proposed'
            when state in ('FN', 'FA') then 'completed' end as state_category,
          case when state = 'FR' then 'unmapped_state' end as state_reason
        from landed_items
        """,
        "landed_items",
    ),
)
def _(t: Tables):
    items = landed.normalize_work_items(t.item_payloads, t.settings)
    mapped = t.state_map.where("state <> 'FR'")  # one state stays unmapped
    return landed.map_state_category(items.select("item_id", "team_id", "state"), mapped)


@query(
    "derive_blocked",
    """
    select l_orderkey * 10 + l_linenumber as item_id, cast(s_nationkey as varchar) as team_id,
      case n_regionkey when 0 then l_linestatus || l_returnflag = 'OR'
        when 1 then null else l_tax > 0.03 end as blocked
    from lineitem join supplier on l_suppkey = s_suppkey join nation on n_nationkey = s_nationkey
    """,
)
def _(t: Tables):
    """Region 0 lists blocked states and the others name a tag."""
    items = t.tagged_children
    listed = t.settings.withColumn(
        "blocked_states",
        F.when(F.size("working_days") == 6, F.array(F.lit("OR"))).otherwise(F.col("blocked_states")),
    )
    return landed.derive_blocked(items, listed).select("item_id", "team_id", "blocked")


@query(
    "hierarchy_relations",
    """
    select distinct l_orderkey * 10 as parent_id, l_orderkey * 10 + l_linenumber as child_id,
      'hierarchy' as relation
    from lineitem join supplier on l_suppkey = s_suppkey where l_returnflag = 'N' or l_tax <> 0.08
    """,
)
def _(t: Tables):
    links = landed.iteration_links(t.link_payloads)
    items = landed.normalize_work_items(t.item_payloads, t.settings)
    return landed.hierarchy_relations(links, items).drop("organization")


@query(
    "batch_completeness",
    """
    select team_id, count(*) as requested, count(*) filter (where complete) as returned,
      count(*) filter (where not complete) as missing,
      case when count(*) filter (where not complete) > 0 then 'work_items' end as partial_source
    from (select cast(s_nationkey as varchar) as team_id, l_orderkey * 10 + l_linenumber as item_id,
            bool_or(l_tax <> 0.08) as complete
          from lineitem join supplier on l_suppkey = s_suppkey group by all)
    group by team_id
    """,
)
def _(t: Tables):
    links = landed.iteration_links(t.link_payloads)
    items = landed.normalize_work_items(t.item_payloads, t.settings)
    return landed.batch_completeness(links, items)


@query(
    "normalize_capacity",
    """
    select cast(s_nationkey as varchar) as team_id,
      case when s_acctbal >= 2000 then 'p' || s_suppkey else 'sup' || s_suppkey || '@org' end as person_id,
      'build' as activity, case when s_acctbal < 9000 then floor(s_acctbal / 1000) end as per_day,
      'hours' as unit
    from supplier where s_acctbal >= 1000
    """,
)
def _(t: Tables):
    return landed.normalize_capacity(landed.capacity_members(t.capacity_payloads), t.settings)


@query(
    "capacity_problems",
    """
    select distinct cast(s_nationkey as varchar) as team_id,
      case when s_acctbal < 0 then null when s_acctbal >= 2000 then 'p' || s_suppkey
        else 'sup' || s_suppkey || '@org' end as person_id, reason
    from supplier, lateral (values ('no_person_id', s_acctbal < 0),
      ('no_activity', s_acctbal >= 0 and s_acctbal < 1000), ('no_daily_capacity', s_acctbal >= 9000),
      ('undated_day_off', s_acctbal > 9500)) r(reason, holds)
    where holds
    """,
)
def _(t: Tables):
    return landed.capacity_problems(landed.capacity_members(t.capacity_payloads))


@query(
    "normalize_days_off",
    """
    select cast(s_nationkey as varchar) as team_id,
      case when s_acctbal >= 2000 then 'p' || s_suppkey else 'sup' || s_suppkey || '@org' end as person_id,
      strftime(date '1998-01-05' + cast(floor(s_acctbal / 1000) as int), '%Y-%m-%d') as start,
      strftime(date '1998-01-05' + cast(floor(s_acctbal / 1000) as int) + 1, '%Y-%m-%d') as "end",
      cast(null as double) as fraction
    from supplier where s_acctbal >= 0 and s_acctbal <= 9500
    union all
    select cast(s_nationkey as varchar), null, strftime(date '1998-01-05' + s_nationkey, '%Y-%m-%d'),
      strftime(date '1998-01-05' + s_nationkey + 1, '%Y-%m-%d'), null
    from supplier where s_acctbal < 5000
    """,
)
def _(t: Tables):
    members = landed.capacity_members(t.capacity_payloads)
    return landed.normalize_days_off(members, t.capacity_payloads)


_SHIFTED = "date '1998-01-05' + cast(floor(c_acctbal / 500) as int)"


@query(
    "normalize_iterations",
    f"""
    select cast(c_custkey as varchar) as team_id, path, iteration_id, cast(position as bigint) as position,
      strftime(start, '%Y-%m-%d') as start, strftime(finish, '%Y-%m-%d') as finish
    from customer, lateral (values ('P1', 'a', 0, date '1997-12-22', date '1998-01-04'),
      ('P2', null, 1, null, null), ('P3', 'c', 2, {_SHIFTED}, {_SHIFTED} + 13))
      i(path, iteration_id, position, start, finish)
    """,
)
def _(t: Tables):
    return landed.normalize_iterations(t.iteration_payloads).drop("arrival")


# Local date at as_of: Sao Paulo and New York are still on the day before.
VIEWS["chosen_iterations"] = (
    (),
    f"""
    select cast(c_custkey as varchar) as team_id, c_mktsegment,
      case c_mktsegment when 'BUILDING' then 'America/Sao_Paulo'
        when 'MACHINERY' then 'America/New_York' else 'UTC' end as timezone,
      {_SHIFTED} as start,
      (case when c_mktsegment = 'MACHINERY' then date '1998-01-05' else date '1998-01-06' end)
        between {_SHIFTED} and {_SHIFTED} + 13 as current
    from customer
    """,
)


@query(
    "select_iteration",
    with_views(
        """
        select team_id, timezone,
          case when c_mktsegment = 'AUTOMOBILE' then 'P2' when current then 'P3'
            when c_mktsegment = 'FURNITURE' then 'P9' end as iteration_path,
          case when c_mktsegment <> 'AUTOMOBILE' and current then 'c' end as iteration_id,
          case when c_mktsegment <> 'AUTOMOBILE' and current then strftime(start, '%Y-%m-%d') end as start,
          case when c_mktsegment <> 'AUTOMOBILE' and current then
            strftime(start + 13, '%Y-%m-%d') end as finish,
          case when c_mktsegment = 'AUTOMOBILE' or not current then 'iterations' end as partial_source
        from chosen_iterations
        """,
        "chosen_iterations",
    ),
)
def select_iteration(t: Tables):
    return scope.select_iteration(
        t.iteration_teams, landed.normalize_iterations(t.iteration_payloads)
    )


@query(
    "resolve_window",
    with_views(
        """
        select team_id, timezone, epoch_us(timezone(timezone, cast(start as timestamp))) as window_start,
          epoch_us(timezone(timezone, cast(start + 14 as timestamp))) as window_end
        from chosen_iterations where c_mktsegment <> 'AUTOMOBILE' and current
        """,
        "chosen_iterations",
    ),
)
def _(t: Tables):
    return scope.resolve_window(select_iteration(t))


@query(
    "normalize_revisions",
    """
    select cast(user_id % 25 as varchar) as team_id, user_id as item_id, event_id as revision,
      epoch_us(ts) as changed_at, event_type as state, 'S' || length(props) as iteration_path,
      'u' || user_id as assigned_to, value as story_points,
      case event_type when 'signup' then 'proposed' when 'purchase' then 'completed'
        else 'in_progress' end as state_category
    from events where event_type <> 'error'
    """,
)
def _(t: Tables):
    return landed.normalize_revisions(t.revision_payloads, t.settings, t.state_map).drop(
        "organization", "area_path", "remaining"
    )


@query(
    "discover_state_map",
    """
    select cast(c_custkey as varchar) as team_id, state, category as state_category from customer,
      lateral (values ('To Do', 'proposed'), ('Done', 'completed'),
        ('Doing', case c_mktsegment when 'MACHINERY' then 'resolved' when 'BUILDING' then null
          else 'in_progress' end)) s(state, category)
    where category is not null
    """,
)
def _(t: Tables):
    return scope.discover_state_map(t.type_definitions)


@query(
    "unmapped_states",
    """
    select cast(c_custkey as varchar) as team_id, cast(type_order as bigint) as type_order, 'Doing' as state, source from customer,
      lateral (values (0, case when c_mktsegment = 'BUILDING' then 'paused' end),
        (1, case when c_mktsegment <> 'MACHINERY' then 'unheard' end)) s(type_order, source)
    where source is not null
    """,
)
def _(t: Tables):
    return scope.unmapped_states(t.type_definitions)


@query(
    "discover_fields",
    """
    select cast(c_custkey as varchar) as team_id, setting, 'Microsoft.VSTS.Scheduling.' || suffix as field
    from customer, lateral (values ('remaining_field', 'RemainingWork', true),
      ('story_points_field', 'StoryPoints', c_acctbal > 0)) s(setting, suffix, present) where present
    """,
)
def _(t: Tables):
    return scope.discover_fields(t.type_definitions)


@query(
    "discover_team_scope",
    """
    select cast(c_custkey as varchar) as team_id,
      case when c_mktsegment = 'FURNITURE' then '' else 'area,area-' || c_mktsegment end as area_paths,
      case when c_mktsegment not in ('FURNITURE', 'BUILDING') then c_acctbal > 5000 end
        as include_descendants,
      array_to_string(list_sort(list_distinct([0, 1, 2, 3, 4, (c_nationkey % 7 + 6) % 7])), ',')
        as working_days,
      case c_nationkey % 4 when 0 then 'excluded' when 1 then 'as_requirement' when 2 then 'as_task' end
        as bug_behavior
    from customer
    """,
)
def _(t: Tables):
    return scope.discover_team_scope(t.team_setting_payloads)


@query(
    "effective_settings",
    """
    select cast(c_custkey as varchar) as team_id, key, value, layer from customer, lateral (values
      ('allocation.unit', case when c_acctbal > 2000 then 'days' else 'hours' end,
        case when c_acctbal > 2000 then 'local' else 'default' end),
      ('calendar.timezone', c_mktsegment, 'team'),
      ('capabilities', case when c_acctbal > 6000 then 'flow_history' when c_acctbal > 4000
        then 'current_status' else 'current_status,allocation' end,
        case when c_acctbal > 6000 then 'run' when c_acctbal > 4000 then 'run_all' else 'profile' end)
    ) s(key, value, layer)
    """,
)
def _(t: Tables):
    return scope.effective_settings(t.setting_layers)


VIEWS["resolved_items"] = (
    ("landed_items",),
    """
    select i.team_id, i.item_id, i.assigned_to as raw,
      case when i.assigned_to is null then null when s_acctbal >= 2000 then 'p' || s_suppkey
        when s_acctbal >= 0 then 'sup' || s_suppkey || '@org' else i.assigned_to end as assigned_to,
      i.assigned_to is null or s_acctbal >= 0 as reconciled
    from landed_items i join supplier on s_suppkey = i.l_suppkey
    """,
)


def reconciled(t: Tables):
    items = landed.normalize_work_items(t.item_payloads, t.settings)
    people = landed.capacity_people(landed.capacity_members(t.capacity_payloads))
    return cross_team.reconcile_identity(items.select("team_id", "item_id", "assigned_to"), people)


@query(
    "reconcile_identity",
    with_views("select team_id, item_id, assigned_to, reconciled from resolved_items", "resolved_items"),
)
def _(t: Tables):
    return reconciled(t)


@query(
    "merge_people",
    with_views(
        """
        select cast(s_nationkey as varchar) as team_id,
          case when s_acctbal >= 2000 then 'p' || s_suppkey else 'sup' || s_suppkey || '@org' end
            as person_id, s_name as display_name, 'sup' || s_suppkey || '@org' as unique_name
        from supplier where s_acctbal >= 0
        union all
        select distinct team_id, assigned_to, null, null from resolved_items where not reconciled
        """,
        "resolved_items",
    ),
)
def _(t: Tables):
    people = landed.capacity_people(landed.capacity_members(t.capacity_payloads))
    return cross_team.merge_people(people, reconciled(t))


_SHARED = """
  shared_people as (
    select team_id, person_id from people
    union select cast((s_nationkey + 7) % 25 as varchar), cast(s_suppkey as varchar)
    from supplier where s_acctbal >= 3000),
  shared_factors as (
    select p.team_id, p.person_id, d.day,
      10000 - greatest(coalesce(t.share, 0), coalesce(o.share, 0)) as share
    from shared_people p join team_days d using (team_id)
    left join fractions t on t.team_id = p.team_id and t.person_id is null and t.day = d.day
    left join fractions o on o.team_id = p.team_id and o.person_id = p.person_id and o.day = d.day),
  team_factors as (
    select team_id, person_id, sum(share) as share from shared_factors group by all),
  shared_reservations as (
    select team_id, person_id, per_day, unit from reservations
    union all select cast((s_nationkey + 7) % 25 as varchar), cast(s_suppkey as varchar), 2, 'hours'
    from supplier where s_acctbal >= 3000),
  reserved as (
    select r.team_id, r.person_id, bool_and(unit = 'hours') as comparable,
      case when bool_and(unit = 'hours') and count(*) = count(per_day)
        then sum(per_day) * coalesce(max(f.share), 0) / 10000 end as reserved
    from shared_reservations r left join team_factors f using (team_id, person_id) group by all),
  loads as (
    select assigned_to as person_id, """ + LOAD_TALLIES + """ from accountable group by all),
  wide as (
    select p.person_id, count(*) as observed_teams, count(*) filter (where comparable) as reserving_teams,
      count(*) filter (where not comparable) as other_unit_teams, sum(reserved) as reserved_total
    from shared_people p left join reserved r using (team_id, person_id) group by p.person_id),
  available as (
    select person_id, sum(share) as share from (
      select person_id, day, max(share) as share from shared_factors group by all) group by all),
  rows as (
    select w.*, s.s_acctbal as balance, l.load_value, coalesce(l.eligible, 0) as eligible,
      coalesce(l.known, 0) as known, coalesce(l.missing, 0) as missing,
      (select count(*) from accountable a join (
          select item_id from raw_children group by item_id having count(*) > 1) d using (item_id)
        where a.assigned_to = w.person_id) as overlapping_items,
      case when s.s_acctbal >= 1000 and s.s_acctbal <= 9500
        then 8 * coalesce(v.share, 0) / 10000.0::double end as availability
    from wide w join supplier s on cast(s.s_suppkey as varchar) = w.person_id
    left join loads l using (person_id) left join available v using (person_id))
"""


def _consolidated(t: Tables):
    factors = eligible_day_factors(t.calendars, t.shared_people, t.days_off)
    overlapping = t.children
    items = overlapping.unionByName(
        t.parents.withColumn("overlapping", F.lit(False)), allowMissingColumns=True
    )
    from plumbline.operators.load import accountable_items

    return cross_team.consolidate_person(
        t.shared_people,
        t.shared_reservations,
        factors,
        accountable_items(items, t.relations, t.settings),
        t.declared_availability,
        "hours",
    )


_CONSOLIDATED = (
    with_views("", "team_days", "fractions", "people", "reservations", "accountable", "raw_children")
    .rstrip()
    + ","
    + _SHARED
)
_FIT = "round(cast(load_value as double) / nullif(availability, 0), 6)"


@query(
    "consolidate_person",
    _CONSOLIDATED
    + f"""
    select person_id, observed_teams, reserving_teams, other_unit_teams,
      round(cast(reserved_total as double), 6) as reserved_total, availability,
      cast(load_value as double) as load_value, eligible, known, missing, overlapping_items,
      {_FIT} as utilization,
      coalesce(cast(reserved_total as double) > availability, false) as over_reserved,
      case when balance < 1000 then 'availability_not_declared' when balance > 9500 then 'unit_mismatch'
        when load_value is null then 'no_known_work' when availability = 0 then 'zero_availability'
        when known <> eligible then 'partial_ratio' end as reason
    from rows
    """,
)
def _(t: Tables):
    return _consolidated(t)


@query(
    "over_reserved",
    _CONSOLIDATED
    + """
    select person_id, coalesce(cast(reserved_total as double) > availability, false) as over_reserved
    from rows
    """,
)
def _(t: Tables):
    return _consolidated(t).select("person_id", "over_reserved")
