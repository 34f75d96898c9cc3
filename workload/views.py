"""The logical tables of ``bindings.py`` as SQL views for the oracle queries."""

from __future__ import annotations

# name -> (views it reads, body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "settings": (
        (),
        """
        select cast(n_nationkey as varchar) as team_id, n_regionkey,
          n_regionkey <> 4 as allocates, 'hours' as unit,
          case n_regionkey when 0 then 'America/Sao_Paulo' when 1 then 'America/New_York'
            when 2 then 'Asia/Tokyo' else 'UTC' end as timezone,
          case when n_regionkey = 0 then 5 else 4 end as last_weekday,
          case n_regionkey when 1 then date '1998-01-08' when 3 then date '1998-01-12' end as blocked_day,
          n_regionkey = 2 as counts_today,
          cast(case when n_regionkey = 3 then 0.50 else 0.60 end as decimal(9,4)) as below,
          cast(case when n_regionkey = 3 then 0.80 else 0.90 end as decimal(9,4)) as within,
          cast(case when n_regionkey = 3 then 1.00 else 1.10 end as decimal(9,4)) as attention,
          n_regionkey <> 1 as has_impediment_source, n_regionkey = 3 as capacity_is_partial
        from nation
        """,
    ),
    "calendars": (
        ("settings",),
        """
        select s.*, date '1998-01-05' as first_day, date '1998-01-17' as end_day,
          cast(timezone(timezone, timezone('UTC', timestamp '1998-01-06 02:00:00')) as date) as today
        from settings s
        """,
    ),
    "raw_children": (
        (),
        """
        select l_orderkey * 10 + l_linenumber as item_id, cast(s_nationkey as varchar) as team_id,
          l_linestatus || l_returnflag as state,
          case when l_linestatus = 'F' then 'completed' when l_returnflag = 'N' then 'in_progress'
            when l_returnflag = 'R' then 'proposed' end as state_category,
          cast(l_suppkey as varchar) as assigned_to,
          case when l_discount = 0 then null when l_tax = 0 then -cast(l_quantity as decimal(18,4))
            else cast(l_quantity as decimal(18,4)) end as remaining,
          case when l_discount <> 0 then l_returnflag = 'R' end as blocked,
          cast(l_shipdate as date) as target_date, l_orderkey,
          row_number() over (partition by l_orderkey, l_linenumber
            order by l_partkey, l_suppkey, l_shipdate, l_extendedprice) as arrival
        from lineitem join supplier on l_suppkey = s_suppkey
        """,
    ),
    "children": (("raw_children",), "select * from raw_children where arrival = 1"),
    "parents": (
        (),
        """
        select o_orderkey * 10 as item_id, cast(o_custkey % 25 as varchar) as team_id,
          o_orderstatus as state,
          case o_orderstatus when 'F' then 'completed' when 'O' then 'in_progress'
            when 'P' then 'proposed' end as state_category,
          cast(null as varchar) as assigned_to,
          case when o_orderstatus <> 'P' then cast(floor(o_totalprice / 1000) as decimal(18,4)) end
            as remaining,
          cast(null as boolean) as blocked,
          cast(o_orderdate as date) + 30 as target_date
        from orders
        """,
    ),
    "items": (
        ("children", "parents"),
        """
        select item_id, team_id, state, state_category, assigned_to, remaining, blocked, target_date
        from children
        union all
        select item_id, team_id, state, state_category, assigned_to, remaining, blocked, target_date
        from parents
        """,
    ),
    "accountable": (
        ("items",),
        """
        select i.* from items i
        where i.team_id in (select cast(n_nationkey as varchar) from nation)
          and not exists (select 1 from lineitem l where l.l_orderkey * 10 = i.item_id)
        """,
    ),
    "sprint_accountable": (
        ("accountable",),
        """
        select * from accountable
        where target_date >= date '1998-01-05' and target_date < date '1998-01-17'
        """,
    ),
    "people": (
        (),
        """
        select cast(s_nationkey as varchar) as team_id, cast(s_suppkey as varchar) as person_id,
          s_name as display_name from supplier
        """,
    ),
    "reservations": (
        (),
        """
        select cast(s_nationkey as varchar) as team_id, cast(s_suppkey as varchar) as person_id,
          'build' as activity,
          case when s_acctbal >= 0 then cast(floor(s_acctbal / 1000) as decimal(18,4)) end as per_day,
          case when s_acctbal > 9000 then 'days' else 'hours' end as unit
        from supplier
        union all
        select cast(s_nationkey as varchar), cast(s_suppkey as varchar), 'review',
          cast(1 as decimal(18,4)), case when s_acctbal > 9000 then 'days' else 'hours' end
        from supplier where s_acctbal >= 5000
        """,
    ),
    "days_off": (
        (),
        """
        select cast(s_nationkey as varchar) as team_id, cast(user_id as varchar) as person_id,
          cast(ts as date) - 9496 as day,
          least(cast(cast(value as decimal(18,4)) * 100 as bigint), 10000) as share
        from events join supplier on user_id = s_suppkey where event_type = 'error'
        union all
        select cast(user_id % 25 as varchar), null, cast(ts as date) - 9496,
          case when value < 300 then 5000 else 10000 end
        from events where event_type = 'signup' and value >= 200
        """,
    ),
    # Shares are whole ten-thousandths of a day.
    "fractions": (
        ("days_off",),
        "select team_id, person_id, day, max(share) as share from days_off group by all",
    ),
    "window_days": (
        ("calendars",),
        """
        select c.*, cast(unnest(generate_series(first_day, end_day - 1, interval 1 day)) as date)
          as day from calendars c
        """,
    ),
    "team_days": (
        ("window_days",),
        """
        select * from window_days
        where isodow(day) - 1 <= last_weekday and day is distinct from blocked_day
          and day >= case when counts_today then today else today + 1 end
        """,
    ),
    "factors": (
        ("team_days", "fractions", "people"),
        """
        select p.team_id, p.person_id, d.day,
          10000 - greatest(coalesce(t.share, 0), coalesce(o.share, 0)) as share
        from people p join team_days d using (team_id)
        left join fractions t on t.team_id = p.team_id and t.person_id is null and t.day = d.day
        left join fractions o on o.team_id = p.team_id and o.person_id = p.person_id and o.day = d.day
        where 10000 - greatest(coalesce(t.share, 0), coalesce(o.share, 0)) > 0
        """,
    ),
    "capacities": (
        ("reservations", "factors"),
        """
        select r.team_id, r.person_id, r.unit as capacity_unit,
          case when count(*) = count(r.per_day) then
            sum(r.per_day) * max(coalesce(f.share, 0)) / 10000 end as capacity_value
        from reservations r left join
          (select team_id, person_id, sum(share) as share from factors group by all) f
          on f.team_id = r.team_id and f.person_id = r.person_id
        group by r.team_id, r.person_id, r.unit
        """,
    ),
    # Instants are microseconds since the epoch.
    "revisions": (
        (),
        """
        select user_id as item_id, cast(user_id % 25 as varchar) as team_id, event_id as revision,
          epoch_us(ts) as changed_at,
          case event_type when 'signup' then 'proposed' when 'view' then 'in_progress'
            when 'click' then 'in_progress' when 'purchase' then 'completed' end as state_category,
          case when cast(regexp_extract(props, '[0-9]+') as bigint) % 2 = 0 then 'S1' else 'S2' end
            as iteration_path,
          cast(value as decimal(18,4)) as story_points
        from events
        """,
    ),
    "windows": (
        (),
        """
        select cast(n_nationkey as varchar) as team_id,
          case when n_regionkey = 4 then 'S2' else 'S1' end as iteration_path,
          epoch_us(case when n_regionkey = 3 then timestamp '2024-01-09 12:00:00'
            else timestamp '2024-01-08' end) as commitment_at,
          epoch_us(timestamp '2024-01-08') as since, epoch_us(timestamp '2024-01-20') as until,
          n_regionkey <> 0 and n_nationkey in (select user_id % 25 from events) as complete
        from nation
        """,
    ),
    "usable": (
        ("revisions", "windows"),
        """
        select r.*, w.iteration_path as sprint, w.commitment_at, w.since, w.until,
          lag(state_category) over item as before_category,
          lag(r.iteration_path) over item as before_path,
          row_number() over item as pos
        from revisions r join windows w on w.team_id = r.team_id and w.complete
        window item as (partition by r.team_id, item_id order by changed_at, revision)
        """,
    ),
    "transitions": (
        ("usable",),
        """
        select *, row_number() over (partition by team_id, item_id order by changed_at, revision) as nth
        from usable where state_category = 'completed'
          and before_category is distinct from 'completed'
        """,
    ),
    "cohort": (
        ("usable", "transitions"),
        """
        select t.team_id, t.item_id, t.changed_at as completed_at,
          (select min(u.changed_at) from usable u where u.team_id = t.team_id
            and u.item_id = t.item_id and u.state_category = 'in_progress') as started_at,
          (select epoch_us(min(e.ts)) from events e where e.user_id = t.item_id) as created_at
        from transitions t where nth = 1 and t.changed_at between since and until
        """,
    ),
    "baseline": (
        ("usable",),
        """
        select * from (
          select *, row_number() over (partition by team_id, item_id
            order by changed_at desc, revision desc) as back
          from usable where changed_at <= commitment_at)
        where back = 1 and iteration_path = sprint
          and coalesce(state_category, '') not in ('completed', 'removed')
        """,
    ),
    "final_state": (
        ("usable",),
        """
        select * from (
          select *, row_number() over (partition by team_id, item_id
            order by changed_at desc, revision desc) as back
          from usable where changed_at <= until) where back = 1
        """,
    ),
    "outcomes": (
        ("baseline", "final_state"),
        """
        select b.team_id, b.item_id, b.story_points as committed, f.story_points as current,
          coalesce(f.state_category = 'completed', false) as completed,
          coalesce(f.story_points <> b.story_points, false) as changed
        from baseline b left join final_state f on f.team_id = b.team_id and f.item_id = b.item_id
        """,
    ),
    "scope_events": (
        ("usable",),
        """
        select team_id, item_id, changed_at, revision, iteration_path,
          case when iteration_path = sprint then 'entered' else 'exited' end as direction
        from usable where changed_at > commitment_at and changed_at <= until
          and (iteration_path = sprint) <> coalesce(before_path = sprint, false)
        """,
    ),
    "ages": (
        ("usable",),
        """
        select i.team_id, i.item_id, i.done,
          (select min(u.changed_at) from usable u where u.team_id = i.team_id
            and u.item_id = i.item_id and u.state_category = 'in_progress'
            and u.pos > coalesce(i.done, 0)) as started
        from (select team_id, item_id, max(pos) filter (where state_category = 'completed') as done,
                arg_max(coalesce(state_category, ''), pos) as category
              from usable group by all) i
        where i.category = 'in_progress'
        """,
    ),
    "planning_items": (
        ("children", "parents"),
        r"""
        select c.item_id, c.team_id, 'Task' as item_type, c.state_category, c.assigned_to, c.remaining,
          cast(o.o_orderdate as date) as start_date, c.target_date,
          'area\' || n.n_regionkey || '\' || substr(c.state, 1, 1) as area_path
        from children c left join orders o on o.o_orderkey = c.l_orderkey
        left join nation n on cast(n.n_nationkey as varchar) = c.team_id
        union all
        select item_id, team_id, 'Product Backlog Item', state_category, assigned_to, remaining,
          target_date - 30, target_date, 'area\' || ((cast(team_id as int) + 1) % 7)
        from parents
        """,
    ),
    "edges": (
        (),
        "select distinct l_orderkey * 10 as parent_id, l_orderkey * 10 + l_linenumber as child_id from lineitem",
    ),
    "planning_findings": (
        ("planning_items", "edges", "calendars"),
        r"""
        select f.* from (
          select i.team_id, i.item_id, c.n_regionkey as region, i.state_category in
              ('in_progress', 'proposed', 'resolved') as open, i.*, c.today,
            k.parent_id is not null as has_child, k.last_target
          from planning_items i join calendars c using (team_id)
          left join (select e.parent_id, max(p.target_date) as last_target from edges e
              left join planning_items p on p.item_id = e.child_id group by 1) k
            on k.parent_id = i.item_id) i,
        lateral (values
          ('inverted_dates', 'attention', start_date > target_date
            and not (region = 3 and item_id in (10, 21))),
          ('overdue_open_item', case when region = 3 then 'critical' else 'attention' end,
            region <> 2 and open and today - target_date > case when region = 3 then 30 else 0 end),
          ('parent_ends_before_children', 'attention', last_target > target_date),
          ('open_work_in_closed_sprint', 'attention', open and target_date < date '1997-06-01'),
          ('missing_required_fields', 'info', region = 4 and
            (coalesce(assigned_to, '') = '' or remaining is null)),
          ('story_without_task', 'high', region = 0 and item_type = 'Product Backlog Item'
            and not has_child),
          ('missing_estimate', 'info', region = 1 and open and remaining is null),
          ('area_or_iteration_mismatch', case when region = 1 then 'attention' else 'info' end,
            region < 3 and not (area_path = 'area\' || region
              or (region <> 2 and starts_with(area_path, 'area\' || region || '\'))))
        ) r(rule_id, severity, fires),
        lateral (select i.team_id, i.item_id, r.rule_id || ':' || i.item_id as finding_id, r.rule_id,
          '1.0' as rule_version, r.severity) f
        where coalesce(r.fires, false)
        """,
    ),
}


def half_even_days(start: str, end: str) -> str:
    """Days between two microsecond instants with two decimals, ties to even."""
    micros = f"({end} - {start})"
    unit = 864000000
    rest = f"((({micros} % {unit}) + {unit}) % {unit})"
    whole = f"(({micros} - {rest}) // {unit})"
    carry = (
        f"case when {rest} > {unit // 2} or ({rest} = {unit // 2} and {whole} % 2 <> 0) "
        "then 1 else 0 end"
    )
    return f"({whole} + {carry}) / 100.0::double"


# Tallies of a load, over rows that carry state_category and remaining.
LOAD_TALLIES = """
  sum(case when state_category in ('in_progress', 'proposed', 'resolved') and remaining >= 0
    then remaining end) as load_value,
  count(*) filter (where state_category in ('in_progress', 'proposed', 'resolved')) as eligible,
  count(*) filter (where state_category in ('in_progress', 'proposed', 'resolved')
    and remaining >= 0) as known,
  count(*) filter (where state_category in ('in_progress', 'proposed', 'resolved')
    and remaining is null) as missing,
  count(*) filter (where state_category in ('in_progress', 'proposed', 'resolved')
    and remaining < 0) as invalid,
  count(*) filter (where state_category is null
    or (state_category in ('completed', 'removed') and remaining > 0)) as excluded
"""

# Class of a load beside a capacity, over load, cap, eligible, known and the limits.
LOAD_CLASS = """
  case when cap is null then 'INSUFFICIENT_DATA'
    when load is null and eligible = 0 then 'NO_RECORDED_LOAD'
    when load is null then 'INSUFFICIENT_DATA'
    when cap = 0 and load = 0 then 'NO_RECORDED_LOAD'
    when cap = 0 then 'LOAD_WITHOUT_CAPACITY'
    when known <> eligible and load > attention * cap then 'ABOVE'
    when known <> eligible then 'INSUFFICIENT_DATA'
    when load = 0 then 'NO_RECORDED_LOAD'
    when load < below * cap then 'BELOW'
    when load <= within * cap then 'WITHIN'
    when load <= attention * cap then 'ATTENTION'
    else 'ABOVE' end
"""
LOAD_BOUND = """
  case when cap is null then coalesce(load > 0, false)
    when load is null then false
    when cap = 0 and load > 0 then known <> eligible
    when cap = 0 then false
    else known <> eligible end
"""
LOAD_REASON = """
  case when cap is null then 'capacity_unknown'
    when load is null and eligible = 0 then 'no_open_item'
    when load is null then 'no_known_work'
    when cap = 0 and load = 0 then 'zero_load_and_capacity'
    when cap = 0 then 'load_without_capacity'
    when known <> eligible then 'partial_ratio'
    when load = 0 then 'zero_load' end
"""
LOAD_RATIO = """
  case when load is not null and cap <> 0 then
    round(cast(load as double) / cast(cap as double), 6) end
"""


def with_views(body: str, *names: str) -> str:
    """``body`` preceded by the named views and everything they read."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for needed in VIEWS[name][0]:
                add(needed)
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return body
    clauses = ",\n".join(f"{name} as ({VIEWS[name][1]})" for name in ordered)
    return f"with {clauses}\n{body}"
