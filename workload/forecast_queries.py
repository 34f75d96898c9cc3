"""Forecast queries."""

from __future__ import annotations

from plumbline.operators import forecast
from workload.bindings import Tables
from workload.catalog import query
from workload.views import VIEWS, with_views

VIEWS["samples"] = (
    (),
    """
    select team_id, list(completed order by week) as sample, count(*) as n, sum(completed) as completions
    from (
      select g.team_id, w.week, count(o.o_orderkey) as completed
      from (select distinct o_custkey % 25 as team_id from orders where o_orderstatus = 'F') g
      cross join (select cast(unnest(generate_series(min(date_trunc('week', o_orderdate)),
          max(date_trunc('week', o_orderdate)), interval 7 day)) as date) as week
        from orders where o_orderstatus = 'F') w
      left join orders o on o.o_orderstatus = 'F' and o.o_custkey % 25 = g.team_id
        and cast(date_trunc('week', o.o_orderdate) as date) = w.week
      group by g.team_id, w.week)
    group by team_id
    """,
)
VIEWS["scopes"] = (
    (),
    """
    select o_custkey % 25 as team_id, count(*) filter (where o_orderstatus = 'O') as scope
    from orders group by 1
    """,
)


_P = 2147483647
# The draw for iteration i and period k, the same integer arithmetic as the operator.
_X1 = f"(((i * 1000003 + k * 7919 + 20260913) % {_P}) * ((i * 1000003 + k * 7919 + 20260913) % {_P}) + 12345) % {_P}"
_X2 = f"(({_X1}) * 48271 + i * 31 + k) % {_P}"


def _eligibility(t: Tables):
    return forecast.forecast_eligibility(forecast.throughput_samples(t.weekly_orders), t.open_scope)


@query(
    "forecast_eligibility",
    with_views(
        """
        select cast(team_id as varchar) as team_id, scope, n as weeks,
          cast(completions as bigint) as completions,
          case when n < 12 or completions < 30 then concat_ws(',', case when n < 12 then 'too_few_weeks' end,
              case when completions < 30 then 'too_few_completions' end)
            when scope <= 0 then 'no_sample_or_scope' else '' end as reasons,
          n >= 12 and completions >= 30 and scope > 0 as eligible
        from samples join scopes using (team_id)
        """,
        "samples", "scopes",
    ),
)
def _(t: Tables):
    return _eligibility(t).drop("sample")


# One fold per iteration delivers both scopes. Its state is delivered * 10^6 + periods for
# the given scope * 10^3 + periods for the larger one.
_FORECAST = (
    with_views("", "samples", "scopes").rstrip()
    + f""",
    grid as (
      select s.team_id, s.sample, s.n, p.scope, cast(round_even(p.scope * 1.2, 0) as bigint) as larger, r.i
      from samples s join scopes p using (team_id), range(0, 10000) r(i)
      where s.n >= 12 and s.completions >= 30 and p.scope > 0),
    half_drawn as (
      select *, list_transform(range(1, 521), lambda k: {_X2}) as x2 from grid),
    runs as (
      select team_id, scope, larger, list_reduce(
        list_transform(x2, lambda x, k: sample[
          (((x * x + k * 101 + 20260913) % {_P}) * 69621 + i) % {_P} % n + 1]),
        lambda a, drawn: case when a // 1000000 >= larger then a
          else a + drawn * 1000000 + case when a // 1000000 < scope then 1001 else 1 end end,
        cast(0 as bigint)) as state
      from half_drawn),
    periods as (
      select team_id, 'scope' as scenario, scope as remaining_items, state // 1000 % 1000 as periods from runs
      union all
      select team_id, 'scope_plus_20', larger, state % 1000 from runs),
    ranked as (
      select *, row_number() over (partition by team_id, scenario order by periods) as rank from periods)
    select cast(team_id as varchar) as team_id, scenario, remaining_items, count(*) as iterations,
      max(case when rank = 5000 then periods end) as p50_periods,
      max(case when rank = 8500 then periods end) as p85_periods
    from ranked group by all
    """
)


@query("bootstrap_forecast", _FORECAST)
def _(t: Tables):
    return forecast.bootstrap_forecast(_eligibility(t))
