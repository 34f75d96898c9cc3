"""Commitment and flow queries over revision history."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import commitment, flow, history
from plumbline.plans.history_block import history_block
from workload.bindings import Tables
from workload.catalog import query
from workload.views import half_even_days, with_views

CYCLE_DAYS = half_even_days("started_at", "completed_at")
LEAD_DAYS = half_even_days("created_at", "completed_at")
AGE_DAYS = half_even_days("started", "epoch_us(timestamp '2024-01-20')")


@query(
    "history_coverage",
    with_views(
        """
        select q.team_id, count(*) as requested_items, count(r.item_id) as items_with_revisions,
          coalesce(max(r.most) > 1, false) as intraday, count(*) = count(r.item_id) as is_usable
        from (select distinct team_id, item_id from revisions union all
              select cast(n_nationkey as varchar), -1 - n_nationkey from nation
              where n_regionkey = 0) q
        left join (
          select team_id, item_id, max(n) as most from (
            select team_id, item_id, changed_at // 86400000000 as day, count(*) as n
            from revisions group by all) group by all) r
          on r.team_id = q.team_id and r.item_id = q.item_id
        group by q.team_id
        """,
        "revisions",
    ),
)
def _(t: Tables):
    return t.coverage


@query(
    "revision_at",
    with_views(
        """
        select team_id, item_id, revision, changed_at, state_category, iteration_path,
          cast(story_points as double) as story_points
        from (select r.*, row_number() over (partition by r.team_id, item_id
                order by changed_at desc, revision desc) as back
              from revisions r join windows w on w.team_id = r.team_id
              where changed_at <= w.commitment_at) where back = 1
        """,
        "revisions", "windows",
    ),
)
def _(t: Tables):
    state = history.revision_at(t.revisions, t.history_windows, "commitment_at")
    return state.drop("organization", "state")


@query(
    "completion_transitions",
    with_views("select team_id, item_id, changed_at, revision from transitions", "transitions"),
)
def _(t: Tables):
    return history.completion_transitions(t.usable).drop("organization")


@query(
    "first_transition",
    with_views(
        """
        select team_id, item_id, changed_at, revision from (
          select *, row_number() over (partition by team_id, item_id order by changed_at, revision) as n
          from revisions where state_category = 'in_progress') where n = 1
        """,
        "revisions",
    ),
)
def _(t: Tables):
    return history.first_transition(t.revisions, "in_progress").drop("organization")


@query(
    "throughput_by_week",
    with_views(
        """
        select w.team_id, strftime(k.week, '%Y-%m-%d') as week,
          (select count(*) from cohort c where c.team_id = w.team_id
            and date_trunc('week', make_timestamp(c.completed_at)) = k.week) as completed
        from windows w, (values (date '2024-01-08'), (date '2024-01-15')) k(week)
        where w.complete
        """,
        "cohort", "windows",
    ),
)
def _(t: Tables):
    return flow.throughput_by_week(t.usable, t.usable_windows)


@query(
    "reopened_completions",
    with_views(
        """
        select team_id, item_id, count(*) as completions from transitions
        where nth > 1 and changed_at between since and until group by all
        """,
        "transitions",
    ),
)
def _(t: Tables):
    # No gate of its own: only the caller's choice of teams applies.
    return flow.reopened_completions(t.usable, t.history_windows).drop("organization")


@query(
    "cycle_times",
    with_views(
        f"""
        select team_id, item_id, completed_at,
          case when started_at <= completed_at then {CYCLE_DAYS} end as days,
          case when started_at <= completed_at then null else 'no_observed_start' end as reason
        from cohort
        """,
        "cohort",
    ),
)
def _(t: Tables):
    return flow.cycle_times(t.usable, t.usable_windows).drop("organization")


@query(
    "lead_times",
    with_views(
        f"""
        select team_id, item_id, completed_at,
          case when created_at is not null then {LEAD_DAYS} end as days,
          case when created_at is null then 'unknown_creation' end as reason
        from cohort
        """,
        "cohort",
    ),
)
def _(t: Tables):
    return flow.lead_times(t.usable, t.created, t.usable_windows).drop("organization")


@query(
    "aging_wip",
    with_views(
        f"""
        select team_id, item_id, started as episode_started_at,
          case when started is not null then {AGE_DAYS} end as days,
          started is not null and done is not null as reopened,
          case when started is null then 'unknown_episode_start' end as reason
        from ages
        """,
        "ages",
    ),
)
def _(t: Tables):
    return flow.aging_wip(t.usable, t.usable_windows).drop("organization")


def _ranked(percent: int) -> str:
    return (
        f"max(case when rank = greatest(1, least(n, ({percent} * n + 99) // 100)) then days end)"
        f" as p{percent}"
    )


@query(
    "nearest_rank_percentile",
    with_views(
        f"""
        select team_id, max(coalesce(n, 0)) as sample_size, {_ranked(50)}, {_ranked(85)},
          max(coalesce(n, 0)) between 1 and 19 as small_sample,
          case when max(coalesce(n, 0)) = 0 then 'empty_sample'
            when max(coalesce(n, 0)) < 20 then 'small_sample' end as reason
        from (select team_id, days,
                case when days is not null then row_number() over (partition by team_id
                  order by days nulls last) end as rank,
                count(days) over (partition by team_id) as n
              from (select team_id, case when started_at <= completed_at then {CYCLE_DAYS} end as days
                    from cohort))
        group by team_id
        """,
        "cohort",
    ),
)
def _(t: Tables):
    return flow.nearest_rank_percentile(
        flow.cycle_times(t.usable, t.usable_windows), ["team_id"], [50, 85]
    )


@query(
    "build_baseline",
    with_views(
        """
        select team_id, item_id, cast(story_points as double) as story_points, state_category,
          iteration_path from baseline
        """,
        "baseline",
    ),
)
def _(t: Tables):
    return commitment.build_baseline(t.usable, t.usable_windows).drop("organization")


@query(
    "scope_changes",
    with_views("select * from scope_events", "scope_events"),
)
def _(t: Tables):
    return commitment.scope_changes(t.usable, t.usable_windows).drop("organization")


@query(
    "scope_round_trips",
    with_views(
        """
        select team_id, item_id from scope_events group by all having count(distinct direction) = 2
        """,
        "scope_events",
    ),
)
def _(t: Tables):
    changes = commitment.scope_changes(t.usable, t.usable_windows)
    return commitment.scope_round_trips(changes).drop("organization")


def outcomes(t: Tables):
    baseline = commitment.build_baseline(t.usable, t.usable_windows)
    return commitment.baseline_outcomes(baseline, t.usable, t.usable_windows)


def _share_sql(counted: str) -> str:
    return with_views(
        f"""
        select w.team_id, count(o.item_id) filter (where {counted}) as numerator,
          count(o.item_id) as denominator,
          case when count(o.item_id) > 0 then round(
            cast(count(o.item_id) filter (where {counted}) as double) / count(o.item_id), 6) end as value,
          case when count(o.item_id) = 0 then 'no_baseline' end as reason
        from windows w left join outcomes o using (team_id) where w.complete group by w.team_id
        """,
        "windows", "outcomes",
    )


@query("say_do", _share_sql("completed"))
def _(t: Tables):
    return commitment.say_do(t.usable_windows, outcomes(t))


@query("carry_over", _share_sql("not completed"))
def _(t: Tables):
    return commitment.carry_over(t.usable_windows, outcomes(t))


@query(
    "committed_points",
    with_views(
        """
        select team_id, cast(sum(committed) as double) as committed,
          case when count(committed) > 0 then cast(coalesce(sum(current), 0) as double) end as current,
          count(*) filter (where changed) as changed_items,
          count(*) - count(committed) as items_without_points
        from outcomes group by team_id
        """,
        "outcomes",
    ),
)
def _(t: Tables):
    return commitment.committed_points(outcomes(t))


@query(
    "repointed_items",
    with_views(
        """
        select team_id, item_id, cast(committed as double) as committed_points,
          cast(current as double) as current_points from outcomes where changed
        """,
        "outcomes",
    ),
)
def _(t: Tables):
    return commitment.repointed_items(outcomes(t)).drop("organization")


@query(
    "history_block",
    with_views(
        f"""
        , said as (
          select team_id, count(*) as baseline_size, count(*) filter (where completed) as done,
            cast(sum(committed) as double) as committed, cast(sum(current) as double) as current,
            count(*) filter (where changed) as changed
          from outcomes group by team_id),
        trips as (
          select team_id, sum(e) as entered, sum(x) as exited,
            count(*) filter (where e > 0 and x > 0) as both_ways
          from (select team_id, item_id, count(*) filter (where direction = 'entered') as e,
                  count(*) filter (where direction = 'exited') as x
                from scope_events group by all) group by team_id),
        flow as (
          select team_id, count(*) as throughput from cohort group by team_id),
        days as (
          select team_id, case when started_at <= completed_at then {CYCLE_DAYS} end as cycle,
            case when created_at is not null then {LEAD_DAYS} end as lead from cohort),
        ranks as (
          select team_id, count(cycle) as cycle_n, count(lead) as lead_n,
            list_sort(list(cycle) filter (where cycle is not null)) as cycles,
            list_sort(list(lead) filter (where lead is not null)) as leads
          from days group by team_id),
        aging as (
          select team_id, max(case when started is not null then {AGE_DAYS} end) as oldest,
            count(*) filter (where started is null) as unknown
          from ages group by team_id),
        again as (
          select team_id, count(distinct item_id) as reopened from transitions
          where nth > 1 and changed_at between since and until group by team_id)
        select w.team_id, w.complete as available,
          case when not w.complete then 'history_unavailable' end as reason,
          case when w.complete then coalesce(s.baseline_size, 0) end as baseline_size,
          case when s.baseline_size > 0 then round(cast(s.done as double) / s.baseline_size, 6) end as say_do,
          case when w.complete then coalesce(s.done, 0) end as say_do_numerator,
          case when s.baseline_size > 0 then
            round(cast(s.baseline_size - s.done as double) / s.baseline_size, 6) end as carry_over,
          s.committed as committed_points, s.current as current_points,
          case when w.complete then coalesce(s.changed, 0) end as changed_items,
          case when w.complete then cast(coalesce(t.entered, 0) as bigint) end as scope_entered,
          case when w.complete then cast(coalesce(t.exited, 0) as bigint) end as scope_exited,
          case when w.complete then coalesce(t.both_ways, 0) end as scope_round_trips,
          case when w.complete then coalesce(f.throughput, 0) end as throughput,
          case when w.complete then cast(2 as bigint) end as weeks,
          case when w.complete then coalesce(g.reopened, 0) end as reopened_items,
          r.cycles[greatest(1, (50 * r.cycle_n + 99) // 100)] as cycle_time_p50,
          r.cycles[greatest(1, (85 * r.cycle_n + 99) // 100)] as cycle_time_p85,
          case when w.complete then coalesce(r.cycle_n, 0) end as cycle_time_sample,
          r.leads[greatest(1, (50 * r.lead_n + 99) // 100)] as lead_time_p50,
          case when w.complete then coalesce(r.lead_n, 0) end as lead_time_sample,
          case when w.complete then coalesce(r.cycle_n between 1 and 19 or r.lead_n between 1 and 19,
            false) end as small_sample,
          a.oldest as oldest_aging_days,
          case when w.complete then coalesce(a.unknown, 0) end as aging_unknown
        from windows w left join said s using (team_id) left join trips t using (team_id)
        left join flow f using (team_id) left join ranks r using (team_id)
        left join aging a using (team_id) left join again g using (team_id)
        """,
        "outcomes", "scope_events", "cohort", "ages", "transitions", "windows",
    ),
)
def _(t: Tables):
    return history_block(t.revisions, t.history_items, t.history_windows)
