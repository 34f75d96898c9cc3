"""Planning rule queries: one per rule, the whole evaluation, and the scope filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import planning
from workload.bindings import Tables
from workload.catalog import query
from workload.views import with_views


def findings(t: Tables, rule_id: str | None = None):
    """All findings, or those of one rule; only the rules asked for are evaluated."""
    return planning.evaluate_planning(
        t.planning_items,
        t.relations,
        t.settings,
        planning.effective_rules(t.settings, t.rule_overrides),
        t.calendars,
        t.closed_iterations,
        only=None if rule_id is None else [rule_id],
    )


def _register(rule_id: str) -> None:
    sql = with_views(
        f"select * from planning_findings where rule_id = '{rule_id}'", "planning_findings"
    )
    query(f"rule_{rule_id}", sql)(lambda t: findings(t, rule_id).drop("organization"))


for _rule_id in planning.RULES:
    _register(_rule_id)


@query(
    "evaluate_planning",
    with_views(
        """
        select team_id, item_id, rule_id, severity from planning_findings
        """,
        "planning_findings",
    ),
)
def _(t: Tables):
    return findings(t).select("team_id", "item_id", "rule_id", "severity")


@query(
    "late_children",
    with_views(
        """
        select p.team_id, e.parent_id, e.child_id, strftime(p.target_date, '%Y-%m-%d') as parent_target,
          strftime(c.target_date, '%Y-%m-%d') as child_target
        from edges e join planning_items p on p.item_id = e.parent_id
        join planning_items c on c.item_id = e.child_id where c.target_date > p.target_date
        """,
        "planning_items", "edges",
    ),
)
def _(t: Tables):
    return planning.late_children(t.planning_items, t.relations).drop("organization")


@query(
    "enabled_rules",
    """
    select cast(n_nationkey as varchar) as team_id, rule_id,
      case when rule_id = 'overdue_open_item' and n_regionkey = 3 then 'critical'
        when rule_id = 'story_without_task' then 'high'
        when rule_id = 'area_or_iteration_mismatch' and n_regionkey = 1 then 'attention'
        else severity end as severity,
      cast(case when rule_id = 'overdue_open_item' and n_regionkey = 3 then 30 else 0 end as bigint)
        as tolerance_days
    from nation, (values ('inverted_dates', true, 'attention', []),
      ('overdue_open_item', true, 'attention', []),
      ('parent_ends_before_children', true, 'attention', []),
      ('open_work_in_closed_sprint', true, 'attention', []),
      ('missing_required_fields', true, 'info', []), ('story_without_task', false, 'info', [0]),
      ('missing_estimate', false, 'info', [1]),
      ('area_or_iteration_mismatch', false, 'info', [0, 1, 2])
    ) r(rule_id, standard, severity, regions)
    where (standard and not (rule_id = 'overdue_open_item' and n_regionkey = 2))
      or list_contains(regions, n_regionkey)
    """,
)
def _(t: Tables):
    return planning.enabled_rules(planning.effective_rules(t.settings, t.rule_overrides))


@query(
    "filter_area_scope",
    with_views(
        r"""
        select i.team_id, i.item_id, area_path from planning_items i join settings s using (team_id)
        where area_path = 'area\' || n_regionkey
          or (n_regionkey <> 2 and starts_with(area_path, 'area\' || n_regionkey || '\'))
        """,
        "planning_items", "settings",
    ),
)
def _(t: Tables):
    return planning.filter_area_scope(t.planning_items, t.settings).select(
        "team_id", "item_id", "area_path"
    )
