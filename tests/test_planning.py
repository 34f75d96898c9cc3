"""Planning rules fire, stay silent, and follow each team's settings."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import planning
from plumbline.operators.cross_team import deduplicate_items
from tests.conftest import items_frame, on, rows_of, settings_frame

OVERRIDE = """team_id string, rule_id string, enabled boolean, severity string, tolerance_days int,
  exceptions array<string>"""


def evaluate(spark, items, overrides=(), edges=(), closed=(), **settings):
    team = settings_frame(spark, settings)
    rules = planning.effective_rules(team, spark.createDataFrame(list(overrides), OVERRIDE))
    relations = spark.createDataFrame(
        [("org", p, c, k) for p, c, k in edges],
        "organization string, parent_id bigint, child_id bigint, relation string",
    )
    today = spark.createDataFrame([("t", on("2026-09-15"))], "team_id string, today date")
    shut = spark.createDataFrame([("t", c) for c in closed], "team_id string, iteration_path string")
    found = planning.evaluate_planning(items_frame(spark, items), relations, team, rules, today, shut)
    return [f for (f,) in rows_of(found, "finding_id")]


def test_default_rules(spark):
    items = [
        {"item_id": 1, "start_date": on("2026-09-20"), "target_date": on("2026-09-18")},
        {"item_id": 2, "target_date": on("2026-09-14")},
        {"item_id": 3, "target_date": on("2026-09-14"), "state_category": "completed"},
        {"item_id": 4, "target_date": on("2026-09-14"), "state_category": None},
        {"item_id": 5, "target_date": on("2026-09-16"), "iteration_path": "S0"},
        {"item_id": 6, "target_date": on("2026-09-17")},
        {"item_id": 7, "remaining": None},
    ]
    found = evaluate(spark, items, edges=[(5, 6, "hierarchy"), (6, 1, "related")], closed=["S0"])
    assert found == [
        "inverted_dates:1", "open_work_in_closed_sprint:5", "overdue_open_item:2",
        "parent_ends_before_children:5",
    ]


def test_tolerance_exception_and_disabling(spark):
    items = [{"item_id": i, "target_date": on(f"2026-09-{d:02d}")} for i, d in ((1, 14), (2, 10), (3, 1))]
    rule = ("t", "overdue_open_item", True, "high", 3, ["3"])
    assert evaluate(spark, items, [rule]) == ["overdue_open_item:2"]
    assert evaluate(spark, items, [("t", "overdue_open_item", False, "high", 0, [])]) == []


@pytest.mark.parametrize(
    ("rule", "exceptions", "expected"),
    [
        ("missing_estimate", [], ["missing_estimate:1"]),
        ("story_without_task", [], ["story_without_task:2"]),
        ("area_or_iteration_mismatch", [], ["area_or_iteration_mismatch:2"]),
        ("missing_required_fields", ["require:assigned_to", "require:nothing"],
         ["missing_required_fields:1", "missing_required_fields:2", "missing_required_fields:3"]),
    ],
)
def test_optional_rules(spark, rule, exceptions, expected):
    items = [
        {"item_id": 1, "area_path": "root\\a"},
        {"item_id": 2, "item_type": "User Story", "remaining": 1, "area_path": "rootless"},
        {"item_id": 3, "item_type": "User Story", "remaining": 1, "assigned_to": "x"},
    ]
    found = evaluate(spark, items, [(("t", rule, True, "info", 0, exceptions))], edges=[(3, 9, "related")])
    assert found == expected


def test_required_field_that_is_present_is_no_finding(spark):
    items = [{"item_id": 1, "assigned_to": "x"}, {"item_id": 2, "assigned_to": ""}]
    rule = ("t", "missing_required_fields", True, "info", 0, ["require:assigned_to"])
    assert evaluate(spark, items, [rule]) == ["missing_required_fields:2"]


def test_late_children_pairs_and_enabled_rules(spark):
    items = items_frame(
        spark, [{"item_id": i, "target_date": on(f"2026-09-{d}")} for i, d in ((1, 20), (2, 21), (3, 19))]
    )
    edges = spark.createDataFrame(
        [("org", 1, c, "hierarchy") for c in (2, 2, 3)],
        "organization string, parent_id bigint, child_id bigint, relation string",
    )
    assert rows_of(planning.late_children(items, edges), "parent_id", "child_id") == [(1, 2)]
    team = settings_frame(spark)
    rules = planning.effective_rules(team, spark.createDataFrame([], OVERRIDE))
    assert planning.enabled_rules(rules).count() == sum(r.enabled for r in planning.RULES.values())


def test_area_scope(spark):
    items = items_frame(spark, [{"item_id": 1, "area_path": "root"}, {"item_id": 2, "area_path": "root\\x"},
                                {"item_id": 3, "area_path": "other"}, {"item_id": 4}])
    assert rows_of(planning.filter_area_scope(items, settings_frame(spark)), "item_id") == [(1,), (2,)]
    flat = settings_frame(spark, {"include_descendants": False})
    assert rows_of(planning.filter_area_scope(items, flat), "item_id") == [(1,)]
    assert planning.filter_area_scope(items, flat).where(F.col("item_id") == 2).count() == 0


def test_items_have_one_source_for_rules_and_children(spark, tmp_path):
    """The same shuffles serve both uses only where no filter of one use reaches the source."""
    raw = items_frame(spark, [{"item_id": i, "target_date": on("2026-09-14")} for i in (1, 2)])
    raw.drop("overlapping").write.parquet(str(tmp_path / "raw"))
    items = deduplicate_items(spark.read.parquet(str(tmp_path / "raw")), ["created_at"])
    relations = spark.createDataFrame(
        [("org", 1, 2, "hierarchy")],
        "organization string, parent_id bigint, child_id bigint, relation string",
    )
    summary = planning.children_summary(items, relations)
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "IsNotNull(item_id)" not in plan
    assert rows_of(summary, "item_id", "last_child_target") == [(1, on("2026-09-14"))]


def test_items_are_not_dealt_by_team(spark):
    team = settings_frame(spark, {})
    rules = planning.effective_rules(team, spark.createDataFrame([], OVERRIDE))
    today = spark.createDataFrame([("t", on("2026-09-15"))], "team_id string, today date").distinct()
    items = items_frame(spark, [{"item_id": 1}])
    found = planning.evaluate_planning(
        items, None, team, rules, today, None, only=["inverted_dates", "missing_estimate"]
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(team_id" in line]
    assert "item_id" in plan and "SortMergeJoin" not in plan.split("Scan")[0]
    assert "BroadcastHashJoin" in plan.split("Scan")[0] and dealt


def test_items_meet_their_children_without_their_texts(spark):
    """Only what the rules on children read is shuffled by item, and every edge once."""
    team = settings_frame(spark, {})
    every = [("t", rule, True, "high", 0, []) for rule in planning.RULES]
    rules = planning.effective_rules(team, spark.createDataFrame(every, OVERRIDE))
    today = spark.createDataFrame([("t", on("2026-09-15"))], "team_id string, today date")
    shut = spark.createDataFrame([("t", "S0")], "team_id string, iteration_path string")
    items = items_frame(spark, [
        {"item_id": 1, "item_type": "User Story", "target_date": on("2026-09-20"), "title": "x"},
        {"item_id": 2, "target_date": on("2026-09-21"), "area_path": "other", "remaining": 1},
        {"item_id": 3, "item_type": "User Story", "remaining": 1, "iteration_path": "S0"},
    ])
    relations = spark.createDataFrame(
        [("org", 1, 2, "hierarchy")] * 2,
        "organization string, parent_id bigint, child_id bigint, relation string",
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = planning.evaluate_planning(items, relations, team, rules, today, shut)
        plan = found._jdf.queryExecution().executedPlan()
        plan = plan.toString().split("== Initial Plan ==")[-1].splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    by_item = [k for k, line in enumerate(plan) if "Exchange hashpartitioning(item_id" in line]
    fed = [plan[k + 1] for k in by_item]
    assert by_item and not any("area_path#" in line.split("AS")[-1] for line in fed)
    assert not any("Exchange hashpartitioning" in line and "parent_id" in line and "child_id" in line
                   for line in plan)
    assert [f for (f,) in rows_of(found, "finding_id")] == [
        "area_or_iteration_mismatch:2", "missing_estimate:1", "open_work_in_closed_sprint:3",
        "parent_ends_before_children:1", "story_without_task:3",
    ]
