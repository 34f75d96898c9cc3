"""Calendar, capacity, load, classification and metrics against hand-computed values."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.operators import calendar, load, quality
from plumbline.operators.cross_team import consolidate_person, deduplicate_items
from tests.conftest import at, items_frame, number, on, rows_of, settings_frame

START, END = at("2026-09-14T03:00"), at("2026-09-19T03:00")


def window(spark, as_of="2026-09-13T12:00", team="t"):
    return spark.createDataFrame(
        [(team, START, END, "America/Sao_Paulo", at(as_of))],
        "team_id string, window_start timestamp, window_end timestamp, timezone string, as_of timestamp",
    )


def days_off(spark, *rows):
    return spark.createDataFrame(
        [("t", p, on(a), on(b), number(f)) for p, a, b, f in rows],
        "team_id string, person_id string, start date, end date, fraction decimal(5,4)",
    )


def people(spark, *ids):
    return spark.createDataFrame(
        [("t", i, i.upper()) for i in ids], "team_id string, person_id string, display_name string"
    )


def reservations(spark, *rows):
    return spark.createDataFrame(
        [("t", p, "build", number(d), u) for p, d, u in rows],
        "team_id string, person_id string, activity string, per_day decimal(18,4), unit string",
    )


def relations(spark, *pairs, kind="hierarchy"):
    return spark.createDataFrame(
        [("org", p, c, kind) for p, c in pairs],
        "organization string, parent_id bigint, child_id bigint, relation string",
    )


def capacity_of(spark, off, settings=None, as_of="2026-09-13T12:00", per_day=6):
    settings = settings if settings is not None else settings_frame(spark)
    frame = calendar.team_calendars(settings, window(spark, as_of))
    factors = calendar.eligible_day_factors(frame, people(spark, "a"), off)
    rows = calendar.reserved_capacity(frame, reservations(spark, ("a", per_day, "hours")), factors)
    return rows.first()["capacity_value"]


def test_day_off_and_holiday_on_one_day_count_once(spark):
    off = days_off(spark, ("a", "2026-09-16", "2026-09-17", None))
    assert capacity_of(spark, off) == 24
    holiday = settings_frame(spark, {"holidays": [on("2026-09-16")]})
    assert capacity_of(spark, off, holiday) == 24


def test_overlapping_fractions_take_the_larger(spark):
    off = days_off(
        spark, ("a", "2026-09-16", "2026-09-17", 0.25), (None, "2026-09-16", "2026-09-17", 0.5)
    )
    assert capacity_of(spark, off) == 27
    union = calendar.day_off_fractions(
        days_off(spark, ("a", "2026-09-16", "2026-09-17", 0.25), ("a", "2026-09-15", "2026-09-17", 0.5))
    )
    assert rows_of(union, "day", "fraction") == [
        (on("2026-09-15"), Decimal("0.5000")), (on("2026-09-16"), Decimal("0.5000")),
    ]


@pytest.mark.parametrize(
    ("policy", "days"), [("exclude", [17, 18]), ("include_full", [16, 17, 18])]
)
def test_current_day_policy(spark, policy, days):
    settings = settings_frame(spark, {"current_day_policy": policy})
    frame = calendar.team_calendars(settings, window(spark, "2026-09-16T12:00"))
    factors = calendar.eligible_day_factors(frame, people(spark, "a"), days_off(spark))
    assert [d.day for (d,) in rows_of(factors, "day")] == days


def test_early_utc_hour_is_still_the_previous_local_day(spark):
    frame = calendar.team_calendars(settings_frame(spark), window(spark, "2026-09-15T02:00"))
    assert frame.first()["today"] == on("2026-09-14")


def test_no_window_means_no_capacity_value(spark):
    frame = calendar.team_calendars(settings_frame(spark), window(spark, team="other"))
    factors = calendar.eligible_day_factors(frame, people(spark, "a"), days_off(spark))
    row = calendar.reserved_capacity(frame, reservations(spark, ("a", 6, "hours")), factors).first()
    assert row["capacity_value"] is None


def test_one_unknown_daily_value_makes_the_person_unknown(spark):
    settings = settings_frame(spark)
    frame = calendar.team_calendars(settings, window(spark))
    factors = calendar.eligible_day_factors(frame, people(spark, "a", "b", "c"), days_off(spark))
    reserved = reservations(spark, ("a", 6, "hours"), ("a", None, "hours"), ("b", 4, "hours"),
                            ("c", 1, "days"))
    rows = calendar.reserved_capacity(frame, reserved, factors)
    team = calendar.team_capacity(settings, reserved, rows).first()
    assert (team["capacity_value"], team["eligible"], team["known"], team["missing"]) == (20, 3, 1, 2)


def test_day_strip_kinds_and_totals(spark):
    frame = calendar.team_calendars(
        settings_frame(spark, {"working_days": [0, 1, 2, 3]}), window(spark, "2026-09-15T12:00")
    )
    off = days_off(spark, (None, "2026-09-17", "2026-09-18", None), ("a", "2026-09-16", "2026-09-25", None))
    kinds = [kind for _, kind in rows_of(calendar.day_strip(frame, off), "day", "kind")]
    assert kinds == ["past", "today", "eligible", "off", "non_working"]
    totals = calendar.day_strip_totals(frame, off).first()
    assert (totals["remaining_days"], totals["personal_days_off"]) == (1, 3)


def test_missing_work_is_not_zero(spark):
    items = items_frame(
        spark, [{"item_id": i, "remaining": r} for i, r in ((1, 10), (2, 6), (3, None), (4, None))]
    )
    row = load.known_load(items, settings_frame(spark), ["team_id"]).first()
    assert (row["load_value"], row["eligible"], row["known"], row["missing"]) == (16, 4, 2, 2)
    nothing = load.known_load(items.where("remaining is null"), settings_frame(spark), ["team_id"])
    assert nothing.first()["load_value"] is None


def test_other_unit_negative_closed_and_unmapped_items(spark):
    items = items_frame(
        spark,
        [
            {"item_id": 1, "remaining": 3, "remaining_unit": "days"},
            {"item_id": 2, "remaining": -1},
            {"item_id": 3, "remaining": 5, "state_category": "completed"},
            {"item_id": 4, "remaining": 0, "state_category": "removed"},
            {"item_id": 5, "remaining": 9, "state_category": None},
            {"item_id": 6, "remaining": 2},
        ],
    )
    row = load.known_load(items, settings_frame(spark), ["team_id"]).first()
    assert (row["load_value"], row["eligible"], row["known"], row["invalid"], row["excluded"]) == (
        2, 3, 1, 2, 2,
    )
    found = rows_of(load.load_findings(items, settings_frame(spark)), "finding_id")
    assert [f for (f,) in found] == [
        "completed_with_remaining_work:3", "negative_remaining_work:2", "unmapped_state:5",
    ]


@pytest.mark.parametrize(("level", "expected"), [("leaf_task", 32), ("requirement", 40), ("all", 72)])
def test_parent_and_child_never_add_up(spark, level, expected):
    items = items_frame(
        spark, [{"item_id": 1, "remaining": 40}, {"item_id": 2, "remaining": 16},
                {"item_id": 3, "remaining": 16}]
    )
    settings = settings_frame(spark, {"accounting_level": level})
    kept = load.accountable_items(items, relations(spark, (1, 2), (1, 3), (2, 99)).where("child_id <> 99"), settings)
    assert load.known_load(kept, settings, ["team_id"]).first()["load_value"] == expected


def test_only_hierarchy_edges_exclude_and_absent_ends_count(spark):
    items = items_frame(spark, [{"item_id": 1, "remaining": 4}, {"item_id": 2, "remaining": 5}])
    settings = settings_frame(spark)
    related = relations(spark, (1, 2), kind="related")
    assert load.accountable_items(items, related, settings).count() == 2
    outside = relations(spark, (1, 77))
    assert rows_of(load.accountable_items(items, outside, settings), "item_id") == [(2,)]


CASES = [
    ("0", "100", 1, 1, "NO_RECORDED_LOAD", False),
    ("0.01", "100", 1, 1, "BELOW", False),
    ("59.99", "100", 1, 1, "BELOW", False),
    ("60", "100", 1, 1, "WITHIN", False),
    ("90", "100", 1, 1, "WITHIN", False),
    ("90.01", "100", 1, 1, "ATTENTION", False),
    ("110", "100", 1, 1, "ATTENTION", False),
    ("110.01", "100", 1, 1, "ABOVE", False),
    ("110.01", "100", 2, 1, "ABOVE", True),
    ("10", "100", 2, 1, "INSUFFICIENT_DATA", True),
    ("10", None, 1, 1, "INSUFFICIENT_DATA", True),
    (None, "100", 0, 0, "NO_RECORDED_LOAD", False),
    (None, "100", 2, 0, "INSUFFICIENT_DATA", False),
    ("0", "0", 1, 1, "NO_RECORDED_LOAD", False),
    ("5", "0", 2, 1, "LOAD_WITHOUT_CAPACITY", True),
]


def test_class_boundaries(spark):
    rows = [
        (i, number(l), "hours", e, k, number(c), "hours", Decimal("0.6"), Decimal("0.9"), Decimal("1.1"))
        for i, (l, c, e, k, *_) in enumerate(CASES)
    ]
    schema = """n int, load_value decimal(28,4), load_unit string, eligible bigint, known bigint,
      capacity_value decimal(38,8), capacity_unit string, below decimal(9,4), within decimal(9,4),
      attention decimal(9,4)"""
    classified = load.classify_load(spark.createDataFrame(rows, schema)).orderBy("n").collect()
    got = [(r["load_class"], r["is_lower_bound"]) for r in classified]
    assert got == [(name, bound) for *_, name, bound in CASES]
    other = spark.createDataFrame(rows[:1], schema).withColumn("capacity_unit", F.lit("days"))
    assert load.classify_load(other).first()["reason"] == "unit_mismatch"


def demo(spark):
    rows = [
        {"item_id": 100, "item_type": "Product Backlog Item", "remaining": 40, "assigned_to": "a"},
        {"item_id": 101, "remaining": 10, "assigned_to": "a"},
        {"item_id": 102, "remaining": 6, "assigned_to": "b"},
        {"item_id": 103, "remaining": 8, "assigned_to": "a", "blocked": True},
        {"item_id": 104, "remaining": 4, "assigned_to": "b"},
        {"item_id": 105, "assigned_to": "a"},
        {"item_id": 106, "assigned_to": "b"},
        {"item_id": 107, "state_category": "completed", "remaining": 0, "assigned_to": "a"},
        {"item_id": 108, "state_category": None, "remaining": 5, "assigned_to": "a"},
    ]
    items = items_frame(spark, [{"blocked": False, **row} for row in rows])
    edges = relations(spark, *[(100, i) for i in range(101, 109)])
    settings = settings_frame(spark)
    frame = calendar.team_calendars(settings, window(spark, "2026-09-15T12:00"))
    off = days_off(spark, ("a", "2026-09-16", "2026-09-17", None))
    who = people(spark, "a", "b")
    reserved = reservations(spark, ("a", 6, "hours"), ("b", 6, "hours"))
    capacities = calendar.reserved_capacity(
        frame, reserved, calendar.eligible_day_factors(frame, who, off)
    )
    return load.accountable_items(items, edges, settings), settings, who, reserved, capacities


def test_demo_sprint_end_to_end(spark):
    accountable, settings, who, reserved, capacities = demo(spark)
    metrics = {
        r["metric_id"]: r
        for r in quality.team_metrics(accountable, settings, reserved, capacities).collect()
    }
    work, capacity = metrics["known_remaining_work"], metrics["reserved_remaining_capacity"]
    use = metrics["observed_utilization"]
    assert (work["value"], work["eligible"], work["known"], work["status"]) == (28, 6, 4, "partial")
    assert (capacity["value"], capacity["status"]) == (30, "available")
    assert (round(use["ratio"], 3), use["status"]) == (Decimal("0.933"), "partial")
    assert metrics["open_items_count"]["value"] == 6
    assert metrics["blocked_items_count"]["value"] == 1
    rows = {r["person_id"]: r for r in load.person_load(who, accountable, settings, capacities).collect()}
    a, b = rows["a"], rows["b"]
    assert (a["load_value"], a["capacity_value"], a["load_class"], a["is_lower_bound"]) == (
        18, 12, "ABOVE", True,
    )
    assert (b["capacity_value"], b["load_class"], b["missing"]) == (18, "INSUFFICIENT_DATA", 1)
    assert len(rows) == 2


def test_unassigned_row_only_for_open_items(spark):
    accountable, settings, who, _, capacities = demo(spark)
    extra = items_frame(spark, [{"item_id": 1, "remaining": 3}, {"item_id": 2, "state_category": "removed"}])
    rows = load.person_load(who, accountable.unionByName(extra), settings, capacities)
    row = rows.where("person_id = '(unassigned)'").first()
    assert (row["load_value"], row["load_class"], row["capacity_value"]) == (3, "UNASSIGNED", None)


@pytest.mark.parametrize(
    ("change", "metric", "status"),
    [
        ({"capabilities": ["current_status"]}, "known_remaining_work", "not_applicable"),
        ({"remaining_field": None}, "known_remaining_work", "not_applicable"),
        ({"impediment_source": None}, "blocked_items_count", "not_applicable"),
        ({"partial_sources": ["work_items"]}, "open_items_count", "partial"),
        ({"partial_sources": ["capacity"]}, "reserved_remaining_capacity", "partial"),
    ],
)
def test_status_ladder(spark, change, metric, status):
    accountable, _, _, reserved, capacities = demo(spark)
    rows = quality.team_metrics(accountable, settings_frame(spark, change), reserved, capacities)
    assert rows.where(F.col("metric_id") == metric).first()["status"] == status


def test_empty_team_has_open_count_zero_and_no_load(spark):
    accountable, settings, _, reserved, capacities = demo(spark)
    rows = quality.team_metrics(accountable.limit(0), settings, reserved.limit(0), capacities.limit(0))
    status = {r["metric_id"]: (r["status"], r["value"]) for r in rows.collect()}
    assert status["open_items_count"] == ("available", 0)
    assert status["known_remaining_work"] == ("unavailable", None)
    assert status["reserved_remaining_capacity"] == ("not_applicable", None)


def test_first_arrival_wins_and_memberships_join(spark):
    rows = [(1, 3, "t1", ["t1"]), (1, 1, "t2", ["t2"]), (1, 2, "t1", ["t1", "t3"]), (2, 1, "t1", ["t1"])]
    raw = spark.createDataFrame(
        [("org", i, a, t, m) for i, a, t, m in rows],
        "organization string, item_id bigint, arrival int, team_id string, team_memberships array<string>",
    )
    for partitions in (1, 4):
        out = deduplicate_items(raw.repartition(partitions), ["arrival"])
        got = {r["item_id"]: r for r in out.collect()}
        assert (got[1]["team_id"], got[1]["team_memberships"], got[1]["overlapping"]) == (
            "t2", ["t2", "t1", "t3"], True,
        )
        assert got[2]["overlapping"] is False


def test_reservations_of_two_teams_exceed_one_person(spark):
    week = [on(f"2026-09-{d}") for d in range(14, 19)]
    both = [("t1", "a"), ("t2", "a")]
    pairs = spark.createDataFrame(both, "team_id string, person_id string")
    factors = spark.createDataFrame(
        [(t, p, d, Decimal(1)) for t, p in both for d in week],
        "team_id string, person_id string, day date, factor decimal(9,4)",
    )
    reserved = spark.createDataFrame(
        [(t, p, "build", Decimal(6), "hours") for t, p in both],
        "team_id string, person_id string, activity string, per_day decimal(18,4), unit string",
    )
    declared = spark.createDataFrame(
        [("a", Decimal(6), "hours")],
        "person_id string, per_day decimal(18,4), availability_unit string",
    )
    items = items_frame(spark, [{"item_id": 1, "remaining": 15, "assigned_to": "a", "overlapping": True}])
    row = consolidate_person(pairs, reserved, factors, items, declared, "hours").first()
    assert (row["reserved_total"], row["availability"], row["over_reserved"]) == (60, 30, True)
    assert (row["utilization"], row["overlapping_items"]) == (Decimal("0.5"), 1)
    undeclared = consolidate_person(pairs, reserved, factors, items, declared.limit(0), "hours").first()
    assert (undeclared["utilization"], undeclared["over_reserved"]) == (None, False)
    assert undeclared["reason"] == "availability_not_declared"


def test_more_aggregates_share_the_pass_over_the_items(spark):
    items = items_frame(spark, [{"item_id": i, "remaining": 1} for i in (1, 2, 3)])
    odd = F.count(F.when(F.col("item_id") % 2 == 1, 1)).alias("odd")
    row = load.known_load(items, None, ["team_id"], "hours", odd).first()
    assert (row["known"], row["odd"]) == (3, 2)
