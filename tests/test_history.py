"""Commitment and flow against hand-computed histories, and against a plain loop."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.functions.columns import elapsed_days
from plumbline.operators import commitment, flow, history, history_fold
from plumbline.plans.history_block import history_block
from tests.conftest import at, number, rows_of

SCHEMA = """team_id string, organization string, item_id bigint, revision bigint, changed_at timestamp,
  state_category string, iteration_path string, story_points decimal(18,4)"""
CUT, END = at("2026-09-14T03:00"), at("2026-09-19T03:00")


def revisions(spark, *rows):
    return spark.createDataFrame(
        [("t", "org", i, r, at(m), c, s, number(p)) for i, r, m, c, s, p in rows], SCHEMA
    )


def windows(spark, as_of=END):
    return spark.createDataFrame(
        [("t", "S1", CUT, CUT, END, as_of)],
        """team_id string, iteration_path string, commitment_at timestamp, since timestamp,
        until timestamp, as_of timestamp""",
    )


def outcomes(spark, revs):
    frame = windows(spark)
    return commitment.baseline_outcomes(commitment.build_baseline(revs, frame), revs, frame)


BASE = [
    (1, 1, "2026-09-13T10:00", "proposed", "S1", 5),
    (2, 1, "2026-09-13T10:00", "proposed", "S1", 3),
    (3, 1, "2026-09-13T10:00", "completed", "S1", 8),
    (4, 1, "2026-09-15T10:00", "proposed", "S1", 2),
    (6, 1, "2026-09-13T10:00", None, "S1", None),
    (7, 1, "2026-09-13T10:00", "proposed", "S2", 1),
]


def test_baseline_keeps_open_and_uncategorised_items_of_the_sprint(spark):
    baseline = commitment.build_baseline(revisions(spark, *BASE), windows(spark))
    assert rows_of(baseline, "item_id") == [(1,), (2,), (6,)]
    types = spark.createDataFrame(
        [("org", 1, "Story"), ("org", 2, "Task")], "organization string, item_id bigint, item_type string"
    )
    typed = commitment.build_baseline(revisions(spark, *BASE), windows(spark), types, ["Story"])
    assert rows_of(typed, "item_id") == [(1,)]


def test_say_do_carry_over_and_points(spark):
    revs = revisions(
        spark, *BASE,
        (1, 2, "2026-09-15T10:00", "in_progress", "S1", 13),
        (2, 2, "2026-09-16T10:00", "completed", "S1", 3),
    )
    found = outcomes(spark, revs)
    said = commitment.say_do(windows(spark), found).first()
    carried = commitment.carry_over(windows(spark), found).first()
    assert (said["numerator"], said["denominator"]) == (1, 3)
    assert (carried["numerator"], carried["denominator"]) == (2, 3)
    points = commitment.committed_points(found).first()
    assert (points["committed"], points["current"], points["changed_items"]) == (8, 16, 1)
    assert points["items_without_points"] == 1
    assert rows_of(commitment.repointed_items(found), "item_id") == [(1,)]


def test_empty_baseline_has_no_ratio(spark):
    found = outcomes(spark, revisions(spark, BASE[-1]))
    said = commitment.say_do(windows(spark), found).first()
    assert (said["value"], said["reason"], said["denominator"]) == (None, "no_baseline", 0)


def test_scope_round_trip(spark):
    revs = revisions(
        spark,
        (5, 1, "2026-09-13T10:00", "proposed", "S2", 1),
        (5, 2, "2026-09-15T10:00", "proposed", "S1", 1),
        (5, 3, "2026-09-17T10:00", "proposed", "S2", 1),
        (8, 1, "2026-09-16T10:00", "proposed", "S1", 1),
        (9, 1, "2026-09-14T03:00", "proposed", "S1", 1),
    )
    changes = commitment.scope_changes(revs, windows(spark))
    assert rows_of(changes, "item_id", "direction") == [(5, "entered"), (5, "exited"), (8, "entered")]
    assert rows_of(commitment.scope_round_trips(changes), "item_id") == [(5,)]


def test_reopened_item_delivers_once(spark):
    revs = revisions(
        spark,
        (1, 1, "2026-09-14T10:00", "in_progress", "S1", 1),
        (1, 2, "2026-09-15T10:00", "completed", "S1", 1),
        (1, 3, "2026-09-15T11:00", "completed", "S1", 1),
        (1, 4, "2026-09-16T10:00", "in_progress", "S1", 1),
        (1, 5, "2026-09-17T10:00", "completed", "S1", 1),
    )
    weeks = flow.throughput_by_week(revs, windows(spark))
    assert rows_of(weeks, "completed") == [(1,)]
    assert rows_of(flow.reopened_completions(revs, windows(spark)), "item_id", "completions") == [(1, 1)]
    cycle = flow.cycle_times(revs, windows(spark)).first()
    assert (cycle["days"], cycle["reason"]) == (Decimal("1.00"), None)


def test_cycle_without_start_and_lead_without_creation(spark):
    revs = revisions(
        spark,
        (1, 1, "2026-09-15T10:00", "completed", "S1", 1),
        (1, 2, "2026-09-16T10:00", "in_progress", "S1", 1),
    )
    assert flow.cycle_times(revs, windows(spark)).first()["reason"] == "no_observed_start"
    created = spark.createDataFrame([], "organization string, item_id bigint, created_at timestamp")
    lead = flow.lead_times(revs, created, windows(spark)).first()
    assert (lead["days"], lead["reason"]) == (None, "unknown_creation")


def test_age_restarts_at_the_reopening(spark):
    revs = revisions(
        spark,
        (1, 1, "2026-09-14T09:00", "in_progress", "S1", 1),
        (1, 2, "2026-09-15T09:00", "completed", "S1", 1),
        (1, 3, "2026-09-17T09:00", "in_progress", "S1", 1),
        (2, 1, "2026-09-16T09:00", "proposed", "S1", 1),
    )
    as_of = at("2026-09-19T09:00")
    age = flow.aging_wip(revs, windows(spark, as_of)).first()
    assert (age["days"], age["reopened"]) == (Decimal("2.00"), True)
    every = flow.aging_wip(revs, windows(spark, as_of), only_started=False)
    assert rows_of(every, "item_id", "days", "reason") == [
        (1, Decimal("2.00"), None), (2, None, "unknown_episode_start"),
    ]


def test_percentiles_are_nearest_rank(spark):
    sample = spark.createDataFrame([("t", Decimal(d)) for d in (1, 2, 3, 4)], "team_id string, days decimal(18,2)")
    row = flow.nearest_rank_percentile(sample, ["team_id"], [50, 85]).first()
    assert (row["p50"], row["p85"], row["sample_size"], row["small_sample"]) == (2, 4, 4, True)
    empty = sample.withColumn("days", F.lit(None).cast("decimal(18,2)"))
    none = flow.nearest_rank_percentile(empty, ["team_id"], [50]).first()
    assert (none["p50"], none["sample_size"], none["reason"]) == (None, 0, "empty_sample")


def test_coverage_needs_every_item(spark):
    revs = revisions(spark, *BASE[:2], (1, 2, "2026-09-13T12:00", "proposed", "S1", 5))
    asked = spark.createDataFrame(
        [("org", 1, "t"), ("org", 2, "t"), ("org", 2, "t")],
        "organization string, item_id bigint, team_id string",
    )
    full = history.history_coverage(asked, revs)
    assert rows_of(full, "requested_items", "items_with_revisions", "intraday", "is_usable") == [
        (2, 2, True, True)
    ]
    more = asked.unionByName(
        spark.createDataFrame([("org", 99, "t")], "organization string, item_id bigint, team_id string")
    )
    short = history.history_coverage(more, revs)
    assert short.first()["is_usable"] is False
    assert history.usable_revisions(revs, short).count() == 0
    born = F.lit(None).cast("timestamp").alias("created_at")
    block = history_block(revs, more.select("*", born), windows(spark)).first()
    assert (block["available"], block["reason"]) == (False, "history_unavailable")
    block = history_block(revs, asked.select("*", born), windows(spark)).first()
    assert (block["available"], block["baseline_size"]) == (True, 2)


@pytest.mark.parametrize(
    ("micros", "days"),
    [(432_000_000, "0.00"), (432_000_001, "0.01"), (1_296_000_000, "0.02"), (86_400_000_000, "1.00"),
     (-432_000_001, "-0.01"), (-1_296_000_000, "-0.02")],
)
def test_days_round_half_to_even(spark, micros, days):
    frame = spark.createDataFrame([(0, micros)], "a bigint, b bigint").select(
        elapsed_days(F.timestamp_micros("a"), F.timestamp_micros("b")).alias("d")
    )
    assert frame.first()["d"] == Decimal(days)


def random_history(seed, items=25):
    rnd = random.Random(seed)
    rows = []
    for item in range(items):
        moment = dt.datetime(2026, 9, 10)
        for revision in range(rnd.randrange(1, 12)):
            moment += dt.timedelta(hours=rnd.choice([0, 3, 30]))
            rows.append((item, revision, moment.isoformat(),
                         rnd.choice(["proposed", "in_progress", "completed", None]),
                         rnd.choice(["S1", "S2"]), rnd.randrange(9)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_histories_match_a_plain_loop(spark, seed):
    rows = random_history(seed)
    revs = revisions(spark, *random.Random(seed).sample(rows, len(rows))).repartition(5)
    frame = windows(spark)
    entered, exited, again, ages = set(), set(), set(), {}
    for item in {r[0] for r in rows}:
        mine = sorted((at(m), n, c, s) for i, n, m, c, s, _ in rows if i == item)
        inside = False
        for moment, _, _, sprint in mine:
            now = sprint == "S1"
            if CUT < moment <= END and now != inside:
                (entered if now else exited).add((item, moment))
            if moment <= END:
                inside = now
        done, before, start = [], None, None
        for moment, _, category, _ in mine:
            if category == "completed" and before != "completed":
                done.append(moment)
            if category == "completed":
                start = None
            elif category == "in_progress" and start is None:
                start = moment
            before = category
        if any(CUT <= m <= END for m in done[1:]):
            again.add(item)
        if mine[-1][2] == "in_progress":
            ages[item] = start
    changes = commitment.scope_changes(revs, frame)
    stamp = F.unix_micros("changed_at")
    got = {(i, d, m) for i, d, m in changes.select("item_id", "direction", stamp).collect()}
    micros = lambda m: round(m.timestamp() * 1_000_000)
    assert got == {(i, "entered", micros(m)) for i, m in entered} | {
        (i, "exited", micros(m)) for i, m in exited
    }
    assert {i for (i,) in rows_of(flow.reopened_completions(revs, frame), "item_id")} == again
    aged = flow.aging_wip(revs, frame).select("item_id", F.unix_micros("episode_started_at"))
    assert dict(map(tuple, aged.collect())) == {i: m and micros(m) for i, m in ages.items()}


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("hours", [24, 6, 100_000])
def test_the_fold_equals_the_single_operators(spark, seed, hours):
    """Whatever the slices, one item holding most rows included."""
    rows = random_history(seed) + [
        (99, k, (dt.datetime(2026, 9, 11) + dt.timedelta(minutes=7 * k)).isoformat(),
         random.Random(k * seed).choice(["proposed", "in_progress", "completed", None]),
         random.Random(k + seed).choice(["S1", "S2"]), k % 5)
        for k in range(1500)
    ]
    revs = revisions(spark, *rows).repartition(5)
    frame = windows(spark)
    pieces = F.floor(F.unix_seconds("changed_at") / (3600 * hours))
    folds = history_fold.item_folds(revs, frame, pieces)
    scope = commitment.scope_changes(revs, frame)
    for direction in ("entered", "exited"):
        counted = scope.where(F.col("direction") == direction).groupBy("item_id").count()
        assert rows_of(folds.where(f"{direction} > 0"), "item_id", direction) == rows_of(counted)
    again = flow.reopened_completions(revs, frame)
    assert rows_of(folds.where("recompletions > 0"), "item_id", "recompletions") == rows_of(
        again, "item_id", "completions"
    )
    aged = flow.aging_wip(revs, frame)
    assert rows_of(
        folds.where("category = 'in_progress'").select(
            "item_id", "episode_started_at",
            (F.col("reopened") & F.col("episode_started_at").isNotNull()).alias("reopened"),
        )
    ) == rows_of(aged, "item_id", "episode_started_at", "reopened")
    marks = flow.item_milestones(revs)
    assert rows_of(folds, "item_id", "started_at", "completed_at") == rows_of(
        marks, "item_id", "started_at", "completed_at"
    )
    for name, moment in (("at_cut", "commitment_at"), ("at_end", "as_of")):
        state = history.revision_at(revs, frame, moment)
        assert rows_of(
            folds.where(F.col(name).isNotNull()),
            "item_id", f"{name}.category", f"{name}.story_points",
        ) == rows_of(state, "item_id", "state_category", "story_points")


def test_the_block_reads_its_revisions_once(spark, tmp_path):
    rows = random_history(5)
    path = str(tmp_path / "revisions")
    revisions(spark, *rows).repartition(4).write.parquet(path)
    revs = spark.read.parquet(path)
    asked = revs.groupBy(*history.ITEM).agg(F.min("changed_at").alias("created_at"))
    windows(spark).write.parquet(path + "-windows")
    block = history_block(revs, asked, spark.read.parquet(path + "-windows"))
    plan = block._jdf.queryExecution().executedPlan().toString()
    first = plan.split("== Initial Plan ==")[-1]
    scans = [line for line in first.splitlines() if "Scan parquet" in line]
    assert sum("revision#" in line or "changed_at#" in line for line in scans) == 2
    # By (item, slice), by item, and the items asked for; the rest has a row per team.
    by_item = [
        line for line in first.splitlines()
        if "Exchange hashpartitioning" in line and "item_id" in line
    ]
    assert len(by_item) == 3
    assert block.first()["available"]
