"""Reports, claims, decisions and run snapshots."""

import json
import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.operators import claims, report, runs
from plumbline.sources import sinks
from tests.conftest import at, items_frame, rows_of


def findings(spark, n, team="t"):
    names = ["critical", "high", "attention", "info", "odd"]
    rows = [(team, f"rule:{i}", f"r{i % 3}", names[i % 5], i) for i in range(n)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(
        rows, "team_id string, finding_id string, rule_id string, severity string, item_id bigint"
    ).repartition(4)


def test_findings_rank_by_severity_rule_and_id(spark):
    ranked = [(r["severity_rank"], r["rule_id"], r["finding_id"]) for r in
              report.rank_findings(findings(spark, 30)).collect()]
    assert ranked == sorted(ranked) and ranked[-1][0] == 99


@pytest.mark.parametrize("limit", [400, 1_500, 3_000, 100_000])
def test_summary_is_the_longest_prefix_that_fits(spark, limit):
    rows = findings(spark, 40)
    fixed = spark.createDataFrame([("t", 100)], "team_id string, fixed_bytes int")
    kept = report.summarize_within_budget(rows, fixed, limit_bytes=limit, reference_bytes=20)
    got = [r["finding_id"] for r in kept.orderBy("rank").collect()]
    order = [r.asDict() for r in report.rank_findings(rows).collect()]

    def size(n, extra):
        body = [json.dumps({k: r[k] for k in ("finding_id", "rule_id", "severity", "item_id")},
                           separators=(",", ":")) for r in order[:n]]
        return 100 + extra + len(",".join(body))

    if size(40, 0) <= limit:
        expected = 40
    else:
        expected = max(n for n in range(40) if n == 0 or size(n, 20) <= limit)
    assert got == [r["finding_id"] for r in order[:expected]]


def test_evidence_pages_cover_every_item_once(spark):
    ids = random.Random(2).sample(range(10**6), 130)
    evidence = spark.createDataFrame([("r", i) for i in ids], "run_id string, item_id bigint")
    seen, cursor = [], 0
    while cursor is not None:
        page = report.evidence_page(evidence, cursor, 50, id_slice=1_000).orderBy("position").collect()
        seen += [r["item_id"] for r in page]
        cursor = page[-1]["next_cursor"]
    assert seen == sorted(ids)


def test_first_decision_of_an_id_wins(spark):
    schema = "id string, log_order int, position int, status string"
    one = spark.createDataFrame([("a", 0, 0, "open"), ("b", 0, 1, "open"), ("a", 0, 2, "done")], schema)
    two = spark.createDataFrame([("b", 1, 0, "done"), ("c", 1, 1, "open")], schema)
    merged = report.merge_decisions(one, two).orderBy("log_order", "position").collect()
    assert [(r["id"], r["status"]) for r in merged] == [("a", "open"), ("b", "open"), ("c", "open")]


def test_replay_compares_multisets(spark):
    schema = "run_id string, item_id int, value decimal(9,2)"
    stored = spark.createDataFrame([("r", 1, Decimal(2)), ("r", 1, Decimal(2)), ("s", 1, Decimal(1))], schema)
    again = spark.createDataFrame([("r", 1, Decimal(2)), ("s", 1, Decimal(1))], schema)
    assert rows_of(report.replay_diff(stored, again)) == [("r", 1, 0, False), ("s", 0, 0, True)]


def test_gap_and_shares(spark):
    rows = spark.createDataFrame(
        [("a", Decimal(18), Decimal(12), 3, 2), ("b", Decimal(4), Decimal(8), 1, 1), ("c", None, Decimal(8), 1, 0)],
        "p string, load_value decimal(28,4), capacity_value decimal(38,8), eligible bigint, known bigint",
    )
    got = {r["p"]: r for r in report.capacity_gap(rows).collect()}
    assert (got["a"]["gap"], got["a"]["is_partial"]) == (6, True)
    assert round(got["a"]["fits_percent"], 2) == Decimal("66.67")
    assert round(got["a"]["excess_percent"], 2) == Decimal("33.33")
    assert (got["b"]["fits_percent"], got["b"]["excess_percent"]) == (50, 0)
    assert (got["c"]["gap"], got["c"]["fits_percent"]) == (None, None)


def metric_rows(spark, load, capacity, load_status="available"):
    schema = """team_id string, metric_id string, status string, value decimal(38,8), unit string,
      missing bigint, coverage_eligible bigint, coverage_known bigint"""
    return spark.createDataFrame(
        [("t", "known_remaining_work", load_status, load, "hours", 2, 6, 4),
         ("t", "reserved_remaining_capacity", load_status, capacity, "hours", 0, 2, 2)], schema
    )


@pytest.mark.parametrize(
    ("load", "capacity", "status", "verdict"),
    [(5, 3, "available", "over"), (3, 3, "available", "exact"), (1, 3, "available", "fits"),
     (None, 3, "available", "not_comparable"), (None, None, "not_applicable", "not_applicable")],
)
def test_verdict(spark, load, capacity, status, verdict):
    rows = metric_rows(spark, load and Decimal(load), capacity and Decimal(capacity), status)
    assert report.load_verdict(rows).first()["verdict"] == verdict


def test_candidates_and_top_decisions(spark):
    people = spark.createDataFrame(
        [("t", "a", "NO_RECORDED_LOAD"), ("t", "(unassigned)", "NO_RECORDED_LOAD")],
        "team_id string, person_id string, load_class string",
    )
    items = items_frame(spark, [{"item_id": 1, "blocked": True}, {"item_id": 2, "blocked": False}])
    found = report.action_candidates(metric_rows(spark, Decimal(9), Decimal(4)), people, items)
    assert rows_of(found, "priority", "rule_id", "amount") == [
        (1, "active_impediment", 1), (2, "known_load_above_capacity", 5),
        (3, "no_recorded_load", 1), (4, "missing_remaining_work", 2),
    ]
    assert rows_of(report.top_decisions(found), "priority") == [(1,), (2,), (3,)]


def test_evidence_keeps_an_excerpt_of_the_title(spark):
    items = items_frame(spark, [{"item_id": 1, "title": "a\x07b" + "c" * 100, "remaining": 2}])
    record = report.minimize_evidence(items).first()
    assert record["title_excerpt"] == "a b" + "c" * 76 + "…"
    assert len(record["title_excerpt"]) == 80
    assert (record["remaining"]["value"], record["remaining"]["unit"]) == ("2.0000", "hours")
    assert record["original_estimate"] is None


CLAIMS = [
    ("hypothesis", 0, "", ["m"], None, "empty"),
    ("hypothesis", 1, "B is Idle today", ["m"], None, "banned_wording"),
    ("hypothesis", 2, "load is 28", [], None, "no_reference"),
    ("hypothesis", 3, "load is 28", ["m", "other"], None, "unknown_reference"),
    ("hypothesis", 4, "load is 28 of 99", ["m"], None, "unsupported_number"),
    ("hypothesis", 5, "load is 28,0 at 93.3 or 93 percent, item 0101", ["m", "evidence/items/101.json"], None, None),
    ("action", 6, "cut scope", ["m"], " ", "no_condition"),
    ("action", 7, "cut scope", ["m"], "ask", None),
    ("action", 8, "cut scope", ["m"], "ask", None),
    ("action", 9, "cut scope 7", ["m"], "ask", "unsupported_number"),
    ("action", 10, "cut scope", ["m"], "ask", None),
    ("action", 11, "cut scope", ["m"], "ask", "action_limit"),
]


def test_claims_are_judged_in_order(spark):
    wording = spark.createDataFrame([("is idle",), ("zzz",)], "pattern string")
    rows = spark.createDataFrame(
        [("r", *c[:5]) for c in CLAIMS],
        """run_id string, kind string, position int, statement string, references array<string>,
        condition string""",
    )
    evidence = spark.createDataFrame([("r", 101)], "run_id string, item_id bigint")
    metrics = spark.createDataFrame(
        [("r", "m", Decimal(28), Decimal("0.93333333333333"), 6, 4, 2, 0, 1)],
        """run_id string, metric_id string, value decimal(38,8), ratio decimal(38,14),
        coverage_eligible bigint, coverage_known bigint, missing bigint, invalid bigint, excluded bigint""",
    )
    people = spark.createDataFrame(
        [], """run_id string, load_value decimal(28,4), capacity_value decimal(38,8),
        ratio decimal(38,14), eligible bigint, known bigint, missing bigint""",
    )
    numbers = claims.allowed_numbers(metrics, people, evidence, evidence)
    assert {n for _, n in rows_of(numbers)} >= {"28", "93.3", "93", "101", "6", "4", "2", "0", "1"}
    references = claims.known_references(metrics, evidence)
    verdicts = claims.validate_claims(rows, references, numbers, wording)
    got = {r["position"]: r["reason"] for r in verdicts.collect()}
    assert got == {c[1]: c[5] for c in CLAIMS}
    accepted = claims.accepted_references(rows, verdicts)
    assert rows_of(accepted, "reference", "item_id") == [("evidence/items/101.json", 101), ("m", None)]


def test_a_statement_is_read_before_it_is_laid_out_by_tokens(spark):
    rows = spark.createDataFrame(
        [("r", "action", 1, "is idle 1 2 3", ["m"], "ask")],
        """run_id string, kind string, position int, statement string, references array<string>,
        condition string""",
    )
    wording = spark.createDataFrame([("is idle",)], "pattern string")
    references = spark.createDataFrame([("r", "m")], "run_id string, reference string")
    numbers = spark.createDataFrame([("r", "1")], "run_id string, number string")
    verdicts = claims.validate_claims(rows, references, numbers, wording)
    plan = verdicts._jdf.queryExecution().optimizedPlan().toString()
    # A plan's inputs come below it.
    assert plan.index("Generate") < plan.index("RLIKE")
    assert [r["reason"] for r in verdicts.collect()] == ["banned_wording"]


@pytest.mark.parametrize(
    ("raw", "short"),
    [("10", "10"), ("007", "7"), ("1,50", "1.5"), ("2.000", "2"), ("0.0", "0"), ("0", "0"),
     ("-3.10", "-3.1"), ("100.0100", "100.01"), ("1" * 40 + ".0", "1" * 40)],
)
def test_numbers_have_one_spelling(spark, raw, short):
    frame = spark.createDataFrame([(raw,)], "n string")
    assert frame.select(claims.canonical_number(F.col("n"))).first()[0] == short


def run_rows(spark, *rows):
    return spark.createDataFrame(
        [(r, t, at(a), s, list(p)) for r, t, a, s, p in rows],
        "run_id string, team_id string, as_of timestamp, state string, partial_reasons array<string>",
    )


RUNS = [
    ("r1", "a", "2026-09-01T00:00", "complete", ()),
    ("r2", "a", "2026-09-14T22:00", "partial", ("capacity",)),
    ("r3", "x-a", "2026-09-15T23:00", "complete", ()),
]


def test_latest_expired_and_fresh_runs(spark):
    rows = run_rows(spark, *RUNS)
    now = datetime(2026, 9, 16, 0, 30)
    assert rows_of(runs.latest_run(rows), "team_id", "run_id") == [("a", "r2"), ("x-a", "r3")]
    assert rows_of(runs.expired_runs(rows, now, 10), "run_id") == [("r1",)]
    fresh = runs.report_freshness(rows, now)
    assert rows_of(fresh, "team_id", "age_hours", "is_stale") == [("a", 26, True), ("x-a", 1, False)]
    assert rows_of(runs.teams_with_runs(rows)) == [("a",), ("x-a",)]


def test_state_changes_compare_with_the_run_before(spark):
    states = ["complete", "complete", "partial", "partial", "complete"]
    rows = spark.createDataFrame(
        [("k", f"r{i}", at(f"2026-09-{10 + i}T00:00"), s) for i, s in enumerate(states)],
        "schedule_key string, run_id string, finished_at timestamp, state string",
    )
    assert rows_of(runs.run_state_changes(rows), "run_id") == [("r0",), ("r2",), ("r4",)]


def test_success_marker_skips_a_key_unless_forced(spark):
    planned = spark.createDataFrame(
        [("c", "a", None, "2026-09-15"), ("c", "b", None, "2026-09-15")],
        "config_hash string, team_id string, window string, day string",
    )
    keyed = runs.pending_runs(planned, planned.select(F.lit("x").alias("schedule_key")), force=True)
    done = keyed.where("team_id = 'a'")
    assert rows_of(runs.pending_runs(planned, done), "team_id") == [("b",)]
    assert runs.pending_runs(planned, done, force=True).count() == 2


def test_run_state_lists_partial_sources_and_metrics(spark):
    metrics = spark.createDataFrame(
        [("r", "m", "available"), ("r", "n", "unavailable"), ("s", "m", "available")],
        "run_id string, metric_id string, status string",
    )
    sources = spark.createDataFrame([("r", "capacity")], "run_id string, source string")
    assert rows_of(runs.run_state(metrics, sources)) == [
        ("r", "partial", ["capacity", "metric:n"]), ("s", "complete", []),
    ]


def test_fingerprint_ignores_order_and_sees_every_change(spark):
    rows = spark.createDataFrame([("r", i, None if i == 3 else "x") for i in range(50)], "run string, a int, b string")
    base = runs.artifact_fingerprint(rows.repartition(4), ["run"])
    again = runs.artifact_fingerprint(rows.orderBy(F.desc("a")), ["run"])
    assert rows_of(base) == rows_of(again)
    for other in (rows.unionByName(rows.limit(1)), rows.where("a <> 7"), rows.fillna("x")):
        changed = runs.artifact_fingerprint(other, ["run"])
        assert rows_of(runs.divergent_artifacts(base, changed, ["run"])) == [("r", "changed")]
    assert rows_of(runs.divergent_artifacts(base, again.limit(0), ["run"])) == [("r", "missing")]


def test_grants(spark):
    rows = run_rows(spark, *RUNS)
    grants = spark.createDataFrame([("me", "a")], "principal string, team_id string")
    assert rows_of(runs.authorized_reports(rows, grants, "me"), "run_id") == [("r1",), ("r2",)]
    assert runs.authorized_reports(rows, grants, "you").count() == 0


def test_snapshots_are_immutable_and_manifest_led(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = run_rows(spark, *RUNS)
    values = spark.createDataFrame([("r1", 1), ("r2", 2), ("r9", 3)], "run_id string, value int")
    sinks.append_snapshot(rows.where("run_id = 'r1'"), {"values": values.where("run_id <> 'r2'")}, root)
    assert rows_of(sinks.read_artifact(spark, root, "values"), "run_id") == [("r1",)]
    with pytest.raises(sinks.RunExists):
        sinks.append_snapshot(rows.where("team_id = 'a'"), {"values": values}, root)
    sinks.append_snapshot(rows.where("run_id = 'r2'"), {"values": values.where("run_id = 'r2'")}, root)
    assert rows_of(sinks.read_artifact(spark, root, "values"), "run_id", "value") == [("r1", 1), ("r2", 2)]
    broken = run_rows(spark, ("r7", "a", "2026-09-01T00:00", "complete", ("capacity",)))
    with pytest.raises(ValueError, match="partial reasons"):
        sinks.append_snapshot(broken, {}, root)


def test_writing_a_report_again_leaves_no_rows_twice(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, value int")
    root = str(tmp_path / "report")
    attempts = [sinks.write_report({"metrics": rows}, root) for _ in range(2)]
    written = spark.read.json(f"{root}/metrics")
    assert written.where(F.col("attempt") == attempts[1]).count() == 2


def test_source_identity_is_opaque(spark):
    value = spark.range(1).select(runs.source_identity(F.lit("org"), F.lit("project"), F.lit("team"))).first()[0]
    assert value.startswith("sha256:") and len(value) == 7 + 32


def test_fingerprints_tell_separators_and_nulls_apart(spark):
    rows = spark.createDataFrame(
        [("a", "p\u0001q", "r"), ("b", "p", "q\u0001r"), ("c", None, "x"), ("d", "∅", "x")],
        "run_id string, m string, n string",
    )
    found = [r["fingerprint"] for r in runs.artifact_fingerprint(rows, ["run_id"]).collect()]
    assert len(set(found)) == 4


def test_a_batch_names_a_run_once_and_a_broken_store_is_an_error(spark, tmp_path):
    root = str(tmp_path / "store")
    twice = run_rows(
        spark, ("r1", "a", "2026-09-01T00:00", "complete", ()), ("r1", "a", "2026-09-02T00:00", "complete", ())
    )
    with pytest.raises(sinks.RunExists):
        sinks.append_snapshot(twice, {}, root)
    assert sinks.read_runs(spark, root) is None
    manifest = tmp_path / "store" / sinks.MANIFEST
    manifest.mkdir(parents=True)
    (manifest / f"{1:020d}.json").write_text("half a fi")
    with pytest.raises(ValueError):
        sinks.read_runs(spark, root)


def test_expired_runs_leave_the_store(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = run_rows(
        spark, ("old", "a", "2020-01-01T00:00", "complete", ()), ("new", "a", "2026-09-02T00:00", "complete", ())
    )
    values = spark.createDataFrame([("old", 1), ("new", 2)], "run_id string, value int")
    sinks.append_snapshot(rows, {"values": values}, root)
    sinks.remove_runs(spark, root, rows.where("run_id = 'old'"), ["values"])
    assert rows_of(sinks.read_runs(spark, root), "run_id") == [("new",)]
    assert rows_of(sinks.read_artifact(spark, root, "values"), "run_id", "value") == [("new", 2)]


def folders(root, name):
    return sorted(p.name for p in (root / name).glob("attempt=*"))


def batch(spark, *names):
    rows = run_rows(spark, *[(n, "a", "2026-09-02T00:00", "complete", ()) for n in names])
    return rows, {"values": spark.createDataFrame([(n, 1) for n in names], "run_id string, value int")}


@pytest.mark.parametrize("other, kept", [(("r1", "r9"), ["r1", "r9"]), (("r9",), ["r1", "r2", "r9"])])
def test_of_two_writers_of_one_run_the_later_fails(spark, tmp_path, monkeypatch, other, kept):
    """The second writer comes in after the first has checked and written its folders."""
    root = str(tmp_path / "store")
    write, late = sinks.write_report, []

    def interrupted(*args, **kwargs):
        attempt = write(*args, **kwargs)
        if not late:
            late.append(attempt)
            sinks.append_snapshot(*batch(spark, *other), root)
        return attempt

    monkeypatch.setattr(sinks, "write_report", interrupted)
    if "r1" in other:
        with pytest.raises(sinks.RunExists, match="r1"):
            sinks.append_snapshot(*batch(spark, "r1", "r2"), root)
        assert len(folders(tmp_path / "store", "values")) == 1
    else:
        done = sinks.append_snapshot(*batch(spark, "r1", "r2"), root)
        assert done.version == 2
    assert rows_of(sinks.read_runs(spark, root), "run_id") == [(n,) for n in kept]
    assert rows_of(sinks.read_artifact(spark, root, "values"), "run_id") == [(n,) for n in kept]


def test_a_version_is_written_by_one_writer(spark, tmp_path):
    root = str(tmp_path / "store")
    seen = sinks.read_manifest(spark, root)
    from dataclasses import replace

    for name in ("x", "y", "z"):
        sinks.commit(spark, root, seen, lambda s: replace(s, attempts=(*s.attempts, name)))  # noqa: B023
    state = sinks.read_manifest(spark, root)
    assert (state.version, state.attempts) == (3, ("x", "y", "z"))
    assert not [p for p in (tmp_path / "store" / sinks.MANIFEST).iterdir() if p.name.count("-") > 1]


def test_expiry_writes_no_data_anew_and_drops_empty_folders(spark, tmp_path):
    root, store = str(tmp_path / "store"), tmp_path / "store"
    sinks.append_snapshot(*batch(spark, "a1", "a2"), root)
    sinks.append_snapshot(*batch(spark, "b1"), root)
    before = sinks.read_manifest(spark, root)
    files = {p: p.stat().st_mtime_ns for p in (store / "values").rglob("*.parquet")}
    gone = spark.createDataFrame([("a1",), ("zz",)], "run_id string")
    sinks.remove_runs(spark, root, gone, ["values"])
    assert {p: p.stat().st_mtime_ns for p in (store / "values").rglob("*.parquet")} == files
    assert rows_of(sinks.read_artifact(spark, root, "values"), "run_id") == [("a2",), ("b1",)]
    # A reader that began earlier still sees the state that it began with.
    assert rows_of(sinks.read_runs(spark, root, before), "run_id") == [("a1",), ("a2",), ("b1",)]
    sinks.append_snapshot(*batch(spark, "a1"), root)
    assert rows_of(sinks.read_runs(spark, root), "run_id") == [("a1",), ("a2",), ("b1",)]
    state = sinks.remove_runs(spark, root, spark.createDataFrame([("a2",)], "run_id string"), ["values"])
    assert rows_of(sinks.read_artifact(spark, root, "values"), "run_id") == [("a1",), ("b1",)]
    assert len(folders(store, "values")) == len(folders(store, "runs")) == 2
    # The tombstones of a dropped attempt are no longer read.
    assert state.expiries == () and state.dropped == ()


@pytest.mark.parametrize("crash", ["create_once", "remove"])
def test_a_crash_while_runs_expire_loses_nothing(spark, tmp_path, monkeypatch, crash):
    root, store = str(tmp_path / "store"), tmp_path / "store"
    sinks.append_snapshot(*batch(spark, "old"), root)
    sinks.append_snapshot(*batch(spark, "new"), root)
    expired = spark.createDataFrame([("old",)], "run_id string")

    def stop(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(sinks._Files, crash, stop)
        with pytest.raises(KeyboardInterrupt):
            sinks.remove_runs(spark, root, expired, ["values"])
    # Before the new version nothing has gone; after it all has, but for the folders.
    left = [("new",), ("old",)] if crash == "create_once" else [("new",)]
    assert rows_of(sinks.read_runs(spark, root), "run_id") == left
    assert rows_of(sinks.read_artifact(spark, root, "values"), "run_id") == left
    assert len(folders(store, "values")) == 2
    sinks.remove_runs(spark, root, expired, ["values"])
    assert rows_of(sinks.read_artifact(spark, root, "values"), "run_id") == [("new",)]
    assert len(folders(store, "values")) == len(folders(store, "runs")) == 1


def test_old_versions_of_the_manifest_are_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "KEPT_VERSIONS", 2)
    root = str(tmp_path / "store")
    for name in ("a", "b", "c"):
        sinks.append_snapshot(*batch(spark, name), root)
    sinks.remove_runs(spark, root, spark.createDataFrame([("b",)], "run_id string"), ["values"])
    assert len(list((tmp_path / "store" / sinks.MANIFEST).glob("0*.json"))) == 2
    assert rows_of(sinks.read_runs(spark, root), "run_id") == [("a",), ("c",)]


def test_findings_without_an_item_are_not_cut_short(spark):
    rows = [("t", f"f{k:04d}", "r", "low", None) for k in range(700)]
    found = spark.createDataFrame(
        rows, "team_id string, finding_id string, rule_id string, severity string, item_id bigint"
    )
    fixed = spark.createDataFrame([("t", 0)], "team_id string, fixed_bytes int")
    kept = report.summarize_within_budget(found, fixed, limit_bytes=24_576)
    used = kept.agg(F.sum("bytes")).first()[0]
    each = kept.first()["bytes"]
    assert 24_576 - 64 - each < used <= 24_576 - 64 + 1
