"""Landed JSON and team configuration."""

import json
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.operators.cross_team import merge_people, reconcile_identity
from plumbline.session import configure
from plumbline.sources import landed, scope
from tests.conftest import at, on, rows_of, settings_frame


def payloads(spark, *documents, team="t"):
    rows = [("org", team, i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(
        rows, "organization string, team_id string, arrival int, payload string"
    )


@pytest.mark.parametrize(
    ("document", "count"),
    [
        ([{"id": 1}, {"id": 2}, 7, "x"], 2),
        ({"value": [{"id": 1}, 7]}, 1),
        ({"items": [{"id": 1}]}, 1),
        ({"teamMembers": []}, 0),
        ({"value": "text", "id": 3}, 1),
        ({"id": 3}, 1),
        ("junk", 0),
        ("5", 0),
    ],
)
def test_record_shapes(spark, document, count):
    assert landed.payload_records(payloads(spark, document)).count() == count


def test_lines_and_whole_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}\n{"id": 2}\n')
    (tmp_path / "b.json").write_text('{\n"value": [{"id": 3}]}')
    lines = landed.read_landed_payloads(spark, str(tmp_path / "a.json"))
    assert landed.payload_records(lines).count() == 2
    whole = landed.read_landed_payloads(spark, str(tmp_path / "b.json"), whole_files=True)
    assert landed.payload_records(whole).count() == 1


def test_landed_folders_are_context_and_nothing_is_lost(spark, tmp_path):
    for team, lines in {"007": ['{"id": 1}', "", '{"id": 2', "  ", '[{"id": 3}, {"id": 4}]'],
                        "b": ["17", '"text"', "null", "{nothing}", '{"value": [{"id": 5}]}']}.items():
        folder = tmp_path / f"team_id={team}"
        folder.mkdir()
        (folder / "part.txt").write_text("\n".join(lines))
    landing = landed.read_landed_payloads(spark, str(tmp_path), context=["team_id"])
    records = landed.payload_records(landed.well_formed_payloads(landing))
    assert rows_of(records, "team_id", "position", F.col("record")["id"]) == [
        ("007", 0, "1"), ("007", 0, "3"), ("007", 1, "4"), ("b", 0, "5"),
    ]
    assert rows_of(landed.malformed_payloads(landing), "team_id", "payload", "reason") == sorted([
        ("007", '{"id": 2', "not_json"), ("b", "17", "no_records"), ("b", '"text"', "no_records"),
        ("b", "null", "no_records"), ("b", "{nothing}", "not_json"),
    ], key=repr)
    whole = landed.read_landed_payloads(spark, str(tmp_path), whole_files=True, context=["team_id"])
    # A file is one document: what follows the first is not looked at, and no lone value counts.
    assert rows_of(landed.malformed_payloads(whole), "team_id", "reason") == [("b", "no_records")]
    assert rows_of(landed.payload_records(landed.well_formed_payloads(whole)), "team_id") == [("007",)]


def test_work_item_fields(spark):
    nested = {
        "id": "7",
        "fields": {
            "System.State": " Doing ", "System.Title": "[UI] x", "RemainingWork": "2.5",
            "System.AssignedTo": {"displayName": "Ann", "uniqueName": "ann@x"},
            "System.Tags": "a; BLOCKED", "Microsoft.VSTS.Scheduling.FinishDate": "2026-09-18T23:30:00-03:00",
            "System.CreatedDate": "2026-09-01T10:00:00Z", "System.Parent": 5,
        },
    }
    flat = {"workItemId": 8, "state": "Odd", "RemainingWork": True, "parentId": "6",
            "Microsoft.VSTS.Scheduling.TargetDate": "soon", "System.AssignedTo": "  "}
    rows = landed.normalize_work_items(
        payloads(spark, {"workItems": [nested, flat, {"fields": {}}]}), settings_frame(spark)
    )
    got = {r["item_id"]: r for r in rows.collect()}
    assert sorted(got) == [7, 8]
    a, b = got[7], got[8]
    assert (a["state"], a["title"], a["remaining"], a["assigned_to"]) == (
        "Doing", "[UI] x", Decimal("2.5"), "Ann",
    )
    assert (a["blocked"], a["target_date"], a["parent_id"]) == (True, on("2026-09-18"), 5)
    assert (b["remaining"], b["item_type"], b["blocked"], b["parent_id"]) == (None, "unknown", False, 6)
    assert (b["target_date"], b["assigned_to"], b["reasons"]) == (None, None, ["missing_remaining_work"])
    assert rows.where("item_id = 7").select(F.unix_seconds("created_at")).first()[0] == int(
        at("2026-09-01T10:00").timestamp()
    )


def test_blocked_by_state_tag_or_unknown(spark):
    items = spark.createDataFrame(
        [("t", "Stuck", None), ("t", "Doing", "x; Blocked")], "team_id string, state string, tags string"
    )
    by_tag = landed.derive_blocked(items, settings_frame(spark))
    assert rows_of(by_tag, "state", "blocked") == [("Doing", True), ("Stuck", False)]
    by_state = landed.derive_blocked(items, settings_frame(spark, {"blocked_states": ["Stuck"]}))
    assert rows_of(by_state, "state", "blocked") == [("Doing", False), ("Stuck", True)]
    unknown = landed.derive_blocked(items, settings_frame(spark, {"impediment_source": None}))
    assert rows_of(unknown, "blocked") == [(None,), (None,)]


CAPACITY = {
    "teamMembers": [
        {"teamMember": {"id": "g1", "displayName": "Ann", "uniqueName": "ann@x"},
         "activities": [{"name": "build", "capacityPerDay": 4}, {"name": "test", "capacityPerDay": None}],
         "daysOff": [{"start": "2026-09-16T00:00:00Z", "end": "2026-09-17T00:00:00Z"}, {"start": "soon"}]},
        {"teamMember": {"displayName": "Nobody"}, "activities": [{"capacityPerDay": 1}]},
        {"personId": "g2", "displayName": "Bob", "activities": []},
    ],
    "teamDaysOff": [{"start": "2026-09-18", "end": "2026-09-18"}],
}


def test_capacity_days_off_and_problems(spark):
    landing = payloads(spark, CAPACITY)
    members = landed.capacity_members(landing)
    reserved = landed.normalize_capacity(members, settings_frame(spark))
    assert rows_of(reserved, "person_id", "activity", "per_day", "unit") == [
        ("g1", "build", Decimal(4), "hours"), ("g1", "test", None, "hours"),
    ]
    off = landed.normalize_days_off(members, landing)
    assert rows_of(off, "person_id", "start", "end") == [
        ("g1", on("2026-09-16"), on("2026-09-18")), (None, on("2026-09-18"), on("2026-09-19")),
    ]
    problems = {(p, r) for _, p, r in rows_of(landed.capacity_problems(members))}
    assert problems == {
        ("g1", "no_daily_capacity"), ("g1", "undated_day_off"), (None, "no_person_id"),
        ("g2", "no_activity"),
    }
    absent = landed.team_days_off_lists(payloads(spark, {"teamMembers": []}))
    assert absent.first()["partial_source"] == "team_days_off"


def test_identities_resolve_by_login_name_then_text(spark):
    people = landed.capacity_people(landed.capacity_members(payloads(spark, CAPACITY, {
        "teamMembers": [{"teamMember": {"id": "g9", "displayName": "ann"}}]})))
    items = spark.createDataFrame(
        [("t", i, a) for i, a in enumerate(["Other <ANN@x>", "ann", "Bob <b@x>", "Zed <z@x>", None])],
        "team_id string, item_id int, assigned_to string",
    )
    resolved = reconcile_identity(items, people)
    assert rows_of(resolved, "item_id", "assigned_to", "reconciled") == [
        (0, "g1", True), (1, "g1", True), (2, "g2", True), (3, "Zed <z@x>", False), (4, None, True),
    ]
    merged = merge_people(people, resolved)
    assert rows_of(merged, "person_id") == [("Zed <z@x>",), ("g1",), ("g2",), ("g9",)]


ITERATIONS = {"iterations": [
    {"path": "P0", "attributes": {"startDate": "2026-09-01", "finishDate": "2026-09-13"}},
    {"name": "P1"},
    {"id": "i2", "path": "P2", "start": "2026-09-14", "endDate": "2026-09-18"},
    {"id": "i3", "path": "P3", "start": "2026-09-14", "endDate": "2026-09-30"},
]}


@pytest.mark.parametrize(
    ("wanted", "as_of", "path", "partial"),
    [(None, "2026-09-15T12:00", "P2", None), ("P0", "2026-09-15T12:00", "P0", None),
     ("P1", "2026-09-15T12:00", "P1", "iterations"), ("P9", "2026-09-15T12:00", "P2", None),
     ("P9", "2027-01-01T12:00", "P9", "iterations"), (None, "2026-09-19T02:00", "P2", None),
     (None, "2026-09-19T04:00", "P3", None)],
)
def test_iteration_choice(spark, wanted, as_of, path, partial):
    teams = spark.createDataFrame(
        [("t", "America/Sao_Paulo", at(as_of), wanted)],
        "team_id string, timezone string, as_of timestamp, wanted_path string",
    )
    chosen = scope.select_iteration(teams, landed.normalize_iterations(payloads(spark, ITERATIONS)))
    row = chosen.first()
    assert (row["iteration_path"], row["partial_source"]) == (path, partial)


def test_window_ends_at_local_midnight_across_a_clock_change(spark):
    frame = spark.createDataFrame(
        [("t", on("2026-03-27"), on("2026-03-29"), "Europe/Lisbon")],
        "team_id string, start date, finish date, timezone string",
    )
    row = scope.resolve_window(frame).select(
        F.unix_seconds("window_start"), F.unix_seconds("window_end")
    ).first()
    # Clocks go forward on the 29th: the last midnight is 23:00 UTC.
    assert row[0] == at("2026-03-27T00:00").timestamp()
    assert row[1] == at("2026-03-29T23:00").timestamp()


def test_hierarchy_and_batch_completeness(spark):
    links = landed.iteration_links(payloads(spark, {"workItemRelations": [
        {"rel": "X.Hierarchy-Forward", "source": {"id": 1}, "target": {"id": "2"}},
        {"rel": "X.Related", "source": {"id": 1}, "target": {"id": 3}},
        {"target": {"id": 1}}, {"rel": None, "target": {"id": "n/a"}}]}))
    items = landed.normalize_work_items(
        payloads(spark, [{"id": 2, "parentId": 1}, {"id": 3, "parentId": 2}]), settings_frame(spark)
    )
    edges = landed.hierarchy_relations(links, items)
    assert rows_of(edges, "parent_id", "child_id") == [(1, 2), (2, 3)]
    done = landed.batch_completeness(links, items).first()
    assert (done["requested"], done["returned"], done["partial_source"]) == (3, 2, "work_items")


def test_revisions(spark):
    rows = spark.createDataFrame(
        [("org", "t", 4, json.dumps([
            {"rev": 2, "fields": {"System.ChangedDate": "2026-09-01T10:00:00Z", "System.State": "Doing",
                                  "System.AssignedTo": {"uniqueName": "ann@x"}, "RemainingWork": 3}},
            {"changedDate": "2026-09-02T10:00:00+02:00", "System.State": "Odd"},
            {"rev": 3, "fields": {"System.State": "Doing"}}]))],
        "organization string, team_id string, item_id bigint, payload string",
    )
    states = spark.createDataFrame([("t", "Doing", "in_progress")], "team_id string, state string, state_category string")
    got = landed.normalize_revisions(rows, settings_frame(spark), states)
    assert rows_of(got, "revision", "state_category", "assigned_to", "remaining") == [
        (0, None, None, None), (2, "in_progress", "ann@x", Decimal(3)),
    ]


def test_process_discovery(spark):
    definitions = spark.createDataFrame(
        [("t", n, json.dumps(d)) for n, d in enumerate([
            {"states": [{"name": "Doing", "category": "InProgress"}, {"name": "Odd", "category": "Else"}],
             "fields": [{"referenceName": "Microsoft.VSTS.Scheduling.RemainingWork"}]},
            {"states": [{"name": "Doing", "category": "resolved"}, {"category": "Proposed"}]}])],
        "team_id string, type_order int, payload string",
    )
    assert rows_of(scope.discover_state_map(definitions)) == [("t", "Doing", "resolved")]
    assert rows_of(scope.unmapped_states(definitions), "state", "source") == [("Odd", "else")]
    assert rows_of(scope.discover_fields(definitions), "setting") == [("remaining_field",)]


def test_team_scope(spark):
    got = scope.discover_team_scope(payloads(
        spark, {"areas": [{"value": "a", "includeChildren": True}, {"name": "b", "includeChildren": False}, {}],
                "workingDays": [1, 5, 0, 9], "bugsBehavior": 2})).first()
    assert (got["area_paths"], got["include_descendants"], got["working_days"], got["bug_behavior"]) == (
        ["a", "b"], False, [0, 4, 6], "as_task",
    )
    silent = scope.discover_team_scope(payloads(spark, {"values": [{"path": "a"}]})).first()
    assert (silent["area_paths"], silent["include_descendants"]) == (["a"], None)


def test_strongest_layer_wins(spark):
    rows = [("default", "unit", "hours"), ("team", "unit", "days"), ("run", "unit", "points"),
            ("profile", "zone", "UTC"), ("unheard", "zone", "X")]
    layers = spark.createDataFrame([("t", *r) for r in rows], "team_id string, layer string, key string, value string")
    assert rows_of(scope.effective_settings(layers), "key", "value", "layer") == [
        ("unit", "points", "run"), ("zone", "UTC", "profile"),
    ]


def test_ids_of_any_length_are_kept(spark):
    long_id = 123456789012345678
    body = f'{{"id": {long_id}, "fields": {{"System.Parent": "{long_id - 1}", "System.State": "New"}}}}'
    payloads = spark.createDataFrame([("org", "t", 1, body)], "organization string, team_id string, arrival int, payload string")
    item = landed.normalize_work_items(payloads, settings_frame(spark)).first()
    assert (item["item_id"], item["parent_id"]) == (long_id, long_id - 1)


def test_a_missing_state_is_not_an_unmapped_one(spark):
    items = spark.createDataFrame(
        [(1, "t", "unknown"), (2, "t", "Odd"), (3, "t", "Doing"), (4, "t", None)],
        "item_id int, team_id string, state string",
    )
    state_map = spark.createDataFrame(
        [("t", "Doing", "in_progress"), ("t", "unknown", "completed")],
        "team_id string, state string, state_category string",
    )
    got = {r["item_id"]: (r["state_category"], r["state_reason"])
           for r in landed.map_state_category(items, state_map).collect()}
    assert got == {1: (None, None), 2: (None, "unmapped_state"), 3: ("in_progress", None), 4: (None, None)}


def test_configure_fuses_no_code_that_the_jvm_interprets(spark):
    name, before = "spark.sql.codegen.hugeMethodLimit", spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        for given, left in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(name, given)
            assert configure(spark).conf.get(name) == left
    finally:
        spark.conf.set(name, before)


def test_no_record_is_parsed_again_by_a_filter(spark):
    links = landed.iteration_links(payloads(spark, {"workItemRelations": [{"target": {"id": 1}}]}))
    items = landed.normalize_work_items(payloads(spark, [{"id": 2}]), settings_frame(spark))
    for df in (links.where("parent_id is not null"), items.where("parent_id is not null")):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        filters = [line for line in plan if line.lstrip(" :+-").startswith("Filter")]
        assert not any(f"MapType(StringType,StringType,true), {name}" in line
                       for line in filters for name in ("__record", "payload"))


def test_landed_fields_are_parsed_once_a_record(spark, tmp_path):
    from workload.registry import callables

    folder = str(tmp_path)
    spark.sql("""select 1L as l_orderkey, 2L as l_partkey, 3L as l_suppkey, 1 as l_linenumber,
        5d as l_quantity, 9d as l_extendedprice, 0.1d as l_discount, 0d as l_tax, 'N' as l_returnflag,
        'F' as l_linestatus, timestamp_ntz'1998-01-05 00:00:00' as l_shipdate""").write.parquet(
        f"{folder}/lineitem.parquet")
    spark.sql("select 3L as s_suppkey, 4 as s_nationkey").write.parquet(f"{folder}/supplier.parquet")
    spark.sql("select 4 as n_nationkey, 'X' as n_name").write.parquet(f"{folder}/nation.parquet")
    found = callables()["read_landed_payloads"](spark, folder)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    parses = "MapType(StringType,StringType,true), element_at(record"
    assert plan.count(parses) <= 2  # lines and files
    assert rows_of(found, "landed", "record_id", "title") == [
        ("file", "40", "X"), ("file", "42", "X"), ("line", "11", "part 2")]


def test_landed_lines_take_a_fraction_of_their_text(spark, tmp_path):
    """The landed copy is compressed: its plain text is many times the tables it comes from."""
    from plumbline.session import shared_folder
    from workload.registry import callables

    folder = str(tmp_path)
    spark.sql("""select id as l_orderkey, 2L as l_partkey, 3L as l_suppkey, 1 as l_linenumber,
        5d as l_quantity, 9d as l_extendedprice, 0.1d as l_discount,
        if(id % 2 = 0, 0.06d, 0d) as l_tax, 'N' as l_returnflag, 'F' as l_linestatus,
        timestamp_ntz'1998-01-05 00:00:00' as l_shipdate from range(2000)""").write.parquet(
        f"{folder}/lineitem.parquet")
    spark.sql("select 3L as s_suppkey, 4 as s_nationkey").write.parquet(f"{folder}/supplier.parquet")
    spark.sql("select 4 as n_nationkey, 'X' as n_name").write.parquet(f"{folder}/nation.parquet")
    shared = Path(shared_folder(spark).removeprefix("file:"))
    before = set(shared.rglob("lines/**/part-*"))
    found = callables()["read_landed_payloads"](spark, folder)
    landed_files = set(shared.rglob("lines/**/part-*")) - before
    assert sum(f.stat().st_size for f in landed_files) < 100 * 2000  # plain: 300 a line and more
    lines = found.where("landed = 'line'")
    assert lines.where("reason = 'not_json' and record_id is not null").count() == 1000
    assert lines.where("title = 'part 2'").select("record_id").distinct().count() == 1000
