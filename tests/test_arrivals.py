"""Batches of items against a stored state of first arrivals."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline.operators.cross_team import arrived_items, arrivals_state, deduplicate_items, merged_state
from plumbline.sources import arrivals, sinks

SCHEMA = "organization string, item_id bigint, arrival int, team_id string, team_memberships array<string>"


def frame(spark, rows):
    return spark.createDataFrame([("org", i, a, t, m) for i, a, t, m in rows], SCHEMA)


def found(items):
    columns = ["item_id", "arrival", "team_id", "team_memberships", "overlapping"]
    return sorted(tuple(row) for row in items.select(*columns).collect())


ROWS = [
    (1, 3, "t1", ["t1"]), (1, 1, "t2", ["t2"]), (1, 2, "t1", ["t1", "t3"]), (2, 1, "t1", ["t1"]),
    (3, 5, "t1", None), (2, 1, "t1", ["t1"]), (4, 9, "t4", ["t4"]), (1, 0, "t1", ["t1"]),
]


def test_batches_give_what_all_rows_give(spark, tmp_path):
    whole = found(deduplicate_items(frame(spark, ROWS), ["arrival"]))
    for number, order in enumerate(((0, 1, 2, 3), (3, 1, 0, 2))):
        root = str(tmp_path / str(number))
        assert arrivals.read_items(spark, root) is None
        for batch in order:
            part = frame(spark, ROWS[2 * batch : 2 * batch + 2])
            arrivals.add_batch(part, ["arrival"], f"b{batch}", root, most_parts=2)
        again = arrivals.add_batch(frame(spark, ROWS[:2]), ["arrival"], "b0", root)
        assert found(arrivals.read_items(spark, root)) == whole
        # Three parts became one; the last batch stands beside it or is in it.
        assert len(again.attempts) == 2 and not again.dropped


def test_an_empty_batch_counts_and_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "store")
    arrivals.add_batch(frame(spark, ROWS), ["arrival"], "all", root)
    before = found(arrivals.read_items(spark, root))
    arrivals.add_batch(frame(spark, []), ["arrival"], "none", root)
    assert found(arrivals.read_items(spark, root)) == before


def interleaved(monkeypatch, between):
    """Run ``between`` once, just before the next version is published."""
    commit, done = sinks.commit, []

    def later(*args, **more):
        if not done:
            done.append(True)
            between()
        return commit(*args, **more)

    monkeypatch.setattr(sinks, "commit", later)


def test_of_two_writers_of_one_batch_one_counts(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    part = frame(spark, ROWS[:2])
    interleaved(monkeypatch, lambda: arrivals.add_batch(part, ["arrival"], "b", root))
    state = arrivals.add_batch(part, ["arrival"], "b", root)
    assert len(state.attempts) == 1
    assert found(arrivals.read_items(spark, root)) == found(deduplicate_items(part, ["arrival"]))


def test_a_batch_added_while_parts_merge_is_kept(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    for batch in (0, 1):
        arrivals.add_batch(frame(spark, ROWS[4 * batch : 4 * batch + 3]), ["arrival"], f"b{batch}", root)
    rest = frame(spark, [ROWS[3], ROWS[7]])
    interleaved(monkeypatch, lambda: arrivals.add_batch(rest, ["arrival"], "rest", root))
    state = arrivals.merge_parts(spark, root)
    assert len(state.attempts) == 2
    whole = found(deduplicate_items(frame(spark, ROWS), ["arrival"]))
    assert found(arrivals.read_items(spark, root)) == whole


def test_two_mergers_lose_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    for batch in (0, 1):
        arrivals.add_batch(frame(spark, ROWS[4 * batch : 4 * batch + 4]), ["arrival"], f"b{batch}", root)
    interleaved(monkeypatch, lambda: arrivals.merge_parts(spark, root))
    state = arrivals.merge_parts(spark, root)
    assert len(state.attempts) == 1
    whole = found(deduplicate_items(frame(spark, ROWS), ["arrival"]))
    assert found(arrivals.read_items(spark, root)) == whole


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.sampled_from("ab"),
                          st.lists(st.sampled_from("xyz"), max_size=2)), max_size=10), st.integers(0, 10))
def test_states_merge(spark, rows, cut):
    states = [arrivals_state(frame(spark, part), ["arrival"]) for part in (rows[:cut], rows[cut:])]
    both = merged_state(states[0].unionByName(states[1]))
    assert found(arrived_items(both)) == found(deduplicate_items(frame(spark, rows), ["arrival"]))


def test_the_order_of_arrivals_is_held_once_and_read_back(spark):
    rows = frame(spark, ROWS)
    first = arrivals_state(rows, ["arrival"]).schema["first"].dataType
    assert "arrival" in first["at"].dataType.names and "arrival" not in first["row"].dataType.names
    assert deduplicate_items(rows, ["arrival"]).columns == [
        "item_id", "organization", "arrival", "team_id", "team_memberships", "overlapping"
    ]


def test_reading_the_store_shuffles_its_states_once(spark, tmp_path):
    root = str(tmp_path / "store")
    for batch in (0, 1):
        arrivals.add_batch(frame(spark, ROWS[4 * batch : 4 * batch + 4]), ["arrival"], f"b{batch}", root)
    plan = arrivals.read_items(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
