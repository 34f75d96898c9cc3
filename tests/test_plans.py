"""Describing a query starts no job but those that read the schema of its tables.

Sinks write, and claims are judged against a run's outputs, which are stored first.
"""

from pathlib import Path

import pytest

from workload import registry
from workload.compare import TABLES

FOLDER = "/root/testdata/sf0.001"
SINKS = {"append_snapshot", "remove_runs", "write_report", "read_landed_payloads"}
STORED = {"allowed_numbers", "validate_claims", "accepted_references"}

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are absent")


def test_describing_a_query_starts_no_job(spark, monkeypatch):
    from workload import bindings

    context = spark.sparkContext
    tables = bindings.Tables(spark, FOLDER)
    schemas = {name: tables.read(name).schema for name in TABLES}

    def known(self, name):
        return self.spark.read.schema(schemas[name]).parquet(f"{self.folder}/{name}.parquet")

    monkeypatch.setattr(bindings.Tables, "read", known)
    started = {}
    for name, run in registry.callables().items():
        if name not in SINKS | STORED:
            context.setJobGroup(f"describe-{name}", name)
            run(spark, FOLDER)
            jobs = context.statusTracker().getJobIdsForGroup(f"describe-{name}")
            if jobs:
                started[name] = len(jobs)
    context.setJobGroup("after", "after")
    assert started == {}


def test_claims_read_stored_outputs_only(spark):
    """The verdicts' own plan does not come to the items' source: they are computed once."""
    df = registry.callables()["validate_claims"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    first = plan.split("== Initial Plan ==")[-1]
    assert "l_orderkey" not in first and "s_acctbal" not in first
    shuffles = sum("Exchange hashpartitioning" in line for line in first.splitlines())
    assert shuffles <= 20
