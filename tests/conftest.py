"""One local session for all tests, and small builders of logical tables."""

from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from plumbline.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


ITEM_SCHEMA = """organization string, item_id bigint, team_id string, item_type string, state string,
  state_category string, title string, assigned_to string, area_path string, iteration_path string,
  remaining decimal(18,4), remaining_unit string, blocked boolean, start_date date, target_date date,
  created_at timestamp, team_memberships array<string>, overlapping boolean"""
ITEM_NAMES = [part.split()[0] for part in ITEM_SCHEMA.replace("\n", " ").split(", ")]

SETTINGS_SCHEMA = """team_id string, capabilities array<string>, unit string, accounting_level string,
  timezone string, working_days array<int>, holidays array<date>, team_days_off array<date>,
  current_day_policy string, below decimal(9,4), within decimal(9,4), attention decimal(9,4),
  remaining_field string, original_estimate_field string, completed_work_field string,
  story_points_field string, impediment_source string, blocked_states array<string>,
  partial_sources array<string>, area_paths array<string>, include_descendants boolean"""
SETTINGS_NAMES = [part.split()[0] for part in SETTINGS_SCHEMA.replace("\n", " ").split(", ")]


def at(text: str) -> dt.datetime:
    """A UTC instant; the machine's own zone plays no part."""
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC)


def on(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def number(value) -> Decimal | None:
    return None if value is None else Decimal(str(value))


def items_frame(spark, rows):
    base = {
        "organization": "org", "team_id": "t", "item_type": "Task", "state": "Doing",
        "state_category": "in_progress", "remaining_unit": "hours", "team_memberships": ["t"],
        "overlapping": False,
    }
    full = []
    for row in rows:
        row = {**base, **row}
        row["remaining"] = number(row.get("remaining"))
        full.append(tuple(row.get(name) for name in ITEM_NAMES))
    return spark.createDataFrame(full, ITEM_SCHEMA)


def settings_frame(spark, *teams):
    base = {
        "team_id": "t", "capabilities": ["current_status", "allocation"], "unit": "hours",
        "accounting_level": "leaf_task", "timezone": "America/Sao_Paulo",
        "working_days": [0, 1, 2, 3, 4], "holidays": [], "team_days_off": [],
        "current_day_policy": "exclude", "below": Decimal("0.60"), "within": Decimal("0.90"),
        "attention": Decimal("1.10"), "remaining_field": "RemainingWork",
        "impediment_source": "tag:blocked", "blocked_states": [], "partial_sources": [],
        "area_paths": ["root"], "include_descendants": True,
    }
    rows = [tuple({**base, **team}.get(name) for name in SETTINGS_NAMES) for team in teams or ({},)]
    return spark.createDataFrame(rows, SETTINGS_SCHEMA)


def rows_of(df, *columns):
    return sorted(
        (tuple(row) for row in (df.select(*columns) if columns else df).collect()), key=repr
    )
