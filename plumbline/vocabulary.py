"""Closed vocabularies and fixed values shared by the operators."""

from __future__ import annotations

from decimal import Decimal

# State categories.
PROPOSED = "proposed"
IN_PROGRESS = "in_progress"
RESOLVED = "resolved"
COMPLETED = "completed"
REMOVED = "removed"
STATE_CATEGORIES = (PROPOSED, IN_PROGRESS, RESOLVED, COMPLETED, REMOVED)
CLOSED = (COMPLETED, REMOVED)

# Metric status.
AVAILABLE = "available"
PARTIAL = "partial"
UNAVAILABLE = "unavailable"
NOT_APPLICABLE = "not_applicable"

# Load classes.
NO_RECORDED_LOAD = "NO_RECORDED_LOAD"
BELOW = "BELOW"
WITHIN = "WITHIN"
ATTENTION = "ATTENTION"
ABOVE = "ABOVE"
INSUFFICIENT_DATA = "INSUFFICIENT_DATA"
LOAD_WITHOUT_CAPACITY = "LOAD_WITHOUT_CAPACITY"
UNASSIGNED = "UNASSIGNED"
UNASSIGNED_PERSON = "(unassigned)"

# Default class boundaries, as shares of capacity.
BELOW_LIMIT = Decimal("0.60")
WITHIN_LIMIT = Decimal("0.90")
ATTENTION_LIMIT = Decimal("1.10")

# Accounting levels and the relation kind they exclude along.
LEAF_TASK = "leaf_task"
REQUIREMENT = "requirement"
HIERARCHY = "hierarchy"

# Policies for the current day.
EXCLUDE_TODAY = "exclude"
INCLUDE_TODAY = "include_full"

UNKNOWN_LABEL = "unknown"
ITEMS_UNIT = "items"

# Severity order of findings; an unlisted severity sorts last.
SEVERITIES = ("critical", "high", "attention", "info")
UNRANKED_SEVERITY = 99

# Sample size below which percentiles are flagged.
SMALL_SAMPLE = 20

# Forecast limits.
MIN_WEEKS = 12
MIN_COMPLETIONS = 30
FORECAST_ITERATIONS = 10_000
MAX_PERIODS = 520
DEFAULT_SEED = 20260913

# Report limits.
SUMMARY_BYTES = 24_576
TOP_DECISIONS = 3
MAX_ACCEPTED_ACTIONS = 3
EVIDENCE_PAGE = 50
TITLE_EXCERPT = 80

# Run limits.
RETENTION_DAYS = 30
STALE_AFTER_HOURS = 26
