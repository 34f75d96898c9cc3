"""Import the query modules, so that the catalog is complete, and expose it."""

from workload import (  # noqa: F401
    forecast_queries,
    history_queries,
    load_queries,
    planning_queries,
    report_queries,
    source_queries,
)
from workload.catalog import callables, oracles

__all__ = ["callables", "oracles"]
