"""What a run produced, computed once and stored for every check that reads it.

Claims are judged against all numbers and references of a run, and the same outputs are read
by several branches of that judgement. Composed as one plan, every branch would read the
items anew, and Spark would plan hundreds of joins before it finds the equal ones. Here the
stages are cut where several branches meet: accountable items, capacities and metrics are
written to the folder that all executors share and read from there. A lost executor costs the
tasks of one stage, and what is planned next sees true sizes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from plumbline.operators import claims, load, quality
from plumbline.session import stored

#: What loads, findings and metrics read of an item.
_ITEM = [
    "organization", "item_id", "team_id", "state_category", "assigned_to", "remaining",
    "remaining_unit", "blocked",
]


@dataclass(frozen=True)
class RunOutputs:
    """Outputs with run_id, out of stored tables: metrics, people's loads, findings, evidence."""

    metrics: DataFrame
    people: DataFrame
    findings: DataFrame
    evidence: DataFrame

    def numbers(self) -> DataFrame:
        """Every number that the run produced."""
        return claims.allowed_numbers(self.metrics, self.people, self.evidence, self.findings)

    def references(self) -> DataFrame:
        return claims.known_references(self.metrics, self.evidence)

    def verdicts(self, made: DataFrame, banned: DataFrame) -> DataFrame:
        """The claims that the run's outputs bear out."""
        numbers = claims.produced_numbers(
            self.metrics, self.people, self.evidence, self.findings
        )
        judged = claims.judged_claims(made, self.references(), numbers, banned)
        return claims.limited(stored(judged, "judged"))


def run_outputs(
    accountable: DataFrame,
    in_window: Column,
    people: DataFrame,
    settings: DataFrame,
    reservations: DataFrame,
    capacities: DataFrame,
    evidence: DataFrame,
) -> RunOutputs:
    """Compute and store the outputs of every team's run, whose id is the team's.

    ``in_window`` tells which accountable items are in the sprint that metrics and people's
    loads are about; findings are about all of them. ``evidence`` has run_id and item_id.
    """
    items = stored(accountable.select(*_ITEM, in_window.alias("in_window")), "accountable")
    sprint = items.where("in_window").drop("in_window")
    held = stored(capacities, "capacities")

    metrics = stored(quality.team_metrics(sprint, settings, reservations, held), "metrics")
    outputs = (
        metrics,
        load.person_load(people, sprint, settings, held),
        load.load_findings(items, settings),
    )
    return RunOutputs(*[o.withColumnRenamed("team_id", "run_id") for o in outputs], evidence)
