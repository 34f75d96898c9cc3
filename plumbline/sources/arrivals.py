"""Items that arrive in batches, deduplicated against a stored state of first arrivals.

A batch is reduced to its own state, one row per item and list of teams, and added as a part;
earlier batches are neither read nor written for it. Parts are published by the numbered
manifest of the snapshot store, so a reader sees whole batches and of two writers none is
lost. Too many parts are merged into one, a shuffle of states by item.

A batch has an id and counts once: delivered again, also by two writers at a time or after a
failure half way, it changes nothing. Batches may come in any order.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.cross_team import arrivals_state, arrived_items, merged_state
from plumbline.sources import sinks

STATE = "state"
BATCHES = "batches"
#: Parts that a store holds before they are merged.
MOST_PARTS = 16


class _Known(Exception):
    """Another writer published the batch, or replaced the parts, in between."""


def _part(root: str, name: str, parts: Sequence[str], spark: SparkSession) -> DataFrame:
    return spark.read.parquet(*[f"{root}/{name}/attempt={part}" for part in parts])


def _holds(spark: SparkSession, root: str, parts: Sequence[str], batch: str) -> bool:
    if not parts:
        return False
    known = _part(root, BATCHES, parts, spark)
    return not known.where(known["batch"] == batch).isEmpty()


def _write(root: str, state: DataFrame, batches: DataFrame) -> str:
    """A new part, which nobody sees until a manifest names it."""
    part = f"a{uuid.uuid4().hex}"
    state.write.parquet(f"{root}/{STATE}/attempt={part}")
    batches.write.parquet(f"{root}/{BATCHES}/attempt={part}")
    return part


def _discard(spark: SparkSession, root: str, part: str) -> None:
    sinks.remove_attempts(spark, root, [STATE, BATCHES], [part])


def add_batch(
    items: DataFrame, arrival: Sequence[str], batch: str, root: str, most_parts: int = MOST_PARTS
) -> sinks.Manifest:
    """Add a batch of items to the store at ``root``, unless it is there already."""
    spark = items.sparkSession
    seen = sinks.read_manifest(spark, root)
    if _holds(spark, root, seen.attempts, batch):
        return seen
    part = _write(root, arrivals_state(items, arrival), spark.createDataFrame([(batch,)], "batch string"))

    def check(before: sinks.Manifest, now: sinks.Manifest) -> None:
        added = tuple(a for a in now.attempts if a not in set(before.attempts))
        if _holds(spark, root, added, batch):
            raise _Known

    try:
        seen = sinks.commit(
            spark, root, seen, lambda state: replace(state, attempts=(*state.attempts, part)), check
        )
    except _Known:
        _discard(spark, root, part)
        return sinks.read_manifest(spark, root)
    return merge_parts(spark, root) if len(seen.attempts) > most_parts else seen


def merge_parts(spark: SparkSession, root: str) -> sinks.Manifest:
    """Replace the parts of the store by one. Parts that others add meanwhile stay beside it."""
    seen = sinks.read_manifest(spark, root)
    old = seen.attempts
    if len(old) < 2:
        return seen
    part = _write(
        root, merged_state(_part(root, STATE, old, spark)), _part(root, BATCHES, old, spark).coalesce(1)
    )

    def check(before: sinks.Manifest, now: sinks.Manifest) -> None:
        if not set(old) <= set(now.attempts):
            raise _Known

    def change(state: sinks.Manifest) -> sinks.Manifest:
        beside = tuple(a for a in state.attempts if a not in set(old))
        return replace(
            state, attempts=(part, *beside), dropped=tuple(sorted({*state.dropped, *old}))
        )

    try:
        merged = sinks.commit(spark, root, seen, change, check)
    except _Known:
        _discard(spark, root, part)
        return sinks.read_manifest(spark, root)
    return sinks.cleared(spark, root, merged, [STATE, BATCHES])


def read_items(
    spark: SparkSession, root: str, manifest: sinks.Manifest | None = None
) -> DataFrame | None:
    """The deduplicated items of all batches, or None where there is no batch yet."""
    state = manifest or sinks.read_manifest(spark, root)
    if not state.attempts:
        return None
    return arrived_items(_part(root, STATE, state.attempts, spark))
