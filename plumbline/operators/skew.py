"""Joins and ordered operations that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tasks that the rows of a hot key are spread over.
SALTS = 32

_HOT = "__hot"
_SALT = "__salt"
_SLICE = "__slice"


def spread(df: DataFrame) -> DataFrame:
    """Spread an input with fewer splits than the session has cores over all of them.

    A table of many files or row groups already has more and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def attach(
    facts: DataFrame,
    dimension: DataFrame,
    on: Sequence[str] | str,
    how: str = "left",
    *,
    bounded: bool = False,
) -> DataFrame:
    """Join a large table with a dimension; describing the join starts no job.

    A dimension whose files are small is broadcast by Spark itself, and adaptive execution
    does so for a derived one once its size is known, or else splits hot keys of the
    shuffled join. ``bounded`` is for a dimension whose rows the caller's contract bounds.
    """
    keys = [on] if isinstance(on, str) else list(on)
    return facts.join(F.broadcast(dimension) if bounded else dimension, keys, how)


def salted_join(
    facts: DataFrame,
    dimension: DataFrame,
    on: Sequence[str],
    how: str,
    hot: DataFrame,
    *,
    salts: int = SALTS,
) -> DataFrame:
    """A shuffled join that spreads the keys of ``hot``, which the caller knows, over tasks.

    Only their rows get a salt and only their dimension rows are repeated. The salt is a
    hash of the row's own values: a task that is run again puts every row where the first
    attempt put it.
    """
    keys = list(on)
    marked = hot.select(*keys).distinct().withColumn(_HOT, F.lit(True))
    hashable = [
        F.col(f"`{f.name}`")
        for f in facts.schema.fields
        if not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    is_hot = F.coalesce(_HOT, F.lit(False))
    zero = F.lit(0).cast("bigint")
    spread = F.pmod(F.xxhash64(*hashable), F.lit(salts))
    left = facts.join(marked, keys, "left").withColumn(
        _SALT, F.when(is_hot, spread).otherwise(zero)
    )
    every_salt = F.sequence(zero, F.lit(salts - 1).cast("bigint"))
    right = dimension.join(marked, keys, "left").withColumn(
        _SALT, F.explode(F.when(is_hot, every_salt).otherwise(F.array(zero)))
    )
    return left.drop(_HOT).join(right.drop(_HOT), [*keys, _SALT], how).drop(_SALT)


def day_slice(moment: Column) -> Column:
    """Default slice of an ordered group: the UTC day."""
    return F.unix_date(moment.cast("date")).cast("bigint")


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    slice_by: Column,
    prefix: str = "previous_",
) -> DataFrame:
    """Per row, the given values of the row before it in its group.

    The same result as ``lag`` over the whole group, computed per slice of the
    order, so a group is never sorted in one task: inside a slice by ``lag``, and
    for a slice's first row from the last row of the slice before. ``slice_by``
    must not decrease along ``order``. ``<prefix>exists`` tells a missing previous
    row from a missing value.
    """
    sliced = df.withColumn(_SLICE, slice_by)
    inside = W.partitionBy(*keys, _SLICE).orderBy(*order)
    packed = F.struct(*values)
    rows = sliced.withColumn("__before", F.lag(packed).over(inside))

    across = W.partitionBy(*keys).orderBy(_SLICE)
    carried = (
        sliced.groupBy(*keys, _SLICE)
        .agg(F.max_by(packed, F.struct(*order)).alias("__last"))
        .withColumn("__carried", F.lag("__last").over(across))
        .select(*keys, _SLICE, "__carried")
    )
    before = F.coalesce("__before", "__carried")
    joined = rows.join(carried, [*keys, _SLICE], "left")
    return joined.select(
        *df.columns,
        before.isNotNull().alias(f"{prefix}exists"),
        *[before[c].alias(f"{prefix}{c}") for c in values],
    )


def position_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    alias: str,
) -> DataFrame:
    """``row_number`` over each group, computed slice by slice like :func:`previous_row`."""
    sliced = df.withColumn(_SLICE, slice_by)
    across = (
        W.partitionBy(*keys).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    offsets = (
        sliced.groupBy(*keys, _SLICE)
        .agg(F.count(F.lit(1)).alias("__size"))
        .withColumn("__offset", F.sum("__size").over(across) - F.col("__size"))
        .select(*keys, _SLICE, "__offset")
    )
    inside = W.partitionBy(*keys, _SLICE).orderBy(*order)
    return (
        sliced.withColumn("__inside", F.row_number().over(inside))
        .join(offsets, [*keys, _SLICE])
        .select(*df.columns, (F.col("__offset") + F.col("__inside")).alias(alias))
    )
