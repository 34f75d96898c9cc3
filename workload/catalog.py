"""Every registered query: the Spark operator and, where SQL can state it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workload.bindings import Tables


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``."""

    def register(run: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        CATALOG[name] = Query(run, sql)
        return run

    return register


def comparable(df: DataFrame) -> DataFrame:
    """Publish a result in types both engines print alike.

    Decimals become doubles with six decimals, dates ISO text, instants microseconds
    and arrays comma-separated text.
    """

    def plain(field: T.StructField):
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DecimalType):
            column = F.round(column, 6).cast("double")
        elif isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, T.TimestampType):
            column = F.unix_micros(column)
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), ",")
        elif isinstance(kind, (T.ShortType, T.ByteType, T.IntegerType)):
            column = column.cast("bigint")
        return column.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(run):
        return lambda spark, folder: comparable(run(Tables(spark, folder)))

    return {name: bind(entry.run) for name, entry in CATALOG.items()}


def oracles() -> dict[str, str]:
    return {name: entry.sql for name, entry in CATALOG.items() if entry.sql is not None}
