"""Run registered queries beside their oracle and report the ones that differ.

    python -m workload.compare [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')"
        )
    return connection


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        if isinstance(value, float) and math.isnan(value):
            return (0, "")
        return (2, f"{float(value):.9g}")
    return (3, str(value))


def normalised(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = sorted(tuple(_key(row[i]) for i in order) for row in rows)
    return sorted(columns), body


def difference(spark, connection, folder: str, run, sql: str) -> str | None:
    """None when both sides agree, else a short account of the first difference."""
    df = run(spark, folder)
    left = normalised(df.columns, [tuple(r) for r in df.collect()])
    answer = connection.execute(sql)
    right = normalised([d[0] for d in answer.description], answer.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] != right[1]:
        only_left = sorted(set(left[1]) - set(right[1]))[:3]
        only_right = sorted(set(right[1]) - set(left[1]))[:3]
        return (
            f"{len(left[1])} vs {len(right[1])} rows\n  columns {left[0]}"
            f"\n  spark only {only_left}\n  oracle only {only_right}"
        )
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    from workload import registry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(folder)
    runs, sqls = registry.callables(), registry.oracles()
    failed = 0
    for name in wanted or list(runs):
        begun = time.time()
        try:
            if name in sqls:
                problem = difference(spark, connection, folder, runs[name], sqls[name])
                rows = "ok"
            else:
                problem, rows = None, f"{runs[name](spark, folder).count()} rows, no oracle"
        except Exception as error:  # noqa: BLE001 - the report names the query and goes on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{name:32} {time.time() - begun:6.1f}s  {problem or rows}", flush=True)
    print(f"{failed} differ")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
