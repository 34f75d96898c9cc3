"""Shared tables, word rules and Arrow helpers of the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words of the contracts.
SPACE = "\x20\x09-\x0d"
WORD = f"[^{SPACE}]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Only a local session may go without: its one machine is driver and executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the application's id marks who may remove it."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/llm-{application}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there.

    It cuts lineage, survives lost executors, and gives the planner the true size.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's own setting by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> None:
    """Write ``df`` to ``path`` and let the shuffle files of the writing go.

    The table stands in their place: later readers, also those of a lost executor's work,
    read it.
    """
    with cleaned(df.sparkSession):
        df.write.parquet(path)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """The setting of ``CLEANUP`` for the writes inside alone."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scratch:
    """Stored tables of one computation, each removed once its last reader has run.

    What comes after them is stored itself, so a lost executor never asks for them again.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: list[tuple[DataFrame, str]] = []
        self.tables: dict[str, str] = {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        written(df, path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((found, path))
        return found

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """``df`` as a table of as many buckets by ``key`` as shuffles have partitions.

        Joins by ``key`` send their other side to the buckets and leave the table in place.
        """
        path, table_name = shared_path(self.spark, name), f"{name}_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with cleaned(self.spark):
            writer = df.write.format("parquet").bucketBy(buckets, key).option("path", path)
            writer.saveAsTable(table_name)
        found = self.spark.table(table_name)
        self.held.append((found, path))
        self.tables[path] = table_name
        return found

    def release(self, *frames: DataFrame) -> None:
        """Remove the tables that :meth:`stored` gave; their readers have run."""
        gone = [path for held, path in self.held if any(held is frame for frame in frames)]
        self.held = [(held, path) for held, path in self.held if path not in gone]
        for name in gone:
            if name in self.tables:
                self.spark.sql(f"drop table {self.tables.pop(name)}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clean(self) -> None:
        """Let the shuffle files go that no plan refers to any more.

        Spark removes them when the driver's JVM finds that out; plans are small, so without
        asking it may not look before the disks are full.
        """
        gc.collect()
        self.spark._jvm.System.gc()

    def release_all_but(self, *frames: DataFrame) -> None:
        keep = [held for held, _ in self.held if not any(held is frame for frame in frames)]
        self.release(*keep)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as one name, dots included."""
    return f"`{name}`"


def text_of(column: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(folds: int, id_column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id is never held out."""
    remainder = F.crc32(F.encode(F.col(id_column).cast("string"), "UTF-8")) % folds
    return F.coalesce(remainder == 0, F.lit(False))


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows from an iterator of tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type) for values, field in zip(columns, schema, strict=True)],
        schema=schema,
    )
