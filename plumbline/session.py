"""The session settings that results and their cost depend on, and the folder executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
# Fixed value: bytes of a method beyond which the JVM interprets it for ever.
JIT_LIMIT = 8000


def configure(spark: SparkSession) -> SparkSession:
    """Read instants and days in UTC, and fuse no code beyond what the JVM compiles.

    A wide parsing projection fused into one method beyond that size runs several times
    slower than operator by operator. Every other setting is the application's.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if int(spark.conf.get(HUGE_METHOD)) > JIT_LIMIT:
        spark.conf.set(HUGE_METHOD, str(JIT_LIMIT))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for data which all executors read."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    # Only a local session may go without: its one machine is driver and executor.
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, and read from there.

    It cuts the lineage at data that a lost executor leaves alone, and readers plan with its
    true size. The folder is the application's to remove.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
