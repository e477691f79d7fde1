"""Helpers shared by the operators: reading tables, cutting lineage, size-checked broadcasts, text pieces."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows stay below this size.
BROADCAST_BYTES = 32 << 20
#: Rows that a Python worker gets at a time.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; a temporary one only on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives lost executors, is computed once.

    The folder goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a stored table for broadcast if its counted size is proven small; otherwise leave the join to AQE."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def bounded(df: DataFrame, size: str) -> DataFrame:
    """As `small`, by the sum of a column that holds each row's bytes."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, with its session set to hand few rows at a time to Python workers: texts and sets of n-grams are long rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


def text_of(column: str) -> F.Column:
    """A text column as string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))

