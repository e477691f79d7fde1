"""Intermediate results that are computed once: written to the shared folder and read back."""

import uuid

from pyspark.sql import DataFrame

from holdfast.sources.tables import work_dir


def kept(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it from there.

    Cuts the lineage and survives lost executors; whatever reads it sees the same rows in the same files. The folder
    goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/kept/{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
