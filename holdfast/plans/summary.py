"""Summaries over several dimensions in one scan, and reports with sections of different shape."""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def explode_dimensions(df: DataFrame, dims: Mapping[str, Column], keep: Sequence[str | Column]) -> DataFrame:
    """One row per (input row, dimension); the aggregate behind it combines before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("segment")) for d, c in dims.items()])
    long = df.select(F.explode(pairs).alias("_d"), *keep)
    return long.select("_d.*", *long.columns[1:])


def stack_sections(sections: Mapping[str, DataFrame], schema: T.StructType, tag: str = "section") -> DataFrame:
    """Union of frames with different columns; columns a section lacks become typed NULLs."""

    def fit(name: str, df: DataFrame) -> DataFrame:
        cols = [
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
        ]
        return df.select(F.lit(name).alias(tag), *cols)

    return reduce(DataFrame.unionByName, [fit(n, d) for n, d in sections.items()])


def with_levels(df: DataFrame, column: str, levels: Sequence[str], fill: Mapping[str, object]) -> DataFrame:
    """Right-join an aggregate to a fixed level list, so that absent levels appear with `fill`."""
    spark = df.sparkSession
    frame = spark.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in levels])).alias("_place", column))
    return F.broadcast(frame).join(df, column, "left").fillna(dict(fill)).orderBy("_place").select(*df.columns)
