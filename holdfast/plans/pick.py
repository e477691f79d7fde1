"""First, last and top rows per key, combined on the map side so that a hot key stays cheap."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], choose) -> DataFrame:
    payload = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    # max_by/min_by keep one struct per key in each task before the shuffle
    picked = df.groupBy(*keys).agg(choose(payload, F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest `order` tuple per key."""
    return _pick(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the smallest `order` tuple per key."""
    return _pick(df, keys, order, F.min_by)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """At most `n` rows per key. Spark limits each group before the shuffle (group limit)."""
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)
