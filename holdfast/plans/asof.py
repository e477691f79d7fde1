"""As-of join: for every row the last row of another table before the row's own time."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.plans.kept import kept

#: Rows of a range partition.
ROWS = 1_000_000


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, name: str = "asof", ties: Sequence[str] = (), same_instant: bool = False, rows: int = ROWS) -> DataFrame:
    """`left` with a column `name`: the struct of the last row of `right` of the same keys before `left_time`.

    Rows at the same instant count only if `same_instant`; of equally late rows the one with the greatest `ties` is
    taken. Without such a row, or with a null key or time, the column is null; every left row comes out once.

    Both tables are united, with a tag, and sorted once: the last right row so far is the answer, so no pairs are made
    however many rows a key has. The rows are dealt by ranges of (keys, time), so a key with a third of all rows is
    spread over as many tasks as it needs; the last right row of such a key's earlier ranges is carried over to its later
    ones. A partition has at most two keys that it shares with others, which bounds what is carried.
    """
    keys = list(keys)
    place = [F.col(f"_k{i}") for i in range(len(keys))]

    def tagged(df: DataFrame, time: str, is_right: bool) -> DataFrame:
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        tie = F.struct(*[F.col(f"`{c}`") for c in ties]) if is_right and ties else F.lit(None)
        return df.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col(f"`{time}`").alias("_time"), F.lit(int(is_right)).alias("_right"), (row if not is_right else F.lit(None)).alias("_l"), (row if is_right else F.lit(None)).alias("_r"), tie.alias("_tie"))

    found = tagged(right, right_time, True)
    for c in [*place, F.col("_time")]:
        found = found.where(c.isNotNull())
    both = kept(tagged(left, left_time, False).unionByName(found))
    parts = math.ceil(both.count() / rows)
    if parts > 1:
        both = kept(both.repartitionByRange(parts, *place, "_time").withColumn("_part", F.spark_partition_id()))
    else:
        both = both.withColumn("_part", F.lit(0))

    within = W.partitionBy("_part", *place).orderBy(F.col("_time").asc_nulls_first(), F.desc("_right") if same_instant else F.asc("_right"), "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    so_far = both.withColumn("_last", F.last("_r", ignorenulls=True).over(within)).where("_right = 0")
    carried = F.lit(None)
    if parts > 1:
        # a partition's last right row of each key that other partitions have too
        last = F.max_by("_r", F.when(F.col("_right") == 1, F.struct("_time", "_tie"))).alias("_end")
        ends = both.groupBy("_part", *place).agg(last).withColumn("_n", F.count("*").over(W.partitionBy(*place))).where("_n > 1")
        earlier = W.partitionBy(*place).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        names = [F.col(f"_k{i}").alias(f"_c{i}") for i in range(len(keys))]
        ends = ends.select(F.col("_part").alias("_cpart"), *names, F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
        same: Column = F.col("_part") == F.col("_cpart")
        for i in range(len(keys)):
            same = same & (F.col(f"_k{i}") == F.col(f"_c{i}"))
        so_far = so_far.join(F.broadcast(ends), same, "left")  # at most two keys of a partition
        carried = F.col("_carried")
    known = F.col("_time").isNotNull()
    return so_far.select(F.col("_l.*"), F.when(known, F.coalesce(F.col("_last"), carried)).alias(name))
