"""Global order statistics without a one-task window.

A running total over a whole table needs a total order, which a plain window would sort in one
task. Here the table is first reduced to one row per distinct value (equal values, however many,
combine on the map side) and written once. The counted rows say how many partitions they need; they
are dealt by ranges of (group, value), each partition adds up its own rows, and the totals of the
partitions before are joined to it. A task never holds more than about `ROWS` distinct values.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.plans.kept import kept

#: Rows (distinct values) of a range partition.
ROWS = 1_000_000


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, value, n): how often each non-NULL value of each column occurs."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    long = df.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.*").where(F.col("value").isNotNull())
    return long.groupBy(*by, "feature", "value").agg(F.count("*").alias("n"))


def running_totals(df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """Add `<s>_upto` (inclusive running total along `order`) and `<s>_total` for each summed column.

    `df` holds one row per (by, order), with no columns but `by`, `order` and `sums`. It is computed at once and
    kept (see `plans/kept.py`); partition numbers are written beside the rows, so every read sees the same ranges.
    The totals of partitions are one row per partition and group in it, which is at most partitions plus groups;
    `by` names schema-sized groups (features, models, folds).
    """
    by = list(by)
    counts = kept(df)
    parts = math.ceil(counts.count() / rows)  # from the files' footers
    if parts > 1:
        counts = kept(counts.repartitionByRange(parts, *by, order).withColumn("_part", F.spark_partition_id()))
    else:
        counts = counts.withColumn("_part", F.lit(0))

    groups = W.partitionBy(*by)
    per_part = counts.groupBy(*by, "_part").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    offsets = per_part.select(
        *by, "_part",
        *[F.coalesce(F.sum(f"_{s}").over(groups.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_{s}_below") for s in sums],
        *[F.sum(f"_{s}").over(groups).alias(f"{s}_total") for s in sums],
    )
    within = W.partitionBy(*by, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = counts.join(F.broadcast(offsets), [*by, "_part"])
    return out.select(
        *df.columns,
        *[(F.col(f"_{s}_below") + F.sum(s).over(within)).alias(f"{s}_upto") for s in sums],
        *[f"{s}_total" for s in sums],
    )


def quantile_aggregates(probs: Sequence[float], weight: str = "n") -> list[Column]:
    """Aggregates over `running_totals` that find, for each p, the values at the ranks around p*(n-1)."""

    def at_rank(rank: Column) -> Column:
        holds = (F.col(f"{weight}_upto") > rank) & (F.col(f"{weight}_upto") - F.col(weight) <= rank)
        return F.max(F.when(holds, F.col("value")))

    picks = []
    for p in probs:
        place = F.lit(float(p)) * (F.col(f"{weight}_total") - 1)
        low, high = at_rank(F.floor(place)), at_rank(F.ceil(place))
        picks.append(low + (high - low) * F.max(place - F.floor(place)))
    return picks


def quantiles(counts: DataFrame, probs: Sequence[float], by: Sequence[str] = ("feature",)) -> DataFrame:
    """Exact interpolated quantiles of weighted values: (by..., n, quantiles array).

    `counts` is (by..., value, n). A quantile at p sits at rank p*(n-1), linearly between neighbours.
    """
    spans = running_totals(counts, "value", ["n"], by)
    return spans.groupBy(*by).agg(F.max("n_total").alias("n"), F.array(*quantile_aggregates(probs)).alias("quantiles"))
