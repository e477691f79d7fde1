"""Drift against stored baselines: mergeable quantile sketches, one per period and feature.

A KLL sketch holds a few kilobytes whatever it has seen, and sketches of parts merge into one of the whole. So a day is
scanned once, when it is new; any window of days is compared from its stored sketches alone.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.functions import risk as R
from holdfast.functions.rounding import half_up

#: Size parameter of the stored sketches.
SIZE = 1024
#: Quantiles that stand for a sketch when shares are read from it: they add half a step to the rank error.
GRID = 2000


def rank_error(size: int = SIZE) -> float:
    """Bound of the error of a share: the published rank error of a KLL sketch at 99 % confidence, merged or not, and
    half a step of the grid. 0.47 % at the usual size."""
    return 2.296 / size**0.9021 + 0.5 / GRID


def sketch(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """(by..., feature, n, total, sketch) of the non-NULL values of each column, in one scan with partial aggregation."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    long = df.select(*by, F.inline(pairs)).where("value is not null and not isnan(value)")
    return long.groupBy(*by, "feature").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.kll_sketch_agg_double("value", size).alias("sketch"))


def merge(sketches: DataFrame, by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """One row per (by..., feature): the sketch of everything that the rows' sketches have seen."""
    return sketches.groupBy(*by, "feature").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch", size).alias("sketch"))


def quantile(sketched: Column, p: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketched, F.lit(float(p)))


def grid(sketched: Column) -> Column:
    """The quantiles in the middle of `GRID` equal shares, as an array."""
    return F.kll_sketch_get_quantile_double(sketched, F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)]))


def share_below(quantiles: Column, value: Column) -> Column:
    """Share of the values below `value`, from a sketch's grid. (A sketch's own rank function takes constants only.)"""
    return F.size(F.filter(quantiles, lambda q: F.round(q, 9) < value)) / F.lit(float(GRID))


def distribution_drift(expected: DataFrame, actual: DataFrame, buckets: int = K.PSI_BUCKETS, size: int = SIZE) -> DataFrame:
    """(feature, n_expected, n_actual, psi, status, greatest_shift, mean_shift, rank_error) of two sets of sketches.

    Buckets are the quantile bins of the expected side, as in `drift.psi_table`; edges and shares come from the merged
    sketches. `greatest_shift` is the largest difference of the two distribution functions at the edges, good to twice
    the rank error. Features that only one side has are left out.
    """
    quantiles = F.array(*[F.round(quantile(F.col("sketch"), i / buckets), 9) for i in range(1, buckets)])
    e, a = (merge(s, size=size).select("feature", F.col("n").alias(f"n_{x}"), F.col("total").alias(f"total_{x}"), grid(F.col("sketch")).alias(f"grid_{x}"), quantiles.alias(f"edges_{x}")) for s, x in ((expected, "e"), (actual, "a")))
    both = e.join(a, "feature")  # one row per column of the schema
    both = both.withColumn("edges", F.array_sort(F.array_distinct("edges_e")))
    for x in ("e", "a"):
        both = both.withColumn(f"below_{x}", F.transform("edges", lambda v: share_below(F.col(f"grid_{x}"), v)))
        ends = F.concat(F.array(F.lit(0.0)), f"below_{x}", F.array(F.lit(1.0)))
        share = F.zip_with(F.slice(ends, 2, F.size("edges") + 1), F.slice(ends, 1, F.size("edges") + 1), lambda hi, lo: hi - lo)
        both = both.withColumn(f"share_{x}", F.transform(share, lambda s: F.when(s <= 0, F.lit(K.PSI_EPSILON)).otherwise(s)))
    # a bucket that holds nothing on either side adds nothing
    psi = half_up(F.aggregate(F.zip_with("share_e", "share_a", lambda p, q: (q - p) * F.ln(q / p)), F.lit(0.0), lambda s, v: s + v), 4)
    shift = F.array_max(F.zip_with("below_e", "below_a", lambda p, q: F.abs(p - q)))
    mean = F.col("total_a") / F.col("n_a") - F.col("total_e") / F.col("n_e")
    return both.select(
        "feature", F.col("n_e").alias("n_expected"), F.col("n_a").alias("n_actual"), psi.alias("psi"), R.psi_status(psi).alias("status"),
        shift.alias("greatest_shift"), mean.alias("mean_shift"), F.lit(rank_error(size)).alias("rank_error"),
    )


def record(store, df: DataFrame, columns: Sequence[str], run_id: str, day: str = "day", table: str = "value_sketches", size: int = SIZE) -> None:
    """Append one sketch per day and feature of the rows of `df` to the stored ones; a rerun takes its old place."""
    store.write(table, sketch(df, columns, [day], size).withColumnRenamed(day, "day"), run_id, "append")


def stored(store, first: str, last: str, table: str = "value_sketches") -> DataFrame:
    """The stored sketches of the days from `first` to `last`; the values themselves are not read again."""
    return store.snapshot(table).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
