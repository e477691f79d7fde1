"""Correlations, histograms, box-plot figures."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.functions.customer import churned
from holdfast.functions.rounding import half_up
from holdfast.functions.tails import student_two_sided
from holdfast.plans.ordered import quantiles, value_counts

EDA_NUMERICS = ["tenure", "monthly_charges", "total_charges", "senior_citizen"]


def numeric_correlations(df: DataFrame, columns: Sequence[str], label: Column) -> DataFrame:
    """(feature, r, n): Pearson r of numeric columns with a 0/1 label, from one aggregate row."""
    pairs = [(F.col(c).cast("double"), c) for c in columns]
    y = label.cast("double")
    entries = [F.struct(F.lit(name).alias("feature"), F.corr(x, y).alias("r"), F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("n")) for x, name in pairs]
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def dummy_correlations(df: DataFrame, columns: Sequence[str], label: Column) -> DataFrame:
    """(feature, r): Pearson r of every category level with a 0/1 label.

    For two 0/1 columns r follows from counts, so the levels come from one grouped count and need
    not be known beforehand.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("level")) for c in columns])
    long = df.select(F.explode(pairs).alias("_p"), label.cast("double").alias("y")).select("_p.*", "y").where(F.col("level").isNotNull())
    counts = long.groupBy("column", "level").agg(F.count("*").cast("double").alias("n1"), F.sum("y").alias("n11"))
    totals = df.agg(F.struct(F.count("*").cast("double").alias("n"), F.sum(label.cast("double")).alias("c"))).scalar()
    n, c = totals.getField("n"), totals.getField("c")
    spread = F.sqrt(F.col("n1") * (n - F.col("n1")) * c * (n - c))
    r = (n * F.col("n11") - F.col("n1") * c) / F.nullif(spread, F.lit(0.0))
    return counts.select(F.concat_ws("_", "column", "level").alias("feature"), r.alias("r"))


def top_correlations(rc: DataFrame, n: int = 5, numerics: Sequence[str] = EDA_NUMERICS, categories: Sequence[str] = K.CATEGORICAL_COLUMNS) -> DataFrame:
    """The n features (numerics and category levels) most correlated with churn, by |r|."""
    y = churned(F.col("churn"))
    both = numeric_correlations(rc, numerics, y).select("feature", "r").unionByName(dummy_correlations(rc, categories, y))
    known = both.where(F.col("r").isNotNull() & ~F.isnan("r")).select("feature", half_up(F.col("r"), 6).alias("correlation"))
    return known.orderBy(F.desc(F.abs("correlation")), "feature").limit(n)


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form (x, y, r), from one aggregate row."""
    entries = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), half_up(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias("r"))
        for i, a in enumerate(columns) for b in columns[i:]
    ]
    upper = df.agg(F.array(*entries).alias("e")).select(F.inline("e"))
    return upper.unionByName(upper.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y"), "r"))


def point_biserial(rc: DataFrame, columns: Sequence[str] = K.NUMERIC_COLUMNS) -> DataFrame:
    """r of each numeric with churn, with n and the t statistic of r (see `significance` for its p-value)."""
    r = numeric_correlations(rc, columns, churned(F.col("churn")))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    return r.select("feature", half_up(F.col("r"), 4).alias("point_biserial_r"), "n", half_up(t, 4).alias("t_statistic"))


def significance(rc: DataFrame, columns: Sequence[str] = K.NUMERIC_COLUMNS) -> DataFrame:
    """(feature, n, p_value): the two-sided p-value of each numeric's correlation with churn, by Student's t with n - 2
    degrees of freedom. Null where r is undefined or n is below 3."""
    r = numeric_correlations(rc, columns, churned(F.col("churn")))
    rest = 1 - F.col("r") * F.col("r")
    t = F.when(rest <= 0, float("inf")).otherwise(F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(rest, F.lit(0.0))))
    known = F.col("r").isNotNull() & ~F.isnan("r")
    return r.select("feature", "n", F.when(known, student_two_sided(t, F.col("n") - 2)).alias("p_value"))


def histogram(df: DataFrame, column: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal-width bins over the range of the whole column; the last bin is closed."""
    x = F.col(column).cast("double")
    ends = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    lo, hi = ends.getField("lo"), ends.getField("hi")
    width = (hi - lo) / bins
    place = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((x - lo) * bins / F.nullif(hi - lo, F.lit(0.0))), F.lit(bins - 1)))
    binned = df.where(x.isNotNull()).groupBy(*by, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return binned.select(*by, "bin", half_up(lo + F.col("bin") * width, 6).alias("bin_start"), half_up(lo + (F.col("bin") + 1) * width, 6).alias("bin_end"), "n")


def box_stats(df: DataFrame, column: str, by: str) -> DataFrame:
    """Five-number summary, 1.5 IQR fences and number of outliers per group (exact quartiles)."""
    counts = value_counts(df.where(F.col(by).isNotNull()), [column], [by])
    q = quantiles(counts, [0.0, 0.25, 0.5, 0.75, 1.0], [by, "feature"])
    iqr = F.col("quantiles")[3] - F.col("quantiles")[1]
    fences = q.withColumns({"lower_fence": F.col("quantiles")[1] - 1.5 * iqr, "upper_fence": F.col("quantiles")[3] + 1.5 * iqr})
    # one row per group and column
    placed = counts.join(F.broadcast(fences.withColumnRenamed("n", "size")), [by, "feature"])
    outside = F.when(~F.col("value").between(F.col("lower_fence"), F.col("upper_fence")), F.col("n")).otherwise(0)
    names = ["min", "q1", "median", "q3", "max"]
    table = placed.groupBy(by).agg(
        F.any_value("size").cast("long").alias("n"), F.any_value("quantiles").alias("quantiles"),
        F.any_value("lower_fence").alias("lower_fence"), F.any_value("upper_fence").alias("upper_fence"), F.sum(outside).cast("long").alias("outliers"),
    )
    return table.select(
        by, "n", *[half_up(F.col("quantiles")[i], 6).alias(name) for i, name in enumerate(names)],
        half_up(F.col("lower_fence"), 6).alias("lower_fence"), half_up(F.col("upper_fence"), 6).alias("upper_fence"), "outliers",
    )
