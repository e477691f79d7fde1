"""Cohorts and trends by implied join date.

The join date is implied from tenure, so a trend over join months shows how churn varies with
tenure. It is no reading of the company's churn rate over time.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast import constants as K
from holdfast.functions.customer import churned
from holdfast.functions.lookups import listed
from holdfast.functions.rounding import half_up, rate_pct
from holdfast.operators.features import with_implied_join


def _churned_sum() -> Column:
    return F.sum(churned(F.col("churn")))


def cohort_table(rc: DataFrame, reference: Column) -> DataFrame:
    """Weekly cohorts (weeks start on Monday): size, churned, churn and retention rate."""
    weekly = with_implied_join(rc.select("customer_id", "tenure", "churn"), reference).where(F.col("join_week").isNotNull())
    table = weekly.groupBy(F.col("join_week").alias("cohort_week")).agg(
        F.count("customer_id").alias("cohort_size"), _churned_sum().alias("churned"), rate_pct(_churned_sum(), F.count("customer_id")).alias("churn_rate_pct")
    )
    return table.withColumn("retention_rate_pct", half_up(100.0 - F.col("churn_rate_pct"), 2)).orderBy("cohort_week")


def retention_by_contract(rc: DataFrame, reference: Column) -> DataFrame:
    """Retention rate per cohort week and contract, in long form: whatever contracts the data hold."""
    weekly = with_implied_join(rc.select("customer_id", "tenure", "churn", "contract"), reference).where(F.col("join_week").isNotNull())
    kept = half_up(100.0 - F.lit(100.0) * _churned_sum() / F.nullif(F.count("customer_id"), F.lit(0)), 2)
    return weekly.groupBy(F.col("join_week").alias("cohort_week"), "contract").agg(kept.alias("retention_rate_pct"))


def retention_pivot(rc: DataFrame, reference: Column, weeks: int | None = 20) -> DataFrame:
    """The same with a column for each known contract, for the latest `weeks` cohorts (None: all); other contracts are an error."""
    long = retention_by_contract(rc, reference).withColumn("contract", listed(F.col("contract"), K.CONTRACTS))
    pivot = long.groupBy("cohort_week").pivot("contract", K.CONTRACTS).agg(F.max("retention_rate_pct"))
    named = pivot.withColumnsRenamed({c: c.lower().replace("-", "_").replace(" ", "_") for c in K.CONTRACTS})
    return named.orderBy(F.desc("cohort_week")).limit(weeks) if weeks else named.orderBy("cohort_week")


def best_cohort(table: DataFrame, min_size: int = 5) -> DataFrame:
    """Earliest cohort with the highest retention among those of at least `min_size`."""
    return table.where(F.col("cohort_size") >= min_size).orderBy(F.desc("retention_rate_pct"), "cohort_week").limit(1)


def worst_cohort(table: DataFrame, min_size: int = 5) -> DataFrame:
    return table.where(F.col("cohort_size") >= min_size).orderBy("retention_rate_pct", "cohort_week").limit(1)


def churn_trend(rc: DataFrame, reference: Column, periods: int = 6) -> DataFrame:
    """Churn rate per implied join month, latest `periods` months."""
    monthly = with_implied_join(rc.select("customer_id", "tenure", "churn"), reference).where(F.col("join_month").isNotNull())
    table = monthly.groupBy("join_month").agg(
        F.count("customer_id").alias("customers"), _churned_sum().alias("churned"), rate_pct(_churned_sum(), F.count("customer_id")).alias("churn_rate")
    )
    return table.orderBy(F.desc("join_month")).limit(periods).orderBy("join_month")


def calendar_months(rc: DataFrame, reference: Column) -> DataFrame:
    """Churn rate per calendar month of the implied join date, all years together."""
    joined = with_implied_join(rc.select("customer_id", "tenure", "churn"), reference).where(F.col("calendar_month_num").isNotNull())
    return joined.groupBy("calendar_month_num", "calendar_month").agg(
        rate_pct(_churned_sum(), F.count("customer_id")).alias("churn_rate"), F.count("customer_id").alias("customers")
    ).orderBy("calendar_month_num")


def seasonal_patterns(rc: DataFrame, reference: Column, threshold: float = K.SEASONAL_SPREAD_POINTS) -> DataFrame:
    """Highest and lowest calendar month (the earlier on ties), their spread, and the seasonal flag."""
    months = calendar_months(rc, reference)
    # twelve rows at most
    row = months.agg(
        F.min_by("calendar_month", F.struct(-F.col("churn_rate"), F.col("calendar_month_num"))).alias("highest_month"),
        F.max("churn_rate").alias("highest_churn_rate"),
        F.min_by("calendar_month", F.struct(F.col("churn_rate"), F.col("calendar_month_num"))).alias("lowest_month"),
        F.min("churn_rate").alias("lowest_churn_rate"),
    )
    row = row.withColumn("spread_pct_points", half_up(F.col("highest_churn_rate") - F.col("lowest_churn_rate"), 2))
    return row.withColumn("is_seasonal", F.col("spread_pct_points") > threshold)


def forecast_churn(trend: DataFrame, months: int = 3) -> DataFrame:
    """Straight-line forecast of the next months, clipped to 0..100; needs two months of trend."""
    # `trend` holds one row per month of the report window
    points = trend.select("join_month", "churn_rate", (F.row_number().over(W.orderBy("join_month")) - 1).alias("x"))
    fit = points.agg(
        F.regr_slope("churn_rate", "x").alias("slope"), F.regr_intercept("churn_rate", "x").alias("intercept"),
        F.count("*").alias("n"), F.max("join_month").alias("last"),
    )
    enough = F.when(F.col("n") >= 2, F.lit(True)).otherwise(F.raise_error(F.lit("Need at least 2 historical periods to fit a forecast.")))
    steps = fit.where(enough).select("*", F.explode(F.sequence(F.lit(1), F.lit(months))).alias("i"))
    value = F.col("slope") * (F.col("n") - 1 + F.col("i")) + F.col("intercept")
    return steps.select(
        F.add_months("last", F.col("i")).alias("join_month"),
        half_up(F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0)), 2).alias("churn_rate"), F.lit(True).alias("is_forecast"),
    )


def trend_insight(rc: DataFrame, reference: Column, periods: int = 6, months: int = 3) -> DataFrame:
    """The trend, forecast and seasonal check as one sentence."""
    trend = churn_trend(rc, reference, periods)
    ends = trend.agg(
        F.min_by("churn_rate", "join_month").alias("first"), F.max_by("churn_rate", "join_month").alias("last"), F.count("*").alias("n")
    )
    ahead = forecast_churn(trend, months).agg(F.array_sort(F.collect_list(F.struct("join_month", "churn_rate")))).scalar()
    season = seasonal_patterns(rc, reference).select(F.struct("*")).scalar()
    row = ends.withColumns({"ahead": ahead, "s": season, "delta": half_up(F.col("last") - F.col("first"), 2)})

    def one(c: Column) -> Column:
        return F.format_string("%.1f", half_up(c, 1))

    moved = F.format_string("%+.2f percentage points", F.col("delta"))
    direction = (
        F.when(F.abs("delta") < 1.0, F.lit("has stayed roughly flat"))
        .when(F.col("delta") > 0, F.concat(F.lit("has risen by "), moved))
        .otherwise(F.concat(F.lit("has fallen by "), moved))
    )
    note = F.concat(
        F.lit("Calendar-month churn rates vary by "), one(F.col("s.spread_pct_points")), F.lit(" points between the highest ("), F.col("s.highest_month"),
        F.lit(", "), one(F.col("s.highest_churn_rate")), F.lit("%) and lowest ("), F.col("s.lowest_month"), F.lit(", "), one(F.col("s.lowest_churn_rate")),
        F.lit("%) months"),
        F.when(F.col("s.is_seasonal"), F.lit(" — a meaningful seasonal pattern.")).otherwise(F.lit(", not a strong seasonal signal.")),
    )
    rates = F.array_join(F.transform("ahead", lambda m: F.concat(F.format_string("%.1f", F.round(m["churn_rate"], 1)), F.lit("%"))), ", ")
    text = F.concat(
        F.lit("Over the last "), F.col("n").cast("string"), F.lit(" month(s), the churn rate "), direction, F.lit(" ("), one(F.col("first")), F.lit("% -> "),
        one(F.col("last")), F.lit("%). The next "), F.size("ahead").cast("string"), F.lit(" month(s) are forecast to be "), rates, F.lit(". "), note,
    )
    return row.select(text.alias("insight"))
