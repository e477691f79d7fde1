"""Revenue, lifetime value, campaign returns, retention targets."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.functions import risk as R
from holdfast.functions.rounding import exact_avg, exact_sum, half_up

AT_RISK = ("High", "Medium")


def _joined(cp: DataFrame, rc: DataFrame, *profile: str) -> DataFrame:
    return cp.join(rc.select("customer_id", "monthly_charges", *profile), "customer_id")


def _clv() -> Column:
    return R.lifetime_value(F.col("monthly_charges"), F.col("churn_probability"))


def revenue_by_segment(cp: DataFrame, rc: DataFrame) -> DataFrame:
    return _joined(cp, rc).groupBy("risk_segment").agg(
        F.count("*").alias("customer_count"), half_up(exact_sum("monthly_charges"), 2).alias("monthly_revenue_at_risk"),
        half_up(exact_avg("monthly_charges"), 2).alias("avg_monthly_charges"),
    ).orderBy(F.desc("monthly_revenue_at_risk"))


def revenue_at_risk(cp: DataFrame, rc: DataFrame, segments: tuple[str, ...] = ("High",)) -> DataFrame:
    """Monthly revenue of the urgent segment (High only; pass AT_RISK for the wider reading)."""
    at_risk = _joined(cp.where(F.col("risk_segment").isin(*segments)), rc)
    return at_risk.agg(half_up(F.coalesce(exact_sum("monthly_charges").cast("double"), F.lit(0.0)), 2).alias("revenue_at_risk"))


def clv_by_segment(cp: DataFrame, rc: DataFrame) -> DataFrame:
    return _joined(cp, rc).groupBy("risk_segment").agg(
        F.count("*").alias("customer_count"), half_up(exact_avg(_clv()), 2).alias("avg_clv"), half_up(exact_sum(_clv()), 2).alias("total_clv")
    ).orderBy(F.desc("total_clv"))


def clv_at_risk(cp: DataFrame, rc: DataFrame) -> DataFrame:
    return _joined(cp.where(F.col("risk_segment") == "High"), rc).agg(
        F.count("*").alias("high_risk_customers"), half_up(exact_sum(_clv()), 2).alias("total_clv_at_risk"), half_up(exact_avg(_clv()), 2).alias("avg_clv_at_risk")
    )


def revenue_saved_by_segment(cp: DataFrame, rc: DataFrame) -> DataFrame:
    return _joined(cp.where(F.col("risk_segment").isin(*AT_RISK)), rc).groupBy("risk_segment").agg(
        F.count("*").alias("customer_count"), half_up(exact_sum(_clv()), 2).alias("revenue_saved_if_prevented")
    ).orderBy(F.desc("revenue_saved_if_prevented"))


# --- campaigns ---------------------------------------------------------------


def _tier_stats(cp: DataFrame, rc: DataFrame) -> DataFrame:
    tiered = _joined(cp.where(F.col("retention_priority").isNotNull()), rc)
    return tiered.groupBy("retention_priority").agg(F.count("*").alias("customers_targeted"), exact_avg("monthly_charges").alias("avg_charges"))


def _recovered(n: str = "customers_targeted", rate: float = K.SUCCESS_RATE) -> Column:
    return F.col(n) * F.lit(rate) * F.col("avg_charges") * K.MONTHS_PER_YEAR


def roi_by_tier(cp: DataFrame, rc: DataFrame, cost: float = K.CAMPAIGN_COST, rate: float = K.SUCCESS_RATE) -> DataFrame:
    spent = F.col("customers_targeted") * F.lit(cost)
    recovered = _recovered(rate=rate)
    return _tier_stats(cp, rc).select(
        "retention_priority", "customers_targeted", half_up(spent, 2).alias("campaign_cost"),
        half_up(recovered, 2).alias("revenue_recovered"),
        half_up((recovered - spent) / F.nullif(spent, F.lit(0.0)) * 100, 1).alias("roi_pct"),
    ).orderBy("retention_priority")


def cost_per_saved(cp: DataFrame, cost: float = K.CAMPAIGN_COST, rate: float = K.SUCCESS_RATE) -> DataFrame:
    n = F.col("customers_targeted")
    tiers = cp.where(F.col("retention_priority").isNotNull()).groupBy("retention_priority").agg(F.count("*").alias("customers_targeted"))
    return tiers.select(
        "retention_priority", "customers_targeted", half_up(n * F.lit(rate), 1).alias("expected_customers_retained"),
        half_up(n * F.lit(cost) / F.nullif(n * F.lit(rate), F.lit(0.0)), 2).alias("cost_per_customer_saved"),
    ).orderBy("retention_priority")


def revenue_recovered_by_tier(cp: DataFrame, rc: DataFrame, rate: float = K.SUCCESS_RATE) -> DataFrame:
    return _tier_stats(cp, rc).select(
        "retention_priority", "customers_targeted", half_up(F.col("avg_charges"), 2).alias("avg_monthly_charges"),
        half_up(_recovered(rate=rate), 2).alias("annual_revenue_recovered"),
    ).orderBy(F.desc("annual_revenue_recovered"))


def break_even_by_tier(cp: DataFrame, rc: DataFrame, cost: float = K.CAMPAIGN_COST) -> DataFrame:
    """Success rate at which annual recovered revenue equals the campaign cost."""
    needed = F.lit(cost) / F.nullif(F.col("avg_charges") * K.MONTHS_PER_YEAR, F.lit(0.0))
    return _tier_stats(cp, rc).select(
        "retention_priority", "customers_targeted", half_up(F.col("customers_targeted") * F.lit(cost), 2).alias("campaign_cost"),
        half_up(needed * 100, 2).alias("break_even_success_rate_pct"),
        half_up(F.col("customers_targeted") * needed, 1).alias("break_even_customers_to_retain"),
    ).orderBy("retention_priority")


def expected_savings(cp: DataFrame, rc: DataFrame, cost: float = K.CAMPAIGN_COST, rate: float = K.SUCCESS_RATE) -> DataFrame:
    stats = _joined(cp.where(F.col("risk_segment").isin(*AT_RISK)), rc).groupBy("risk_segment").agg(
        F.count("*").alias("customer_count"), exact_avg("monthly_charges").alias("avg_charges")
    )
    return stats.select(
        "risk_segment", "customer_count", half_up(F.col("customer_count") * F.lit(cost), 2).alias("campaign_cost"),
        half_up(_recovered("customer_count", rate), 2).alias("expected_annual_savings"),
    ).orderBy(F.desc("expected_annual_savings"))


def estimate_retention_savings(cp: DataFrame, rc: DataFrame, cost: float = K.CAMPAIGN_COST, rate: float = K.SUCCESS_RATE) -> DataFrame:
    """One row of campaign figures for the High segment; all zero when it is empty."""
    n = F.col("customers_targeted")
    stats = _joined(cp.where(F.col("risk_segment") == "High"), rc).agg(
        F.count("*").alias("customers_targeted"), F.coalesce(exact_avg("monthly_charges"), F.lit(0.0)).alias("avg_charges")
    )
    spent, recovered = n * F.lit(cost), _recovered(rate=rate)
    roi = F.when(spent > 0, (recovered - spent) / F.nullif(spent, F.lit(0.0)) * 100).otherwise(F.lit(0.0))
    return stats.select(
        "customers_targeted", F.lit(cost).alias("campaign_cost_per_customer"), F.lit(rate).alias("success_rate"),
        half_up(spent, 2).alias("total_cost"), half_up(n * F.lit(rate), 1).alias("expected_customers_retained"),
        half_up(recovered, 2).alias("revenue_recovered"), half_up(roi, 1).alias("roi_pct"),
    )


# --- lists -------------------------------------------------------------------


def top_clv(cp: DataFrame, rc: DataFrame, n: int = 10) -> DataFrame:
    """Highest lifetime value among High and Medium risk."""
    at_risk = _joined(cp.where(F.col("risk_segment").isin(*AT_RISK)), rc, "contract", "tenure")
    rows = at_risk.select("customer_id", "contract", "tenure", "monthly_charges", "churn_probability", "risk_segment", half_up(_clv(), 2).alias("clv"))
    return rows.orderBy(F.desc("clv"), "customer_id").limit(n)


def top_revenue_at_risk(cp: DataFrame, rc: DataFrame, n: int = 10) -> DataFrame:
    high = _joined(cp.where(F.col("risk_segment") == "High"), rc, "contract", "tenure")
    return high.select("customer_id", "contract", "tenure", "monthly_charges", "churn_probability").orderBy(F.desc("monthly_charges"), "customer_id").limit(n)


def high_risk_customers(cp: DataFrame, rc: DataFrame, n: int | None = None) -> DataFrame:
    """High-risk customers with contact columns: the `n` riskiest in order, or all of them in no order (see `riskiest_first`)."""
    profile = ["gender", "senior_citizen", "phone_service", "payment_method", "contract", "tenure"]
    high = _joined(cp.where(F.col("risk_segment") == "High"), rc, *profile)
    rows = high.select("customer_id", *profile, "monthly_charges", "churn_probability", "risk_segment")
    return riskiest_first(rows).limit(n) if n is not None else rows


def retention_targets(cp: DataFrame, rc: DataFrame) -> DataFrame:
    """The outreach list: High risk with tier, in no order (see `outreach_order`)."""
    high = _joined(cp.where(F.col("risk_segment") == "High"), rc, "contract", "tenure", "payment_method", "internet_service")
    return high.select(
        "customer_id", "churn_probability", "risk_segment", "contract", "monthly_charges", "tenure", "payment_method", "internet_service",
        R.retention_tier(F.col("monthly_charges")).alias("priority_tier"),
    )


def outreach_order(targets: DataFrame) -> DataFrame:
    """Best tier and highest probability first: for exports, a full sort."""
    return targets.orderBy("priority_tier", F.desc("churn_probability"), "customer_id")


def riskiest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("churn_probability"), "customer_id")


def tier_summary(targets: DataFrame) -> DataFrame:
    return targets.groupBy("priority_tier").agg(
        F.count("*").alias("customer_count"), half_up(F.avg("churn_probability"), 2).alias("avg_churn_probability"),
        half_up(exact_avg("monthly_charges"), 2).alias("avg_monthly_charges"), half_up(exact_sum("monthly_charges"), 2).alias("total_monthly_revenue"),
    ).orderBy("priority_tier")


def target_contracts(targets: DataFrame) -> DataFrame:
    return targets.groupBy("contract").agg(F.count("*").alias("customer_count")).orderBy(F.desc("customer_count"), "contract")


def tier_list(targets: DataFrame, tier: str) -> DataFrame:
    """The targets of one tier, in no order."""
    return targets.where(F.col("priority_tier") == tier)


def top_risk(df: DataFrame, n: int = 1) -> DataFrame:
    return riskiest_first(df).limit(n)


def backfill_summary(cp: DataFrame) -> DataFrame:
    return cp.groupBy("risk_segment", "retention_priority").agg(
        F.count("*").alias("n"), half_up(exact_avg("estimated_revenue_at_risk"), 2).alias("avg_revenue_at_risk"),
        half_up(F.avg("days_since_last_score"), 2).alias("avg_days_since_score"),
    )


def prediction_kpis(df: DataFrame) -> DataFrame:
    def segment(s: str) -> Column:
        return F.count_if(F.col("risk_segment") == s).alias(f"{s.lower()}_count")

    return df.agg(*[segment(s) for s in K.SEGMENTS], half_up(F.coalesce(F.avg("churn_probability"), F.lit(0.0)), 4).alias("avg_probability"))
