"""Value, risk and tenure segmentation; segment profiles and advice."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.functions import customer as C
from holdfast.functions import risk as R
from holdfast.functions.rounding import exact_avg, exact_sum, half_up
from holdfast.plans.ordered import quantiles, value_counts
from holdfast.plans.summary import with_levels

EDGE_DIGITS = 9


def tercile_edges(df: DataFrame, column: str) -> Column:
    """Four exact tercile edges of a column as a one-value array subquery."""
    edges = quantiles(value_counts(df, [column]), [0.0, 1 / 3, 2 / 3, 1.0])
    return edges.select(F.transform("quantiles", lambda e: F.round(e, EDGE_DIGITS))).scalar()


def segment_by_value(df: DataFrame) -> DataFrame:
    """Add `clv` and the Low/Medium/High tercile of monthly charges (right-closed bins).

    Equal edges leave no three bins, which is an error, as with any quantile cut.
    """
    out = df.withColumn("_edges", tercile_edges(df, "monthly_charges"))
    edges = F.col("_edges")
    distinct = F.size(F.array_distinct(edges)) == F.size(edges)
    x = F.round("monthly_charges", EDGE_DIGITS)
    label = F.when(x <= edges[1], F.lit("Low")).when(x <= edges[2], F.lit("Medium")).otherwise(F.lit("High"))
    checked = F.when(distinct, label).otherwise(F.raise_error(F.lit("Bin edges must be unique")))
    clv = R.lifetime_value(F.col("monthly_charges"), F.col("churn_probability"))
    return out.withColumns({"clv": clv, "value_segment": F.when(x.isNotNull(), checked)}).drop("_edges")


def segment_customers(cp: DataFrame, rc: DataFrame) -> DataFrame:
    """Every scored customer with value, risk and tenure segment."""
    scored = cp.select("customer_id", "churn_probability", "risk_segment").join(
        rc.select("customer_id", "tenure", "monthly_charges", "contract"), "customer_id"
    )
    valued = segment_by_value(scored)
    return valued.withColumn("tenure_segment", C.tenure_group(F.col("tenure")))


def segment_matrix(df: DataFrame) -> DataFrame:
    """Value (rows) by risk (columns) counts in fixed order, absent cells 0."""
    counts = df.groupBy("value_segment").pivot("risk_segment", K.LEVEL_ORDER).agg(F.count(F.lit(1))).na.fill(0)
    return with_levels(counts, "value_segment", K.LEVEL_ORDER, {s: 0 for s in K.LEVEL_ORDER})


def segment_characteristics(df: DataFrame) -> DataFrame:
    return df.groupBy("value_segment", "risk_segment").agg(
        F.count("*").alias("customers"), half_up(F.avg("tenure"), 1).alias("avg_tenure"),
        half_up(exact_avg("monthly_charges"), 2).alias("avg_monthly_charges"),
        half_up(F.avg("churn_probability"), 4).alias("avg_churn_probability"),
        half_up(exact_sum("monthly_charges"), 2).alias("total_monthly_revenue"),
    ).orderBy(F.desc("value_segment"), F.desc("risk_segment"))


def segment_sizes(df: DataFrame) -> DataFrame:
    """(kind, segment, customers) for the three segmentations in fixed order, absent ones 0."""
    orders = {"value_segment": K.LEVEL_ORDER, "risk_segment": K.LEVEL_ORDER, "tenure_segment": K.TENURE_LABELS_MODEL}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("segment")) for k in orders])
    sizes = df.select(F.inline(pairs)).where(F.col("segment").isNotNull()).groupBy("kind", "segment").agg(F.count("*").alias("customers"))
    levels = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("segment")) for k, order in orders.items() for s in order])
    listed = df.sparkSession.range(1).select(F.posexplode(levels).alias("_place", "_l")).select("_place", "_l.*")
    # ten fixed rows
    return F.broadcast(listed).join(sizes, ["kind", "segment"], "left").na.fill(0, ["customers"]).orderBy("_place").drop("_place")


def segment_kpis(df: DataFrame) -> DataFrame:
    high_value = F.col("value_segment") == "High"
    return df.agg(
        F.count("*").alias("total_customers"), half_up(exact_sum("monthly_charges"), 2).alias("total_monthly_revenue"),
        F.count_if(high_value).alias("high_value_customers"),
        F.count_if(high_value & (F.col("risk_segment") == "High")).alias("high_value_high_risk"),
    )


def compare_segments(cp: DataFrame, rc: DataFrame) -> DataFrame:
    """Profile of each risk segment in one aggregate; an empty segment has zeros."""
    profile = rc.select("customer_id", "tenure", "monthly_charges", "contract", "payment_method", "online_security", "paperless_billing", "senior_citizen")
    joined = cp.select("customer_id", "risk_segment").join(profile, "customer_id")

    def share(condition: Column) -> Column:
        return half_up(F.avg(F.coalesce(condition, F.lit(False)).cast("double")) * 100, 1)

    table = joined.groupBy(F.col("risk_segment").alias("segment")).agg(
        F.count("*").alias("customer_count"), half_up(F.avg("tenure"), 1).alias("avg_tenure_months"),
        half_up(exact_avg("monthly_charges"), 2).alias("avg_monthly_charges"),
        share(F.col("contract") == "Month-to-month").alias("pct_month_to_month"),
        share(F.col("payment_method") == "Electronic check").alias("pct_electronic_check"),
        share(F.col("online_security") == "No").alias("pct_no_online_security"),
        share(F.col("paperless_billing") == "Yes").alias("pct_paperless_billing"),
        share(F.col("senior_citizen") == 1).alias("pct_senior_citizen"),
    )
    return with_levels(table, "segment", K.SEGMENTS, {c: 0 if c == "customer_count" else 0.0 for c in table.columns[1:]})


def segment_recommendations(profiles: DataFrame) -> DataFrame:
    """Advice lines per segment, in rule order; a default line when no rule fires."""
    def share(c: str) -> Column:
        return F.format_string("%.0f%%", half_up(F.col(c), 0))

    tenure = F.format_string("%.0f", half_up(F.col("avg_tenure_months"), 0))
    rules = [
        (F.col("pct_month_to_month") >= 50, F.concat(share("pct_month_to_month"), F.lit(" are on month-to-month contracts — prioritize annual/two-year contract upgrade offers."))),
        (F.col("pct_no_online_security") >= 50, F.concat(share("pct_no_online_security"), F.lit(" lack online security — bundle it in as a low-cost retention add-on."))),
        (F.col("pct_electronic_check") >= 40, F.concat(share("pct_electronic_check"), F.lit(" pay by electronic check — encourage autopay/credit-card enrollment, historically a lower-churn payment method."))),
        (F.col("avg_tenure_months") <= 12, F.concat(F.lit("Average tenure is only "), tenure, F.lit(" months — this segment skews new; focus on onboarding and early-lifecycle engagement."))),
    ]
    fired = F.array_compact(F.array(*[F.when(test, text) for test, text in rules]))
    lines = F.when(F.size(fired) > 0, fired).otherwise(F.array(F.lit(K.PROFILE_DEFAULT)))
    return profiles.select("segment", F.posexplode(lines).alias("place", "recommendation"))
