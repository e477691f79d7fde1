"""Churn rates over dimensions, segment tables, distributions."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import constants as K
from holdfast.functions import customer as C
from holdfast.functions.lookups import listed, position
from holdfast.functions.rounding import exact_avg, exact_sum, half_up, rate_pct
from holdfast.plans.pick import top_per_key
from holdfast.plans.summary import explode_dimensions, stack_sections, with_levels


def rate_by_dimensions(df: DataFrame, dims: Mapping[str, Column], churned: Column, averages: Mapping[str, str] | None = None) -> DataFrame:
    """Count, churned and churn rate for every level of several dimensions, in one scan."""
    averages = averages or {}
    long = explode_dimensions(df, dims, [churned.alias("_churned"), *dict.fromkeys(averages.values())])
    churned_count = F.sum("_churned")
    return long.groupBy("dimension", "segment").agg(
        F.count("*").alias("total_customers"),
        churned_count.cast("long").alias("churned"),
        rate_pct(churned_count, F.count("*")).alias("churn_rate_pct"),
        *[half_up(F.avg(c), 2).alias(name) for name, c in averages.items()],
    )


def churn_overview(rc: DataFrame) -> DataFrame:
    """Seven dimensions with count, churned, rate, average tenure and charges."""
    dims = {
        "overall": F.lit("all"),
        "contract": F.col("contract"),
        "gender": F.col("gender"),
        "senior_citizen": C.senior_label(F.col("senior_citizen")),
        "tenure_group": C.tenure_group(F.col("tenure"), K.TENURE_LABELS_SQL),
        "monthly_charge_tier": C.charge_tier(F.col("monthly_charges")),
        "services_count": C.services_count(),
    }
    averages = {"avg_tenure_months": "tenure", "avg_monthly_charges": "monthly_charges"}
    return rate_by_dimensions(rc, dims, C.churned(F.col("churn")), averages)


def churn_by_features(rc: DataFrame) -> DataFrame:
    dims = {
        "contract": F.col("contract"),
        "internet_service": F.col("internet_service"),
        "payment_method": F.col("payment_method"),
        "senior_citizen": C.senior_label(F.col("senior_citizen")),
        "partner_dependents": C.household(F.col("partner"), F.col("dependents")),
    }
    return rate_by_dimensions(rc, dims, C.churned(F.col("churn")))


def churn_by_engineered_features(pc: DataFrame) -> DataFrame:
    dims = {
        "tenure_group": F.col("tenure_group"),
        "contract_risk_score": F.col("contract_risk_score"),
        "payment_risk_score": F.col("payment_risk_score"),
        "services_count": F.col("services_count"),
        "charge_per_month_tier": C.charge_tier(F.col("charge_per_month")),
    }
    return rate_by_dimensions(pc, dims, F.col("churn_label"))


def services_count_summary(rc: DataFrame) -> DataFrame:
    churn = C.churned(F.col("churn"))
    return rc.groupBy(C.services_count().alias("services_count")).agg(
        F.count("*").alias("customer_count"),
        rate_pct(F.sum(churn), F.count("*")).alias("churn_rate_pct"),
        half_up(exact_avg("monthly_charges"), 2).alias("avg_monthly_charges"),
    )


def top_addon_combinations(rc: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent add-on combinations among churners, with their share of all churners."""
    names = {"online_security": "security", "online_backup": "backup", "device_protection": "device_protect"}
    parts = [F.concat(F.lit(names.get(c, c) + "="), F.coalesce(F.col(c), F.lit(""))) for c in K.ADDON_COLUMNS]
    churners = rc.where(F.col("churn") == "Yes")
    combos = churners.groupBy(F.concat_ws(",", *parts).alias("segment")).agg(
        F.count("*").alias("customer_count"), half_up(exact_avg("monthly_charges"), 2).alias("avg_monthly_charges")
    )
    share = rate_pct(F.col("customer_count"), combos.agg(F.sum("customer_count")).scalar())
    return combos.withColumn("pct_of_churners", share).orderBy(F.desc("customer_count"), "segment").limit(n)


_SERVICES = T.StructType([
    T.StructField("segment", T.StringType()), T.StructField("customer_count", T.LongType()),
    T.StructField("churn_rate_pct", T.DoubleType()), T.StructField("avg_monthly_charges", T.DoubleType()),
    T.StructField("pct_of_churners", T.DoubleType()),
])


def churn_by_services(rc: DataFrame, n: int = 10) -> DataFrame:
    summary = services_count_summary(rc).withColumnRenamed("services_count", "segment")
    return stack_sections(
        {"services_count_summary": summary, "top_combinations_churners": top_addon_combinations(rc, n)}, _SERVICES
    )


def churn_by_tenure(rc: DataFrame, cp: DataFrame) -> DataFrame:
    """Per tenure group: size, rate, average charges and High+Medium revenue (0 when none)."""
    scored = rc.select("customer_id", "tenure", "churn", "monthly_charges").join(
        cp.select("customer_id", "risk_segment"), "customer_id", "left"
    )
    at_risk = F.when(F.col("risk_segment").isin("High", "Medium"), F.col("monthly_charges")).otherwise(F.lit(0.0))
    group = C.tenure_group(F.col("tenure"), K.TENURE_LABELS_SQL).alias("tenure_group")
    table = scored.groupBy(group).agg(
        F.count("*").alias("customer_count"),
        rate_pct(F.sum(C.churned(F.col("churn"))), F.count("*")).alias("churn_rate_pct"),
        half_up(exact_avg("monthly_charges"), 2).alias("avg_monthly_charges"),
        half_up(exact_sum(at_risk), 2).alias("revenue_at_risk"),
    )
    return table.orderBy(position(F.col("tenure_group"), K.TENURE_LABELS_SQL))


def modal_contract(df: DataFrame, by: str) -> DataFrame:
    """Most frequent contract per group; equal counts go to the first in sort order."""
    counts = df.where(F.col("contract").isNotNull()).groupBy(by, "contract").agg(F.count("*").alias("_n"))
    best = F.min_by("contract", F.struct(-F.col("_n"), F.col("contract")))
    return counts.groupBy(by).agg(best.alias("most_common_contract"))


def risk_segments(cp: DataFrame, rc: DataFrame) -> DataFrame:
    """Per segment table plus a combined High+Medium row built from the rounded averages."""
    profile = rc.select("customer_id", "monthly_charges", "tenure", "contract")
    joined = cp.select("customer_id", "risk_segment").join(profile, "customer_id")
    # one aggregate per (segment, contract): at most a handful of rows to finish from
    fine = joined.groupBy("risk_segment", "contract").agg(
        F.count("*").alias("n"),
        exact_sum("monthly_charges").alias("charges"), F.count("monthly_charges").alias("n_charges"),
        F.sum("tenure").alias("tenure"), F.count("tenure").alias("n_tenure"),
    )
    stats = fine.groupBy("risk_segment").agg(
        F.sum("n").alias("customer_count"),
        half_up(F.sum("charges") / F.nullif(F.sum("n_charges"), F.lit(0)), 2).alias("avg_monthly_charges"),
        half_up(F.sum("tenure") / F.nullif(F.sum("n_tenure"), F.lit(0)), 2).alias("avg_tenure"),
        F.min_by("contract", F.when(F.col("contract").isNotNull(), F.struct(-F.col("n"), F.col("contract")))).alias("most_common_contract"),
        half_up(F.sum("charges"), 2).alias("total_monthly_revenue"),
    )
    stats = stats.withColumn("pct_of_total", rate_pct(F.col("customer_count"), fine.agg(F.sum("n")).scalar()))
    at_risk = F.col("risk_segment").isin("High", "Medium")
    single = stats.withColumn("revenue_at_risk", F.when(at_risk, F.col("total_monthly_revenue")))

    def weighted(c: str) -> Column:
        return half_up(F.sum(F.col(c) * F.col("customer_count")) / F.nullif(F.sum("customer_count"), F.lit(0)), 2)

    revenue = half_up(F.sum("total_monthly_revenue"), 2)
    combined = stats.where(at_risk).agg(
        F.sum("customer_count").alias("customer_count"), weighted("avg_monthly_charges").alias("avg_monthly_charges"),
        weighted("avg_tenure").alias("avg_tenure"), F.lit(None).cast("string").alias("most_common_contract"),
        revenue.alias("total_monthly_revenue"), half_up(F.sum("pct_of_total"), 2).alias("pct_of_total"),
        revenue.alias("revenue_at_risk"),
    )
    return single.unionByName(combined.withColumn("risk_segment", F.lit("High+Medium (At Risk)")))


def churn_rate(rc: DataFrame) -> DataFrame:
    churn = F.sum(C.churned(F.col("churn")))
    return rc.agg(
        F.count("*").alias("total_customers"),
        half_up(F.coalesce(churn / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 4).alias("churn_rate"),
        F.coalesce(rate_pct(churn, F.count("*")), F.lit(0.0)).alias("churn_rate_pct"),
    )


def project_stats(rc: DataFrame, cp: DataFrame, registry: DataFrame) -> DataFrame:
    """One headline row: customers, churn, high risk, best model, revenue at risk, last training."""
    churn = F.sum(C.churned(F.col("churn")))
    people = rc.agg(F.count("*").alias("total_customers"), rate_pct(churn, F.count("*")).alias("churn_rate_pct"))
    scores = cp.agg(
        F.struct(F.count("*").alias("n"), F.count_if(F.col("risk_segment") == "High").alias("high"))
    ).scalar()
    at_risk = cp.where(F.col("risk_segment").isin("High", "Medium")).join(rc.select("customer_id", "monthly_charges"), "customer_id")
    revenue = at_risk.agg(half_up(F.coalesce(exact_sum("monthly_charges").cast("double"), F.lit(0.0)), 2)).scalar()
    active = registry.where("is_active").agg(F.max_by(F.struct("model_name", "auc_score", "trained_at"), F.struct("auc_score", -F.col("id")))).scalar()
    return people.select(
        "total_customers", "churn_rate_pct",
        scores.getField("high").alias("high_risk_count"),
        F.coalesce(active.getField("model_name"), F.lit("N/A")).alias("best_model_name"),
        active.getField("auc_score").alias("best_model_auc"),
        scores.getField("n").alias("total_predictions"),
        revenue.alias("revenue_at_risk"),
        active.getField("trained_at").alias("last_trained_at"),
    )


def value_counts_of(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Counts and shares of one column in a fixed level order; absent levels get 0."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.where(F.col(column).isNotNull()).agg(F.sum("n")).scalar()
    shares = counts.withColumn("pct", rate_pct(F.col("n"), total))
    return with_levels(shares, column, order, {"n": 0, "pct": 0.0})


def risk_distribution(cp: DataFrame) -> DataFrame:
    return cp.groupBy("risk_segment").agg(F.count("*").alias("customer_count"))


def churn_rate_by(rc: DataFrame, column: str) -> DataFrame:
    """Churn rate by one column, highest first."""
    rate = rate_pct(F.sum(C.churned(F.col("churn"))), F.count("*")).alias("churn_rate_pct")
    return rc.groupBy(column).agg(F.count("*").alias("customers"), rate).orderBy(F.desc("churn_rate_pct"), column)


def churn_by_tenure_contract(rc: DataFrame) -> DataFrame:
    """Churn share per tenure group and contract, in long form: whatever contracts the data hold."""
    group = C.tenure_group(F.col("tenure"), K.TENURE_LABELS_MODEL)
    cells = rc.select(group.alias("tenure_group"), "contract", C.churned(F.col("churn")).alias("y"))
    return cells.where(F.col("tenure_group").isNotNull()).groupBy("tenure_group", "contract").agg(half_up(F.avg("y"), 4).alias("churn_share"))


def tenure_contract_pivot(rc: DataFrame) -> DataFrame:
    """The same with tenure groups as rows and the known contracts as columns; other contracts are an error."""
    long = churn_by_tenure_contract(rc).withColumn("contract", listed(F.col("contract"), K.CONTRACTS))
    pivot = long.groupBy("tenure_group").pivot("contract", K.CONTRACTS).agg(F.max("churn_share"))
    named = pivot.withColumnsRenamed({c: c.lower().replace("-", "_").replace(" ", "_") for c in K.CONTRACTS})
    return with_levels(named, "tenure_group", K.TENURE_LABELS_MODEL, {})
