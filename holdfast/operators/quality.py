"""Ingest cleaning, row rules and data-quality reports."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.functions.customer import churned
from holdfast.functions.rounding import half_up, rate_pct
from holdfast.operators.features import as_number, trimmed
from holdfast.plans.ordered import quantiles, value_counts
from holdfast.plans.pick import first_per_key


def require_columns(df: DataFrame, columns: Sequence[str] = K.REQUIRED_COLUMNS) -> DataFrame:
    """`df` unchanged, or an error that lists the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def clean_raw(df: DataFrame) -> DataFrame:
    """Trim every text column; total_charges to a number, anything else to 0."""
    return trimmed(df).withColumn("total_charges", F.coalesce(as_number("total_charges"), F.lit(0.0)))


def dedupe_customers(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Keep the first row per customer in `order`."""
    return first_per_key(df, ["customer_id"], order)


def duplicate_count(df: DataFrame) -> DataFrame:
    """How many rows repeat a customer id."""
    per_id = df.groupBy("customer_id").agg(F.count("*").alias("n"))
    return per_id.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def ingest_rules() -> dict[str, Column]:
    """Rule name -> condition a loaded row must meet."""
    return {
        "invalid_churn": F.col("churn").isin("Yes", "No"),
        "non_positive_monthly_charges": F.col("monthly_charges") > 0,
        "tenure_out_of_range": F.col("tenure").between(0, K.TENURE_MAX),
    }


def category_rules() -> dict[str, Column]:
    """Categories the feature columns cannot encode go to quarantine."""
    return {
        "unknown_contract": F.col("contract").isin(list(K.CONTRACT_RISK)),
        "unknown_payment_method": F.col("payment_method").isin(list(K.PAYMENT_RISK)),
    }


def request_rules() -> dict[str, Column]:
    """Rules for a scoring request."""
    return {
        "senior_citizen_not_0_or_1": F.col("senior_citizen").isin(0, 1),
        "tenure_out_of_range": F.col("tenure").between(0, K.REQUEST_TENURE_MAX),
        "non_positive_monthly_charges": F.col("monthly_charges") > 0,
        "negative_total_charges": F.col("total_charges") >= 0,
        "total_below_monthly_charges": F.col("total_charges") >= F.col("monthly_charges") - K.TOTAL_CHARGES_TOLERANCE,
    }


def tag_violations(df: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """Add `violations`, the names of the rules a row breaks (a NULL counts as broken)."""
    rules = ingest_rules() | category_rules() if rules is None else rules
    named = [F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*named)))


def validate_rows(df: DataFrame, rules: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good rows, quarantined rows with their violations, count per violated rule)."""
    tagged = tag_violations(df, rules)
    good = tagged.where(F.size("violations") == 0).drop("violations")
    quarantine = tagged.where(F.size("violations") > 0)
    counts = quarantine.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))
    return good, quarantine, counts


# --- reports -----------------------------------------------------------------


def missing_summary(df: DataFrame) -> DataFrame:
    """(column, null_count, null_pct, blank_count) for every column, from one aggregate row."""
    text = {name for name, kind in df.dtypes if kind == "string"}
    n = F.count("*")

    def blanks(c: str) -> Column:
        return F.count_if(F.trim(F.col(c)) == "") if c in text else F.lit(0).cast("long")

    per_column = [
        F.struct(
            F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("null_count"),
            rate_pct(F.count_if(F.col(c).isNull()), n).alias("null_pct"), blanks(c).alias("blank_count"),
        )
        for c in df.columns
    ]
    return df.agg(F.array(*per_column).alias("r")).select(F.inline("r")).orderBy(F.desc("null_count"), "column_name")


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max per column; quartiles are exact."""
    counts = value_counts(df, columns)
    quartiles = quantiles(counts, [0.25, 0.5, 0.75])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    moments = df.select(F.explode(pairs).alias("_p")).select("_p.*").groupBy("feature").agg(
        F.count("x").alias("count"), half_up(F.avg("x"), 4).alias("mean"), half_up(F.stddev_samp("x"), 4).alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"),
    )
    q = [half_up(F.col("quantiles")[i], 4).alias(name) for i, name in enumerate(["p25", "p50", "p75"])]
    # one row per column on both sides
    return moments.join(F.broadcast(quartiles.select("feature", *q)), "feature").select(
        "feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def verification_report(df: DataFrame) -> DataFrame:
    """Long report (section, label, value): rows, distributions, mean charge by churn, NULL counts."""
    dims = {"churn": F.col("churn"), "gender": F.col("gender"), "contract": F.col("contract"), "rows": F.lit("all")}
    pairs = F.array(*[F.struct(F.lit(k).alias("section"), v.alias("label")) for k, v in dims.items()])
    per_level = (
        df.select(F.explode(pairs).alias("_d"), "monthly_charges").groupBy("_d.section", "_d.label")
        .agg(F.count("*").alias("n"), F.avg("monthly_charges").alias("mean_charge"))
    )
    is_churn = F.col("section") == "churn"
    total = df.agg(F.count("churn")).scalar()

    def value(section: Column, v: Column) -> Column:
        return F.struct(section.alias("section"), F.col("label"), v.cast("double").alias("value"))

    entries = F.array_compact(F.array(
        F.when(F.col("label").isNotNull(), value(F.col("section"), F.col("n"))),
        F.when(is_churn & F.col("label").isNotNull(), value(F.lit("churn_pct"), rate_pct(F.col("n"), F.col("_total"), 1))),
        F.when(is_churn & F.col("label").isNotNull(), value(F.lit("avg_monthly_charges"), half_up(F.col("mean_charge"), 2))),
    ))
    levels = per_level.withColumn("_total", total).select(F.inline(entries))
    nulls = missing_summary(df).select(F.lit("nulls").alias("section"), F.col("column_name").alias("label"), F.col("null_count").cast("double").alias("value"))
    return levels.unionByName(nulls)


def charge_stats_by_churn(df: DataFrame) -> DataFrame:
    c = "monthly_charges"
    return df.groupBy("churn").agg(
        half_up(F.avg(c), 2).alias("mean"), half_up(F.stddev_samp(c), 2).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")
    )


def class_balance(df: DataFrame, label: str = "churn_label", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, label).agg(F.count("*").alias("n"))


def overall_churn_pct(df: DataFrame) -> Column:
    return rate_pct(F.sum(churned(F.col("churn"))), F.count("*"))
