"""Cleaning, engineered columns, encoding, scaling and the per-customer filters."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.functions import customer as C
from holdfast.functions import risk as R
from holdfast.functions.rounding import half_up
from holdfast.plans.ordered import quantiles, value_counts


def _string_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string"]


def trimmed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.trim(c) for c in _string_columns(df)})


def as_number(c: str) -> Column:
    """Numeric value of a text or numeric column; text that is no number gives NULL."""
    return F.col(c).cast("string").try_cast("double")


def column_medians(df: DataFrame, columns: Sequence[str]) -> Column:
    """Map column -> exact median as a one-value subquery."""
    medians = quantiles(value_counts(df, columns), [0.5])
    entry = F.struct("feature", F.col("quantiles")[0])
    return medians.agg(F.map_from_entries(F.collect_list(entry))).scalar()


def clean_data(df: DataFrame) -> DataFrame:
    """Trim; coerce numerics; fill numeric NULLs with the median and category NULLs with 'Unknown'."""
    out = trimmed(df).withColumns({c: as_number(c) for c in K.NUMERIC_COLUMNS})
    medians = column_medians(out, K.NUMERIC_COLUMNS)
    filled = {c: F.coalesce(F.col(c), medians.getItem(c)) for c in K.NUMERIC_COLUMNS}
    filled |= {c: F.coalesce(F.col(c), F.lit("Unknown")) for c in K.CATEGORICAL_COLUMNS}
    return out.withColumns(filled)


def with_tenure_group(df: DataFrame, labels: Sequence[str] = K.TENURE_LABELS_MODEL, name: str = "tenure_group") -> DataFrame:
    return df.withColumn(name, C.tenure_group(F.col("tenure"), list(labels)))


def with_charge_per_month(df: DataFrame) -> DataFrame:
    return df.withColumn("charge_per_month", C.charge_per_month(F.col("total_charges"), F.col("tenure")))


def with_services_count(df: DataFrame) -> DataFrame:
    return df.withColumn("services_count", C.services_count())


def with_contract_risk(df: DataFrame) -> DataFrame:
    return df.withColumn("contract_risk_score", C.contract_risk(F.col("contract")))


def with_payment_risk(df: DataFrame) -> DataFrame:
    return df.withColumn("payment_risk_score", C.payment_risk(F.col("payment_method")))


def with_churn_label(df: DataFrame) -> DataFrame:
    return df.withColumn("churn_label", C.churned(F.col("churn")))


def with_charge_tier(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, C.charge_tier(F.col(column)))


def with_household(df: DataFrame) -> DataFrame:
    return df.withColumn("household", C.household(F.col("partner"), F.col("dependents")))


def with_senior_label(df: DataFrame) -> DataFrame:
    return df.withColumn("senior_label", C.senior_label(F.col("senior_citizen")))


def engineer(df: DataFrame) -> DataFrame:
    """All engineered model columns next to the input columns (a narrow projection)."""
    return df.withColumns({
        "tenure_group": C.tenure_group(F.col("tenure")),
        "charge_per_month": C.charge_per_month(F.col("total_charges"), F.col("tenure")),
        "services_count": C.services_count(),
        "contract_risk_score": C.contract_risk(F.col("contract")),
        "payment_risk_score": C.payment_risk(F.col("payment_method")),
    })


def build_processed(rc: DataFrame) -> DataFrame:
    """The processed table: one scan, with the two legacy columns empty."""
    return with_churn_label(engineer(rc)).select(
        "customer_id", "tenure_group", "charge_per_month", "services_count", "contract_risk_score",
        "payment_risk_score", "churn_label",
        F.lit(None).cast("double").alias("churn_probability"), F.lit(None).cast("string").alias("risk_segment"),
    )


def model_features(df: DataFrame) -> DataFrame:
    """Add the eight model inputs: four numerics and one 0/1 column per tenure group."""
    engineered = engineer(df)
    dummies = {
        f"tenure_group_{label}": F.coalesce(F.col("tenure_group") == label, F.lit(False)).cast("int")
        for label in K.TENURE_LABELS_MODEL
    }
    return engineered.withColumns(dummies)


def fit_levels(df: DataFrame, columns: Sequence[str], max_levels: int = 1000) -> dict[str, list[str]]:
    """Sorted distinct levels per category column; refuses a column that is no category."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("level")) for c in columns])
    seen = df.select(F.explode(pairs).alias("_p")).select("_p.*").where(F.col("level").isNotNull()).distinct()
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in seen.limit(max_levels * len(columns) + 1).collect():
        found[row.feature].append(row.level)
    wide = [c for c, levels in found.items() if len(levels) > max_levels]
    if wide:
        raise ValueError(f"more than {max_levels} levels in {wide}")
    return {c: sorted(levels) for c, levels in found.items()}


def one_hot(df: DataFrame, levels: Mapping[str, Sequence[str]] = K.CATEGORY_LEVELS) -> DataFrame:
    """One 0/1 column per (category, level); an unlisted level leaves all of its columns 0."""
    dummies = {
        f"{c}_{level}": F.coalesce(F.col(c) == level, F.lit(False)).cast("int") for c, vals in levels.items() for level in vals
    }
    return df.withColumns(dummies).drop(*levels)


def scale_numerics(df: DataFrame, columns: Sequence[str] = K.NUMERIC_COLUMNS) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    moments = df.agg(F.struct(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in columns
    ])).scalar()
    scaled = {}
    for c in columns:
        m = moments.getField(c)
        sd = F.when(m.getField("sd") == 0, F.lit(1.0)).otherwise(m.getField("sd"))
        scaled[c] = (F.col(c) - m.getField("mean")) / sd
    return df.withColumns(scaled)


# --- per-customer columns over predictions -----------------------------------


def with_days_since(df: DataFrame, now: Column, at: str = "predicted_at") -> DataFrame:
    return df.withColumn("days_since_prediction", R.whole_days(F.col(at), now))


def high_risk_rules(rc: DataFrame, pc: DataFrame) -> DataFrame:
    """Four rule flags per customer, their count and the segment they imply."""
    scores = pc.select("customer_id", "contract_risk_score", "payment_risk_score", "services_count")
    rules = [
        F.col("contract_risk_score") >= 3, F.col("payment_risk_score") >= 2,
        F.col("services_count") <= 2, F.col("tenure") <= 12,
    ]
    flags = sum((rule.cast("int") for rule in rules[1:]), rules[0].cast("int"))
    segment = F.when(F.col("risk_flags_count") >= 3, "High").when(F.col("risk_flags_count") == 2, "Medium").otherwise("Low")
    return (
        rc.join(scores, "customer_id")
        .withColumn("risk_flags_count", flags)
        .select(
            "customer_id", "gender", "senior_citizen", "tenure", "contract", "internet_service", "online_security",
            "tech_support", "monthly_charges", "total_charges", "churn", "payment_method", "contract_risk_score",
            "payment_risk_score", "services_count", "risk_flags_count", segment.alias("risk_segment"),
        )
    )


def filter_customers(df: DataFrame, segment: str | None = None, contract: str | None = None, tenure: tuple[int, int] | None = None) -> DataFrame:
    """Optional filters, all pushed to the scan."""
    for column, wanted in (("risk_segment", segment), ("contract", contract)):
        if wanted is not None:
            df = df.where(F.col(column) == wanted)
    return df.where(F.col("tenure").between(*tenure)) if tenure else df


def search_customers(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive literal substring search on the id."""
    return df.where(F.contains(F.lower("customer_id"), F.lit(text.lower())))


def lookup_customer(df: DataFrame, customer_id: str) -> DataFrame:
    return df.where(F.col("customer_id") == customer_id)


def with_implied_join(df: DataFrame, reference: Column) -> DataFrame:
    """Implied join instant (reference minus tenure in average months) and its calendar parts."""
    age = F.make_dt_interval(secs=F.col("tenure").cast("bigint") * K.SECONDS_PER_MONTH)
    return df.withColumn("implied_join_date", reference - age).withColumns({
        "join_week": F.date_trunc("week", "implied_join_date").cast("date"),
        "join_month": F.date_trunc("month", "implied_join_date").cast("date"),
        "calendar_month_num": F.month("implied_join_date"),
        "calendar_month": F.date_format("implied_join_date", "MMMM"),
    })


def customer_clv(cp: DataFrame, rc: DataFrame) -> DataFrame:
    joined = cp.select("customer_id", "churn_probability", "risk_segment").join(rc.select("customer_id", "monthly_charges"), "customer_id")
    return joined.withColumns({
        "expected_tenure_months": half_up(R.expected_months(F.col("churn_probability")), 1),
        "clv": half_up(R.lifetime_value(F.col("monthly_charges"), F.col("churn_probability")), 2),
    })
