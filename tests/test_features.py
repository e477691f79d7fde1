"""Golden frames for the feature columns."""

import pytest
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.functions import customer as C
from holdfast.functions import risk as R
from holdfast.functions.rounding import half_up
from holdfast.operators import features as P

COLUMNS = ["customer_id", "tenure", "monthly_charges", "total_charges", "contract", "payment_method", "phone_service", "internet_service", *K.ADDON_COLUMNS, "churn"]
ROWS = [
    ("C1", 5, 70.0, 350.0, "Month-to-month", "Electronic check", "Yes", "Fiber optic", "No", "No", "No", "No", "Yes", "Yes", "Yes"),
    ("C2", 15, 60.0, 900.0, "One year", "Mailed check", "Yes", "DSL", "Yes", "No", "No", "No", "No", "No", "No"),
    ("C3", 30, 50.0, 1500.0, "Two year", "Bank transfer (automatic)", "No", "DSL", "Yes", "Yes", "Yes", "Yes", "Yes", "Yes", "No"),
    ("C4", 60, 90.0, 5400.0, "Month-to-month", "Credit card (automatic)", "Yes", "No", *["No internet service"] * 6, "Yes"),
    ("C5", 1, 20.0, 20.0, "One year", "Electronic check", "No", "No", *["No internet service"] * 6, "No"),
    ("C6", 72, 110.0, 7920.0, "Two year", "Mailed check", "Yes", "Fiber optic", *["Yes"] * 6, "No"),
]


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def column(df, name):
    return [r[name] for r in df.orderBy("customer_id").collect()]


def test_golden_columns(sample):
    out = P.with_churn_label(P.engineer(sample))
    names = ["New Customer", "Growing Customer", "Established Customer", "Loyal Customer", "New Customer", "Loyal Customer"]
    assert column(out, "tenure_group") == names
    assert column(out, "contract_risk_score") == [3, 2, 1, 3, 2, 1]
    assert column(out, "payment_risk_score") == [3, 2, 1, 1, 3, 2]
    assert column(out, "services_count") == [4, 3, 7, 1, 0, 8]
    assert column(out, "churn_label") == [1, 0, 0, 1, 0, 0]


def one(spark, values, kind, build):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r.y for r in df.select(build(F.col("x")).alias("y")).collect()]


def test_tenure_edges(spark):
    at = [-1, 0, 12, 13, 24, 25, 48, 49, 72, 73, None]
    assert one(spark, at, "int", C.tenure_group) == [
        None, "New Customer", "New Customer", "Growing Customer", "Growing Customer", "Established Customer", "Established Customer",
        "Loyal Customer", "Loyal Customer", "Loyal Customer", None]
    ranges = one(spark, at, "int", lambda c: C.tenure_group(c, K.TENURE_LABELS_SQL))
    assert ranges == ["0-12", "0-12", "0-12", "12-24", "12-24", "24-48", "24-48", "48+", "48+", "48+", None]


def test_segment_boundaries(spark):
    assert one(spark, [0.9, 0.7, 0.5, 0.4, 0.39, 0.1], "double", R.risk_segment) == ["High", "High", "Medium", "Medium", "Low", "Low"]
    assert R.thresholds(0.6) == (0.6, 0.3) and R.thresholds(0.9) == (0.9, 0.4)


def test_tiers_and_actions(spark):
    assert one(spark, [70.01, 70.0, 40.0, 39.99], "double", R.retention_tier) == ["Tier 1", "Tier 2", "Tier 2", "Tier 3"]
    df = spark.createDataFrame([("High", 80.0), ("High", 10.0), ("Medium", 80.0), ("Low", 80.0)], "s string, m double")
    rows = df.select(R.recommended_action(F.col("s"), R.retention_priority(F.col("s"), F.col("m"))).alias("a")).collect()
    assert [r.a.split()[0] for r in rows] == ["Priority", "Low-cost", "Monitor", "No"]


def test_expected_months_at_zero(spark):
    assert one(spark, [0.0, 0.01, 0.5, 1.0], "double", R.expected_months) == [60.0, 60.0, 2.0, 1.0]


def test_rounding_is_half_away_from_zero(spark):
    assert one(spark, [1.005, -1.005, 0.125, 149129.545], "double", lambda c: half_up(c, 2)) == [1.01, -1.01, 0.13, 149129.55]


def test_whole_days_truncate(spark):
    df = spark.sql("select timestamp_ntz'2024-01-30 23:00:00' a, timestamp_ntz'2024-01-31 00:00:00' b")
    r = df.select(R.whole_days(F.col("a"), F.col("b")).alias("x"), R.whole_days(F.col("b"), F.col("a")).alias("y")).first()
    assert (r.x, r.y) == (0, 0)


def test_zero_tenure_divisor(spark):
    df = spark.createDataFrame([(0, 50.0), (2, 50.0)], "tenure int, total_charges double")
    assert [r.charge_per_month for r in P.with_charge_per_month(df).collect()] == [50.0, 25.0]


def test_one_hot_unknown_level(sample):
    row = P.one_hot(sample.where("customer_id = 'C1'").withColumn("contract", F.lit("Weekly")), {"contract": K.CONTRACTS}).first()
    assert [row[f"contract_{c}"] for c in K.CONTRACTS] == [0, 0, 0]


def test_fit_levels_refuses_ids(sample):
    with pytest.raises(ValueError):
        P.fit_levels(sample, ["customer_id"], max_levels=3)


def test_clean_data_fills(spark, tables):
    df = tables.rc.limit(50).withColumn("tenure", F.lit(None).cast("int"))
    df = df.unionByName(tables.rc.limit(3).withColumn("tenure", F.lit(7)))
    cleaned = P.clean_data(df)
    assert cleaned.where("tenure <> 7.0").count() == 0
