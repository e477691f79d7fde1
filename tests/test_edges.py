"""Empty inputs, NULLs, absent tables, broken files, reruns, late rows."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast import schemas
from holdfast.jobs import daily, weekly
from holdfast.operators import cohorts, drift, history, ingest, quality, registry, segments, summaries, value
from holdfast.sources import files
from holdfast.sources.tables import TableStore
from holdfast.streaming import jobs as R


@pytest.fixture
def empty(spark):
    return {name: spark.createDataFrame([], schema) for name, schema in schemas.TABLES.items()}


def test_empty_input_gives_zeros(empty, tables):
    rc, cp, h = empty["raw_customers"], empty["churn_predictions"], empty["churn_predictions_history"]
    assert value.estimate_retention_savings(cp, rc).first().asDict() == {
        "customers_targeted": 0, "campaign_cost_per_customer": 15.0, "success_rate": 0.3, "total_cost": 0.0,
        "expected_customers_retained": 0.0, "revenue_recovered": 0.0, "roi_pct": 0.0}
    profile = segments.compare_segments(cp, rc).collect()
    assert [r.segment for r in profile] == ["High", "Medium", "Low"] and all(r.customer_count == 0 and r.pct_senior_citizen == 0 for r in profile)
    wow = history.week_over_week(cp, h, tables.now).first()
    assert wow.this_week_customers == 0 and wow.this_week_avg_probability is None and wow.avg_probability_delta is None
    assert value.revenue_at_risk(cp, rc).first()[0] == 0.0
    assert summaries.churn_rate(rc).first().churn_rate == 0.0
    assert drift.check_segments(cp).first().passed is False
    assert history.score_deciles(cp).count() == 0
    assert summaries.risk_segments(cp, rc).where("risk_segment <> 'High+Medium (At Risk)'").count() == 0


def test_default_recommendation(spark, empty):
    lines = segments.segment_recommendations(segments.compare_segments(empty["churn_predictions"], empty["raw_customers"]))
    # no customers: tenure 0 is a new segment by rule
    assert lines.where("recommendation like 'Average tenure is only 0 months%'").count() == 3


def test_forecast_needs_two_points(spark):
    one = spark.createDataFrame([(dt.date(2024, 1, 1), 50.0)], "join_month date, churn_rate double")
    with pytest.raises(Exception, match="Need at least 2"):
        cohorts.forecast_churn(one).collect()
    steep = spark.createDataFrame([(dt.date(2023, 12, 1), 10.0), (dt.date(2024, 1, 1), 90.0)], "join_month date, churn_rate double")
    assert [r.churn_rate for r in cohorts.forecast_churn(steep).orderBy("join_month").collect()] == [100.0] * 3


def test_missing_columns(tables):
    with pytest.raises(ValueError, match="churn"):
        quality.require_columns(tables.rc.drop("churn"))


def test_request_validation(spark, tables):
    base = tables.rc.limit(1).withColumns({"senior_citizen": F.lit(0), "tenure": F.lit(12), "monthly_charges": F.lit(85.5), "total_charges": F.lit(1026.0)})
    cases = base.unionByName(base.withColumn("monthly_charges", F.lit(-5.0))).unionByName(base.withColumns({"total_charges": F.lit(0.0), "monthly_charges": F.lit(500.0)}))
    good, bad, _ = quality.validate_rows(cases, quality.request_rules())
    assert good.count() == 1
    assert {tuple(r.violations) for r in bad.collect()} == {("non_positive_monthly_charges",), ("total_below_monthly_charges",)}


def test_null_is_a_violation(spark, tables):
    row = tables.rc.limit(1).withColumn("contract", F.lit(None).cast("string"))
    assert quality.tag_violations(row).first().violations == ["unknown_contract"]


def test_csv_with_broken_line(spark, tmp_path, tables):
    path = str(tmp_path / "c.csv")
    cols = [f.name for f in schemas.RAW_CUSTOMERS]
    good = ["x"] * len(cols)
    good[2], good[5], good[18], good[19] = "0", "3", "20.5", " "
    (tmp_path / "c.csv").write_text("\n".join([",".join(cols), ",".join(good), ",".join(good[:5] + ["many"] + good[6:])]))
    df = files.read_customers_csv(spark, path).cache()
    assert df.where("_corrupt_record is not null").count() == 1
    assert quality.clean_raw(df).where("_corrupt_record is null").first().total_charges == 0.0


def test_snapshot_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    assert store.log("raw_customers").count() == 0
    frame = lambda n: spark.range(n).select(F.col("id").cast("string").alias("customer_id"))
    store.write("ids", frame(3), "2024-01-01")
    store.write("ids", frame(5), "2024-01-02")
    store.write("ids", frame(5), "2024-01-02")
    assert store.snapshot("ids").count() == 5 and store.snapshot("ids", before="2024-01-02").count() == 3 and store.log("ids").count() == 8


def test_store_appends_and_hides_half_written_runs(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    frame = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("customer_id"))
    store.write("ids", frame(0, 3), "2024-01-01")
    store.write("ids", frame(3, 5), "ingest-000000000000", "append")
    frame(0, 100).write.parquet(store.path("ids") + "/run_id=broken/attempt=x")  # never committed
    assert store.snapshot("ids").count() == 5 and store.snapshot("ids", before="ingest-000000000000").count() == 3
    store.write("ids", frame(0, 2), "2024-01-02")
    store.write("ids", frame(3, 9), "ingest-000000000000", "append")  # replayed: keeps its place before the replacing run
    assert store.snapshot("ids").count() == 2 and store.snapshot("ids", before="2024-01-02").count() == 9
    assert all("run_id=2024-01-02" in f for f in store.snapshot("ids").inputFiles())  # no other run is listed or read
    with pytest.raises(ValueError):
        store.write("ids", frame(0, 1), "a/b")


def test_stream_then_daily_job_keeps_all_customers(spark, tmp_path, tables):
    store, landing = TableStore(spark, str(tmp_path / "tables")), str(tmp_path / "landing")
    tables.rc.orderBy("customer_id").limit(60).repartition(2).write.parquet(landing)
    rows = R.landing_stream(spark, landing, tables.rc.schema, files_per_batch=1)
    R.stream_ingest(rows, store, str(tmp_path / "checkpoint"), ["customer_id"]).awaitTermination()
    assert store.snapshot("raw_customers").count() == 60
    daily.daily_job(store, tables.rc, tables.card, tables.now, "2024-01-31", order=["customer_id"])
    assert store.snapshot("raw_customers").count() == store.snapshot("churn_predictions").count() == tables.rc.count()
    written = spark.read.parquet(store.path("raw_customers") + "/run_id=2024-01-31")
    assert written.count() == tables.rc.count() - 60  # an incremental load writes the new rows only


def test_rollback_needs_another_model(tables):
    one = tables.reg.limit(1)
    with pytest.raises(ValueError):
        registry.rollback(one)
    assert registry.rollback(tables.reg).where("is_active").count() == 1


def test_daily_job_is_repeatable(spark, tmp_path, tables):
    store = TableStore(spark, str(tmp_path))
    store.write("raw_customers", tables.known_rc, "2024-01-30")
    store.write("churn_predictions", tables.known_cp, "2024-01-30")
    sizes = []
    for _ in range(2):
        daily.daily_job(store, tables.rc, tables.card, tables.now, "2024-01-31", order=["customer_id"])
        sizes.append([store.log(n).count() for n in ("raw_customers", "churn_predictions", "churn_predictions_history", "alerts", "pipeline_runs")])
    assert sizes[0] == sizes[1]
    assert store.snapshot("churn_predictions").count() == tables.rc.count()
    assert store.log("churn_predictions_history").count() == tables.known_cp.count()
    assert weekly.weekly_job(store, tables.now, "2024-01-31").first().status == "success"


def test_failed_job_is_recorded(spark, tmp_path, tables):
    store = TableStore(spark, str(tmp_path))
    with pytest.raises(ValueError):
        daily.daily_job(store, tables.rc.drop("churn"), tables.card, tables.now, "2024-01-31", order=["customer_id"])
    row = store.log("pipeline_runs").first()
    assert row.status == "failed" and "churn" in row.details


def test_stream_ingest_replay(spark, tmp_path, tables):
    """Two files with overlapping ids, then a stream that starts over: the table stays the same."""
    landing, store = str(tmp_path / "landing"), TableStore(spark, str(tmp_path / "tables"))
    tables.rc.limit(40).write.parquet(landing + "/a")
    tables.rc.limit(60).write.parquet(landing + "/b")
    for attempt in ("one", "two"):
        rows = R.landing_stream(spark, landing + "/*", tables.rc.schema, files_per_batch=1)
        R.stream_ingest(rows, store, str(tmp_path / attempt), ["customer_id"]).awaitTermination()
        log = store.log("raw_customers")
        assert log.count() == log.select("customer_id").distinct().count() == 60


def test_stream_daily_drops_late_rows(spark, tmp_path):
    schema = "churn_probability double, archived_at timestamp_ntz"
    landing = str(tmp_path / "landing")

    def put(*rows):
        frame = pd.DataFrame([(p, pd.Timestamp(at)) for p, at in rows], columns=["churn_probability", "archived_at"])
        spark.createDataFrame(frame, schema).coalesce(1).write.mode("append").parquet(landing)

    def run():
        stream = R.landing_stream(spark, landing, spark.createDataFrame([], schema).schema)
        R.stream_daily(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()

    put((0.2, "2024-01-01 10:00"), (0.4, "2024-01-01 11:00"), (0.9, "2024-01-05 01:00"))
    run()
    put((1.0, "2024-01-01 12:00"), (0.5, "2024-01-09 00:00"))  # the first one is too late
    run()
    days = {str(r.day): (round(r.avg_probability, 6), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert days["2024-01-01"] == (0.3, 2) and days["2024-01-05"] == (0.9, 1) and "2024-01-09" not in days


def test_alert_preview(spark):
    ids = spark.range(12).select(F.format_string("c%02d", "id").alias("customer_id"))
    text = drift.high_risk_alert(ids).first().message
    assert text.startswith("12 customer(s) newly flagged High risk: c00, c01") and text.endswith("c09, and 2 more")
    assert drift.high_risk_alert(ids.limit(0)).first().severity == "info"
