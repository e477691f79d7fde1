"""Headline benchmark: prints one JSON line with seconds per query (best of two runs each).

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS]. The base tables are derived
and written once first; that time is reported as `build_tables`.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "A01_churn_overview", "A02_churn_by_features", "U02_churn_by_services", "A06_churn_by_tenure", "A07_risk_segments",
    "A11_prediction_summary", "A12_score_deciles", "A18_roi_by_tier", "A26_compare_segments", "A31_cohort_table", "A38_top_correlations",
    "A44_box_stats_contract", "A48_week_over_week", "P01_clean_data", "P08_build_processed", "S06_good_rows", "J01_predictions_with_profile",
    "J11_similar_customers", "W03_score_drift", "K05_retention_targets", "G02_segment_customers", "D03_feature_drift", "M01_stratified_split",
    "M09_evaluate", "M17_publish_full", "X01_explain", "X06_what_if", "R03_stream_daily",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from checks.catalog import QUERIES
    from checks.tables import Tables
    from holdfast.session import tune

    tune(spark)
    seconds: dict[str, float] = {}
    start = time.time()
    tables = Tables(spark, sf_dir)
    for name in ("rc", "pc", "cp", "h", "split"):
        getattr(tables, name)
    seconds["build_tables"] = round(time.time() - start, 3)
    for name in HEADLINE:
        best = None
        for _ in range(2):
            start = time.time()
            # all columns are computed, nothing is returned to the driver
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - start)
        seconds[name] = round(best, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, total wall-clock", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").split("sf")[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
