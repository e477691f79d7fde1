"""Population stability, churn-rate drift, score sanity checks, monitoring reports, alerts."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.functions import risk as R
from holdfast.functions.customer import churned
from holdfast.functions.rounding import half_up
from holdfast.plans.ordered import quantile_aggregates, running_totals

DIGITS = 9  # edges and values are compared at this precision


def psi_table(df: DataFrame, columns: Sequence[str], split: str = "split", expected: str = "train", actual: str = "test", buckets: int = K.PSI_BUCKETS) -> DataFrame:
    """(feature, psi, status, expected_mean, actual_mean) for every column, in one job.

    Buckets are the quantile bins of the expected side, left-closed, open at both ends; equal edges
    merge. A bucket that one side leaves empty counts with a small share. Both sides are reduced to
    counts per distinct value first; edges, buckets and means all come from those counts.
    """
    sides = df.where(F.col(split).isin(expected, actual))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    long = sides.select(F.explode(pairs).alias("_p"), (F.col(split) == expected).cast("int").alias("_e")).select("_p.*", "_e")
    counts = long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.sum("_e").alias("e"), F.sum(1 - F.col("_e")).alias("a"))

    probs = [i / buckets for i in range(1, buckets)]
    spans = running_totals(counts, "value", ["e", "a"], ["feature"])
    cut = spans.groupBy("feature").agg(
        F.array(*quantile_aggregates(probs, "e")).alias("q"), F.max("e_upto").alias("e_total"), F.max("a_upto").alias("a_total")
    )
    edges = cut.select("feature", F.array_distinct(F.transform("q", lambda e: F.round(e, DIGITS))).alias("_edges"), "e_total", "a_total")
    # one row per column of the schema, with fewer than `buckets` edges
    placed = counts.join(F.broadcast(edges), "feature").withColumn("_x", F.round("value", DIGITS))
    bucket = F.size(F.filter("_edges", lambda e: e <= F.col("_x")))
    mass = [(F.col("value") * F.col(s)).alias(f"{s}_mass") for s in ("e", "a")]
    placed = placed.select("feature", bucket.alias("bucket"), "e", "a", "e_total", "a_total", *mass)
    filled = placed.groupBy("feature", "bucket", "e_total", "a_total").agg(*[F.sum(c).alias(c) for c in ("e", "a", "e_mass", "a_mass")])

    def share(c: str) -> Column:
        return F.when(F.col(c) == 0, F.lit(K.PSI_EPSILON)).otherwise(F.col(c) / F.greatest(F.col(f"{c}_total"), F.lit(1)))

    term = (share("a") - share("e")) * F.ln(share("a") / share("e"))
    means = [(F.sum(f"{s}_mass") / F.nullif(F.sum(s), F.lit(0))).alias(f"{name}_mean") for s, name in (("e", "expected"), ("a", "actual"))]
    table = filled.groupBy("feature").agg(half_up(F.sum(term), 4).alias("psi"), *means)
    return table.select("feature", "psi", R.psi_status(F.col("psi")).alias("status"), "expected_mean", "actual_mean")


def psi(expected: DataFrame, actual: DataFrame, column: str, buckets: int = K.PSI_BUCKETS) -> DataFrame:
    """PSI of one column between two frames, as one row."""
    sides = [df.select(F.col(column).cast("double").alias(column), F.lit(name).alias("split")) for df, name in ((expected, "train"), (actual, "test"))]
    return psi_table(sides[0].unionByName(sides[1]), [column], buckets=buckets).select("feature", "psi", "status")


def feature_drift(df: DataFrame, columns: Sequence[str] = K.MODEL_FEATURES) -> DataFrame:
    return psi_table(df, columns).select("feature", "psi", "status").orderBy(F.desc("psi"), "feature")


def prediction_drift(df: DataFrame) -> DataFrame:
    """PSI and means of the scores between the splits."""
    t = psi_table(df, ["churn_probability"])
    return t.select(
        F.lit("prediction_scores").alias("metric"), "psi", "status",
        half_up(F.col("expected_mean"), 4).alias("expected_mean"), half_up(F.col("actual_mean"), 4).alias("actual_mean"),
    )


def business_drift(tagged: DataFrame) -> DataFrame:
    """Drift of tenure and monthly charges with the split means."""
    t = psi_table(tagged, ["tenure", "monthly_charges"])
    return t.select("feature", "psi", "status", half_up(F.col("expected_mean"), 2).alias("train_mean"), half_up(F.col("actual_mean"), 2).alias("test_mean"))


def churn_rate_drift(tagged: DataFrame) -> DataFrame:
    """Two-class PSI of the churn rate, the change in points and whether it exceeds the threshold."""
    y = churned(F.col("churn")).cast("double")
    rates = tagged.agg(
        F.coalesce(F.avg(F.when(F.col("split") == "train", y)), F.lit(0.0)).alias("e"), F.coalesce(F.avg(F.when(F.col("split") == "test", y)), F.lit(0.0)).alias("a")
    )

    def term(expected: Column, actual: Column) -> Column:
        e, a = F.greatest(expected, F.lit(K.PSI_EPSILON)), F.greatest(actual, F.lit(K.PSI_EPSILON))
        return (a - e) * F.ln(a / e)

    value = half_up(term(1 - F.col("e"), 1 - F.col("a")) + term(F.col("e"), F.col("a")), 4)
    delta = half_up((F.col("a") - F.col("e")) * 100, 2)
    return rates.select(
        F.lit("churn_rate").alias("feature"), value.alias("psi"), R.psi_status(value).alias("status"), half_up(F.col("e") * 100, 2).alias("train_churn_rate_pct"),
        half_up(F.col("a") * 100, 2).alias("test_churn_rate_pct"), delta.alias("delta_pct_points"), (F.abs(delta) > K.CHURN_RATE_DRIFT_POINTS).alias("drifted"),
    )


def drift_metrics(features: DataFrame, scored: DataFrame) -> DataFrame:
    """(metric, psi): the scores and every feature, from one pass over the joined table."""
    both = features.join(scored.select("customer_id", "churn_probability"), "customer_id", "left")
    table = psi_table(both, [*K.MODEL_FEATURES, "churn_probability"])
    metric = F.when(F.col("feature") == "churn_probability", F.lit("prediction_scores")).otherwise(F.col("feature"))
    return table.select(metric.alias("metric"), "psi")


def monitoring_report(metrics: DataFrame, model_name: Column) -> DataFrame:
    """One row: model, score PSI, greatest PSI and the overall status."""
    top = F.max("psi")
    row = metrics.agg(F.max(F.when(F.col("metric") == "prediction_scores", F.col("psi"))).alias("prediction_psi"), top.alias("max_psi"))
    return row.select(model_name.alias("model_name"), "prediction_psi", "max_psi", R.psi_status(F.col("max_psi")).alias("overall_status"))


def drift_alerts(metrics: DataFrame, threshold: float = K.PSI_SIGNIFICANT) -> DataFrame:
    """A message per metric whose PSI is above the threshold."""
    text = F.format_string("%.4f", F.col("psi"))
    score = F.concat(F.lit("Prediction score drift PSI="), text, F.lit(f" exceeds threshold {threshold} — model outputs on current data no longer resemble training data."))
    feature = F.concat(F.lit("Feature '"), F.col("metric"), F.lit("' drift PSI="), text, F.lit(f" exceeds threshold {threshold} — consider investigating input data quality or retraining."))
    message = F.when(F.col("metric") == "prediction_scores", score).otherwise(feature)
    return metrics.where(F.col("psi") > threshold).select("metric", "psi", message.alias("message"))


def retrain_needed(metrics: DataFrame, threshold: float = K.PSI_SIGNIFICANT) -> DataFrame:
    row = monitoring_report(metrics, F.lit(None).cast("string")).drop("model_name")
    return row.select((F.col("max_psi") > threshold).alias("retrain_needed"), "max_psi", F.lit(threshold).alias("threshold"), "prediction_psi", "overall_status")


# --- score checks ------------------------------------------------------------


def check_scores(cp: DataFrame) -> DataFrame:
    """Range and NULL check of the scores with their min, max, mean, deviation and count."""
    p = F.col("churn_probability")
    bad = F.count_if(p.isNull() | ~p.between(0, 1))
    return cp.agg(
        (bad == 0).alias("passed"), F.min(p).alias("min"), F.max(p).alias("max"), half_up(F.avg(p), 6).alias("mean"), half_up(F.stddev_samp(p), 6).alias("std"), F.count("*").alias("n")
    )


def check_segments(cp: DataFrame) -> DataFrame:
    """Whether all segments are known, present and within the plausible share."""
    counts = cp.where(F.col("risk_segment").isNotNull()).groupBy("risk_segment").agg(F.count("*").alias("n"))
    share = F.col("n") * 100.0 / counts.agg(F.sum("n")).scalar()
    shares = counts.withColumn("pct", share)
    known, fits = F.col("risk_segment").isin(K.SEGMENTS), F.col("pct").between(K.SEGMENT_SHARE_MIN, K.SEGMENT_SHARE_MAX)
    row = shares.agg(
        F.coalesce(F.bool_and(known), F.lit(True)).alias("valid_values"),
        ((F.count("*") == len(K.SEGMENTS)) & F.coalesce(F.bool_and(fits), F.lit(False))).alias("realistic_spread"),
        *[half_up(F.coalesce(F.max(F.when(F.col("risk_segment") == s, F.col("pct"))), F.lit(0.0)), 2).alias(f"{s.lower()}_pct") for s in K.SEGMENTS],
    )
    return row.select((F.col("valid_values") & F.col("realistic_spread")).alias("passed"), "*")


def take_snapshot(cp: DataFrame, now: Column) -> DataFrame:
    """The row to append to the snapshot table: mean score and time."""
    return cp.agg(F.avg("churn_probability").alias("mean_score")).withColumn("snapshot_at", now)


def score_snapshot_drift(cp: DataFrame, snapshots: DataFrame, now: Column, threshold: float = K.SCORE_DRIFT_ALERT) -> DataFrame:
    """Change of the mean score against the newest snapshot before `now`; 0 without one."""
    before = snapshots.where(F.col("snapshot_at") < now)
    previous = before.agg(F.max_by("mean_score", "snapshot_at")).scalar()
    row = cp.agg(F.avg("churn_probability").alias("c")).withColumn("p", previous)
    known = F.col("p").isNotNull()
    drift = F.when(known, F.abs(F.col("c") - F.col("p"))).otherwise(F.lit(0.0))
    return row.select(
        known.alias("has_previous_snapshot"), half_up(F.col("p"), 6).alias("previous_mean"), half_up(F.col("c"), 6).alias("current_mean"),
        half_up(drift, 6).alias("drift"), (known & (drift > threshold)).alias("alert"),
    )


def prediction_report(cp: DataFrame, snapshots: DataFrame, now: Column) -> DataFrame:
    """(place, check, status, detail) rows of the score, segment and drift checks and the overall result."""
    def four(c: str) -> Column:
        return F.format_string("%.4f", half_up(F.col(c), 4))

    scores = check_scores(cp).select(
        F.lit(1).alias("place"), F.lit("Score Distribution").alias("check"), F.col("passed"),
        F.concat(F.lit("n="), F.col("n").cast("string"), *[x for c in ("min", "max", "mean", "std") for x in (F.lit(f"  {c}="), four(c))]).alias("detail"),
    )
    shares = F.concat_ws(", ", *[F.concat(F.lit(f"{s}: "), F.format_string("%.2f%%", F.col(f"{s.lower()}_pct"))) for s in K.SEGMENTS])
    segments = check_segments(cp).select(F.lit(2).alias("place"), F.lit("Segment Distribution").alias("check"), "passed", shares.alias("detail"))
    checks = scores.unionByName(segments)
    words = F.when(F.col("passed"), F.lit("PASS")).otherwise(F.lit("FAIL"))
    drift = score_snapshot_drift(cp, snapshots, now)
    change = F.concat(F.lit("previous mean: "), four("previous_mean"), F.lit("  current mean: "), four("current_mean"), F.lit("  drift: "), four("drift"))
    drift_row = drift.select(
        F.lit(3).alias("place"), F.lit("Score Drift").alias("check"), F.when(F.col("alert"), F.lit("ALERT")).otherwise(F.lit("OK")).alias("status"),
        F.when(F.col("has_previous_snapshot"), change).otherwise(F.lit("No previous snapshot - this run establishes the baseline.")).alias("detail"),
    )
    overall = checks.agg(F.bool_and("passed").alias("passed")).select(
        F.lit(4).alias("place"), F.lit("Overall").alias("check"), words.alias("status"),
        F.when(F.col("passed"), F.lit("ALL CHECKS PASSED")).otherwise(F.lit("SOME CHECKS FAILED")).alias("detail"),
    )
    return reduce(DataFrame.unionByName, [checks.select("place", "check", words.alias("status"), "detail"), drift_row, overall])


# --- alerts --------------------------------------------------------------------

PREVIEW = 10


def high_risk_alert(customers: DataFrame) -> DataFrame:
    """One alert naming the first ten newly risky customers and the number of the others."""
    first = customers.select("customer_id").orderBy("customer_id").limit(PREVIEW)
    ids = first.agg(F.array_join(F.array_sort(F.collect_list("customer_id")), ", ")).scalar()
    row = customers.agg(F.count("*").alias("n")).withColumn("ids", ids)
    more = F.when(F.col("n") > PREVIEW, F.concat(F.lit(", and "), (F.col("n") - PREVIEW).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    some = F.concat(F.col("n").cast("string"), F.lit(" customer(s) newly flagged High risk: "), F.col("ids"), more)
    return row.select(
        F.lit("high_risk").alias("alert_type"), F.when(F.col("n") > 0, F.lit("warning")).otherwise(F.lit("info")).alias("severity"),
        F.when(F.col("n") > 0, some).otherwise(F.lit("No new high-risk customers to alert on.")).alias("message"),
    )


def model_drift_alert(report: DataFrame, threshold: float = K.PSI_SIGNIFICANT) -> DataFrame:
    """One alert on the greatest PSI of a monitoring report."""
    over = F.col("max_psi") > threshold
    tail = F.when(over, F.lit("significant drift detected.")).otherwise(F.lit("within threshold."))
    text = F.concat(F.lit("Model drift PSI="), F.format_string("%.4f", F.col("max_psi")), F.lit(f" (threshold={threshold}) — "), tail)
    return report.select(F.lit("model_drift").alias("alert_type"), F.when(over, F.lit("critical")).otherwise(F.lit("info")).alias("severity"), text.alias("message"))


def failure_alerts(runs: DataFrame) -> DataFrame:
    """A critical alert per failed run."""
    return runs.where(F.col("status") == "failed").select(
        F.lit("pipeline_failure").alias("alert_type"), F.lit("critical").alias("severity"), F.concat(F.lit("Pipeline failure: "), F.col("details")).alias("message")
    )


def weekly_digest_alert(wow: DataFrame) -> DataFrame:
    delta = F.coalesce(F.format_string("%.4f", F.col("avg_probability_delta")), F.lit("n/a"))
    text = F.concat(F.lit("Weekly digest: "), F.col("this_week_high_risk").cast("string"), F.lit(" high-risk customers (avg probability delta "), delta, F.lit(")"))
    return wow.select(F.lit("weekly_digest").alias("alert_type"), F.lit("info").alias("severity"), text.alias("message"))
