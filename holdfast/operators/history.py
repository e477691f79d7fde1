"""Score history: latest rows, movers, weekly windows, daily trends, prediction summary, deciles."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast import constants as K
from holdfast.functions.customer import churned
from holdfast.functions.rounding import exact_sum, half_up, rate_pct
from holdfast.plans.ordered import running_totals
from holdfast.plans.pick import latest_per_key
from holdfast.plans.summary import stack_sections

_SCORE = ["customer_id", "churn_probability", "risk_segment", "predicted_at"]


def latest_history(h: DataFrame) -> DataFrame:
    """Most recently archived row per customer (ties: greatest id)."""
    last = latest_per_key(h.select("customer_id", "churn_probability", "risk_segment", "archived_at", "id"), ["customer_id"], ["archived_at", "id"])
    return last.select("customer_id", F.col("churn_probability").alias("prev_probability"), F.col("risk_segment").alias("prev_segment"), "archived_at")


def _with_previous(cp: DataFrame, h: DataFrame) -> DataFrame:
    return cp.select("customer_id", "churn_probability", "risk_segment").join(latest_history(h).drop("archived_at"), "customer_id")


def score_drift(cp: DataFrame, h: DataFrame) -> DataFrame:
    """Change against the previous score, largest change first."""
    change = F.col("churn_probability") - F.col("prev_probability")
    return _with_previous(cp, h).select(
        "customer_id", "prev_probability", F.col("churn_probability").alias("current_probability"),
        half_up(change, 4).alias("score_change"), "prev_segment", F.col("risk_segment").alias("current_segment"),
    )


def moved(cp: DataFrame, h: DataFrame, source: str, target: str) -> DataFrame:
    """Customers whose segment went from `source` to `target`."""
    now = cp.where(F.col("risk_segment") == target)
    pairs = _with_previous(now, h).where(F.col("prev_segment") == source)
    return pairs.select("customer_id", "churn_probability", "prev_segment", F.col("risk_segment").alias("current_segment"))


def all_predictions(cp: DataFrame, h: DataFrame) -> DataFrame:
    """Current and archived scores; `record` orders rows of one instant (current last)."""
    current = cp.select(*_SCORE, F.lit((1 << 63) - 1).cast("long").alias("record"))
    return current.unionByName(h.select(*_SCORE, F.col("id").cast("long").alias("record")))


def _in_window(now: Column, start_days: int, end_days: int) -> Column:
    at = F.col("predicted_at")
    return (at >= now - F.make_dt_interval(F.lit(start_days))) & (at < now - F.make_dt_interval(F.lit(end_days)))


def window_snapshot(cp: DataFrame, h: DataFrame, now: Column, start_days: int, end_days: int) -> DataFrame:
    """Latest score per customer inside [now - start, now - end)."""
    rows = all_predictions(cp, h).where(_in_window(now, start_days, end_days))
    return latest_per_key(rows, ["customer_id"], ["predicted_at", "record"]).drop("record")


def _weekly(cp: DataFrame, h: DataFrame, now: Column) -> DataFrame:
    """Latest score per customer and week (`this`, `last`), both windows in one pass."""
    week = F.when(_in_window(now, 7, 0), F.lit("this")).when(_in_window(now, 14, 7), F.lit("last"))
    rows = all_predictions(cp, h).where(_in_window(now, 14, 0)).withColumn("week", week)
    return latest_per_key(rows, ["customer_id", "week"], ["predicted_at", "record"]).drop("record")


def weekly_transitions(cp: DataFrame, h: DataFrame, now: Column) -> DataFrame:
    """This week's and last week's latest score side by side, for customers with both."""
    weekly = _weekly(cp, h, now)
    score = F.struct("churn_probability", "risk_segment", "predicted_at")
    # one row per customer and week at this point, so max() only picks that row
    sides = [F.max(F.when(F.col("week") == w, score)).alias(w) for w in ("this", "last")]
    both = weekly.groupBy("customer_id").agg(*sides).where(F.col("this").isNotNull() & F.col("last").isNotNull())
    return both.select("customer_id", *[F.col(f"{w}.{c}").alias(f"{c}_{w}_week") for w in ("this", "last") for c in _SCORE[1:]])


def week_over_week(cp: DataFrame, h: DataFrame, now: Column) -> DataFrame:
    """One row: customers, average probability and High count of both weeks, and the change."""
    weekly = _weekly(cp, h, now)

    def of(w: str) -> list[Column]:
        hit = F.col("week") == w
        return [
            F.count_if(hit).alias(f"{w}_week_customers"),
            half_up(F.avg(F.when(hit, F.col("churn_probability"))), 4).alias(f"{w}_week_avg_probability"),
            F.count_if(hit & (F.col("risk_segment") == "High")).alias(f"{w}_week_high_risk"),
        ]

    row = weekly.agg(*of("this"), *of("last"))
    return row.withColumn("avg_probability_delta", half_up(F.col("this_week_avg_probability") - F.col("last_week_avg_probability"), 4))


def _entered(transitions: DataFrame, segment: str) -> DataFrame:
    hit = (F.col("risk_segment_this_week") == segment) & (F.col("risk_segment_last_week") != segment)
    return transitions.where(hit).select(
        "customer_id", "risk_segment_last_week", "risk_segment_this_week", "churn_probability_last_week", "churn_probability_this_week"
    )


def new_high_risk(transitions: DataFrame) -> DataFrame:
    return _entered(transitions, "High")


def recovered(transitions: DataFrame) -> DataFrame:
    return _entered(transitions, "Low")


# --- summary report ------------------------------------------------------------

_SUMMARY = T.StructType([
    T.StructField("segment", T.StringType()), T.StructField("customer_id", T.StringType()),
    T.StructField("customer_count", T.LongType()), T.StructField("avg_churn_probability", T.DoubleType()),
    T.StructField("revenue_at_risk", T.DoubleType()), T.StructField("trend_vs_previous", T.LongType()),
    T.StructField("churn_probability", T.DoubleType()), T.StructField("prev_probability", T.DoubleType()),
    T.StructField("score_direction", T.StringType()),
])


def segment_trend(cp: DataFrame, rc: DataFrame, h: DataFrame) -> DataFrame:
    """Per segment: size, average score, revenue and change in size against the previous scores."""
    joined = cp.select("customer_id", "churn_probability", "risk_segment").join(rc.select("customer_id", "monthly_charges"), "customer_id")
    current = joined.groupBy(F.col("risk_segment").alias("segment")).agg(
        F.count("*").alias("customer_count"), half_up(F.avg("churn_probability"), 4).alias("avg_churn_probability"),
        half_up(exact_sum("monthly_charges"), 2).alias("revenue_at_risk"),
    )
    previous = latest_history(h).groupBy(F.col("prev_segment").alias("segment")).agg(F.count("*").alias("prev_count"))
    # one row per segment
    both = current.join(F.broadcast(previous), "segment", "left")
    return both.withColumn("trend_vs_previous", F.col("customer_count") - F.coalesce(F.col("prev_count"), F.lit(0))).drop("prev_count")


def prediction_summary(cp: DataFrame, rc: DataFrame, h: DataFrame, n: int = 20) -> DataFrame:
    """Four sections: segments, n riskiest customers, improving scores, worsening scores."""
    top = cp.select(F.col("risk_segment").alias("segment"), "customer_id", "churn_probability").orderBy(F.desc("churn_probability"), "customer_id").limit(n)
    pairs = _with_previous(cp, h).withColumnRenamed("risk_segment", "segment")
    change = F.col("churn_probability") - F.col("prev_probability")
    return stack_sections({
        "segment_summary": segment_trend(cp, rc, h),
        "top_20_highest_risk": top,
        "improving_scores": pairs.where(change < 0).withColumn("score_direction", F.lit("improving")),
        "worsening_scores": pairs.where(change > 0).withColumn("score_direction", F.lit("worsening")),
    }, _SUMMARY)


# --- distributions over scores -------------------------------------------------


def score_deciles(cp: DataFrame, tiles: int = 10) -> DataFrame:
    """Count, min, max and mean of equal-sized tiles of the ordered scores.

    Equal scores are interchangeable, so the tiles follow from the running counts of the distinct
    scores: a score whose ranks cross a tile border is divided between the tiles.
    """
    counts = cp.where(F.col("churn_probability").isNotNull()).groupBy(F.col("churn_probability").alias("score")).agg(F.count("*").alias("n"))
    spans = running_totals(counts, "score", ["n"])
    size, extra = F.floor(F.col("n_total") / tiles), F.col("n_total") % tiles
    wide = extra * (size + 1)  # ranks below this sit in the tiles that hold one row more

    def tile(rank: Column) -> Column:
        return F.when(rank < wide, F.floor(rank / (size + 1))).otherwise(extra + F.floor((rank - wide) / F.greatest(size, F.lit(1)))).cast("int")

    first, last = F.col("n_upto") - F.col("n"), F.col("n_upto") - 1
    shares = spans.select("score", "n_total", first.alias("first"), last.alias("last"), F.explode(F.sequence(tile(first), tile(last))).alias("tile"))
    start = F.col("tile") * size + F.least(F.col("tile").cast("long"), extra)
    stop = start + size + F.when(F.col("tile") < extra, 1).otherwise(0)  # exclusive
    part = F.least(F.col("last") + 1, stop) - F.greatest(F.col("first"), start)
    parts = shares.select("score", (F.col("tile") + 1).alias("decile"), part.alias("n"))
    return parts.groupBy("decile").agg(
        F.sum("n").cast("long").alias("customer_count"), half_up(F.min("score"), 4).alias("min_score"), half_up(F.max("score"), 4).alias("max_score"),
        half_up(F.sum(F.col("score") * F.col("n")) / F.sum("n"), 4).alias("avg_score"),
    ).orderBy("decile")


def daily_scores(cp: DataFrame, h: DataFrame) -> DataFrame:
    both = all_predictions(cp, h)
    return both.groupBy(F.to_date("predicted_at").alias("day")).agg(half_up(F.avg("churn_probability"), 6).alias("avg_probability"), F.count("*").alias("n")).orderBy("day")


def _daily_latest(h: DataFrame) -> DataFrame:
    days = h.select("customer_id", F.to_date("archived_at").alias("date"), "churn_probability", "risk_segment", "archived_at", "id")
    return latest_per_key(days, ["customer_id", "date"], ["archived_at", "id"])


def daily_risk_trend(h: DataFrame) -> DataFrame:
    return _daily_latest(h).groupBy("date").agg(
        half_up(F.avg("churn_probability"), 6).alias("avg_probability"), F.count_if(F.col("risk_segment") == "High").alias("high_risk_count")
    ).orderBy("date")


def daily_segment_trend(h: DataFrame) -> DataFrame:
    return _daily_latest(h).groupBy("date", "risk_segment").agg(F.count("*").alias("count")).orderBy("date", "risk_segment")


def kpi_deltas(customers: DataFrame, h: DataFrame) -> DataFrame:
    """Churn rate, High count and revenue of (filtered) customers, and the change against the
    previous archived segments; the changes are NULL when none of them was archived."""
    previous = latest_history(h).select("customer_id", "prev_segment")
    both = customers.select("customer_id", "churn", "monthly_charges", "risk_segment").join(previous, "customer_id", "left")
    y, charges = churned(F.col("churn")), F.col("monthly_charges")
    known = F.col("prev_segment").isNotNull()

    def revenue(segment: str) -> Column:
        return F.coalesce(exact_sum(F.when(F.col(segment).isin("High", "Medium"), charges)).cast("double"), F.lit(0.0))

    row = both.agg(
        F.avg(y).alias("rate"), F.avg(F.when(known, y)).alias("prev_rate"), F.count_if(known).alias("n_prev"),
        F.count_if(F.col("risk_segment") == "High").alias("high_risk_count"), F.count_if(F.col("prev_segment") == "High").alias("prev_high"),
        revenue("risk_segment").alias("revenue"), revenue("prev_segment").alias("prev_revenue"),
    )

    def delta(now: str, before: str, digits: int) -> Column:
        return F.when(F.col("n_prev") > 0, half_up(F.col(now) - F.col(before), digits))

    return row.select(
        half_up(F.coalesce(F.col("rate"), F.lit(0.0)), 4).alias("churn_rate"), "high_risk_count", half_up(F.col("revenue"), 2).alias("revenue_at_risk"),
        delta("rate", "prev_rate", 4).alias("churn_rate_delta"),
        F.when(F.col("n_prev") > 0, F.col("high_risk_count") - F.col("prev_high")).alias("high_risk_delta"),
        delta("revenue", "prev_revenue", 2).alias("revenue_delta"),
    )
