"""Weekly job: week over week, newly risky and recovered customers, digest."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.jobs.runs import recorded
from holdfast.operators import drift, history
from holdfast.sources import files
from holdfast.sources.tables import TableStore


def weekly_summary(cp: DataFrame, h: DataFrame, now: Column) -> dict[str, DataFrame]:
    moves = history.weekly_transitions(cp, h, now)
    return {
        "week_over_week": history.week_over_week(cp, h, now),
        "new_high_risk": history.new_high_risk(moves),
        "recovered": history.recovered(moves),
    }


def digest(summary: dict[str, DataFrame]) -> DataFrame:
    """The headline lines of the digest as (place, line)."""
    sizes = {name: summary[name].agg(F.count("*")).scalar() for name in ("new_high_risk", "recovered")}
    w = summary["week_over_week"].withColumns(sizes)

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    arrow, four = F.lit(" -> "), lambda c: F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("None"))
    lines = F.array(
        F.concat(F.lit("Customers scored: "), text("last_week_customers"), arrow, text("this_week_customers")),
        F.concat(F.lit("Avg churn probability: "), four("last_week_avg_probability"), arrow, four("this_week_avg_probability"), F.lit(" (delta "), four("avg_probability_delta"), F.lit(")")),
        F.concat(F.lit("High risk customers: "), text("last_week_high_risk"), arrow, text("this_week_high_risk")),
        F.concat(F.lit("New High Risk ("), text("new_high_risk"), F.lit(")")),
        F.concat(F.lit("Recovered to Low Risk ("), text("recovered"), F.lit(")")),
    )
    return w.select(F.posexplode(lines).alias("place", "line"))


def listed(moves: DataFrame) -> DataFrame:
    """The customers of a list with their segments, by id."""
    return moves.select("customer_id", "risk_segment_last_week", "risk_segment_this_week").orderBy("customer_id")


def weekly_job(store: TableStore, now: Column, run_id: str) -> DataFrame:
    """Write the summary tables and the digest, log the run."""

    def work() -> tuple[int, str]:
        cp, h = store.snapshot("churn_predictions"), store.log("churn_predictions_history").drop("run_id")
        summary = weekly_summary(cp, h, now)
        for name, frame in summary.items():
            store.write(f"weekly_{name}", frame, run_id)
        wow = store.snapshot("weekly_week_over_week")
        written = {name: store.snapshot(f"weekly_{name}") for name in summary}
        store.write("alerts", drift.weekly_digest_alert(wow).select(F.xxhash64("alert_type", now).alias("id"), "*", now.alias("created_at")), run_id, "append")
        sections = [("Headlines", digest(written).orderBy("place").select("line")), ("New High Risk", listed(written["new_high_risk"])), ("Recovered to Low Risk", listed(written["recovered"]))]
        files.write_sections("Weekly Churn Digest", sections, f"{store.path('weekly_digest')}/run_id={run_id}")
        fresh, back = written["new_high_risk"].count(), written["recovered"].count()
        return wow.first().this_week_customers, f"new_high_risk={fresh}, recovered={back}"

    return recorded(store, "weekly_pipeline", run_id, now, work)
