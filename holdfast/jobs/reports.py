"""Composed reports: each gathers the small tables of one subject; `write_all` stores them as text."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.operators import cohorts, drift, explain, segments, summaries, value
from holdfast.sources import files
from holdfast.sources.tables import TableStore

Sections = list[tuple[str, DataFrame]]


@dataclass(frozen=True)
class Inputs:
    """Customers, predictions, labelled features with their split, any fitted model, and the time of the report."""

    rc: DataFrame
    cp: DataFrame
    split: DataFrame
    model: object
    now: Column


def drivers(x: Inputs) -> Sections:
    top = explain.top_drivers(x.rc, x.model)
    return [
        ("Top drivers", explain.actionable_insights(top).orderBy(F.desc("mean_abs_shap"), "feature")),
        ("Drivers by risk segment", explain.drivers_by_segment(x.rc, x.cp, x.model).orderBy("risk_segment", "rank")),
    ]


def trend(x: Inputs) -> Sections:
    months = cohorts.churn_trend(x.rc, x.now)
    return [
        ("Insight", cohorts.trend_insight(x.rc, x.now)), ("Churn by month", months), ("Forecast", cohorts.forecast_churn(months)),
        ("Seasonality", cohorts.seasonal_patterns(x.rc, x.now)), ("Calendar months", cohorts.calendar_months(x.rc, x.now)),
    ]


def segmentation(x: Inputs) -> Sections:
    parts = segments.segment_customers(x.cp, x.rc)
    return [("Sizes", segments.segment_sizes(parts)), ("Value by risk", segments.segment_matrix(parts)), ("Characteristics", segments.segment_characteristics(parts))]


def profiles(x: Inputs) -> Sections:
    compared = segments.compare_segments(x.cp, x.rc)
    return [("Profiles", compared), ("Recommendations", segments.segment_recommendations(compared))]


def data_drift(x: Inputs) -> Sections:
    scored = x.split.select("customer_id", "split").join(x.cp.select("customer_id", "churn_probability"), "customer_id")
    metrics = drift.drift_metrics(x.split, scored)
    return [
        ("Overall", drift.monitoring_report(metrics, F.lit(x.model.model_version))), ("Feature drift", drift.feature_drift(x.split, K.MODEL_FEATURES)),
        ("Alerts", drift.drift_alerts(metrics)),
    ]


def revenue(x: Inputs) -> Sections:
    return [
        ("Revenue by segment", value.revenue_by_segment(x.cp, x.rc)), ("Revenue at risk", value.revenue_at_risk(x.cp, x.rc)), ("Lifetime value by segment", value.clv_by_segment(x.cp, x.rc)),
        ("Lifetime value at risk", value.clv_at_risk(x.cp, x.rc)), ("Campaign return by tier", value.roi_by_tier(x.cp, x.rc)), ("Highest lifetime values", value.top_clv(x.cp, x.rc)),
    ]


def cohort(x: Inputs) -> Sections:
    table = cohorts.cohort_table(x.rc, x.now)
    return [("Best cohort", cohorts.best_cohort(table)), ("Worst cohort", cohorts.worst_cohort(table)), ("Retention by contract", cohorts.retention_pivot(x.rc, x.now)), ("Cohorts", table)]


def risk(x: Inputs) -> Sections:
    return [("Risk segments", summaries.risk_segments(x.cp, x.rc)), ("Risk distribution", summaries.risk_distribution(x.cp))]


REPORTS = {
    "drivers": ("Churn drivers", drivers), "trend": ("Churn trend", trend), "segmentation": ("Customer segmentation", segmentation), "profiles": ("Segment profiles", profiles),
    "drift": ("Data drift", data_drift), "revenue": ("Revenue analysis", revenue), "cohort": ("Cohort analysis", cohort), "risk": ("Risk overview", risk),
}


def lines(name: str, x: Inputs) -> DataFrame:
    """The ordered lines of one report."""
    title, build = REPORTS[name]
    return files.section_lines(title, build(x))


def write_all(store: TableStore, x: Inputs, run_id: str) -> None:
    for name, (title, build) in REPORTS.items():
        files.write_sections(title, build(x), f"{store.path('reports')}/{name}/run_id={run_id}")
