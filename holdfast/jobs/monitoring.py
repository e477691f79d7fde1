"""Monitoring of published scores: checks, snapshot, report."""

from pyspark.sql import Column, DataFrame

from holdfast.jobs.runs import recorded
from holdfast.operators import drift
from holdfast.sources import files
from holdfast.sources.tables import TableStore


def snapshots(store: TableStore, before: str | None = None) -> DataFrame:
    """Mean scores of earlier runs; no rows before the first."""
    commits = [c.run_id for c in store.commits("score_snapshots")]
    if commits and commits[0] != before:
        return store.snapshot("score_snapshots", before=before)
    return store.spark.createDataFrame([], "mean_score double, snapshot_at timestamp_ntz")


def monitor_predictions(store: TableStore, cp: DataFrame, now: Column, run_id: str) -> DataFrame:
    """Check the scores against the snapshots before this run, keep the report, and take a snapshot."""
    store.write("prediction_checks", drift.prediction_report(cp, snapshots(store, run_id), now), run_id)
    store.write("score_snapshots", drift.take_snapshot(cp, now), run_id, "append")
    return store.snapshot("prediction_checks")


def monitoring_job(store: TableStore, now: Column, run_id: str) -> DataFrame:
    """The checks as a job of its own, with a report."""

    def work() -> tuple[int, str]:
        cp = store.snapshot("churn_predictions")
        checks = monitor_predictions(store, cp, now, run_id)
        files.write_sections("Prediction monitoring", [("Checks", checks.drop("place"))], f"{store.path('monitoring_report')}/run_id={run_id}")
        last = checks.where("check = 'Overall'").first()
        return cp.count(), f"overall={last.status}"

    return recorded(store, "prediction_monitoring", run_id, now, work)
