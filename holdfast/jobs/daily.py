"""Daily job: new data, ingest, features, rescoring, drift, retraining on need, report, run row."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.jobs.model import promote
from holdfast.jobs.monitoring import monitor_predictions
from holdfast.jobs.runs import recorded
from holdfast.operators import drift, features, history, ingest, scoring, summaries
from holdfast.plans.strata import stratified_split
from holdfast.sources import files, models
from holdfast.sources.tables import TableStore


def labelled_features(rc: DataFrame) -> DataFrame:
    rows = features.with_churn_label(features.model_features(rc))
    return rows.select("customer_id", "churn_label", *[F.col(f"`{f}`") for f in K.MODEL_FEATURES])


def daily_job(store: TableStore, source: DataFrame, model, now: Column, run_id: str, retrain: Callable[[DataFrame], object] | None = None, order: list[str] | None = None) -> DataFrame:
    """One day's run over the tables of `store`; returns the run row. Safe to repeat with the same id.

    Features are rebuilt from the customers before scoring, scores and retention columns are
    published together, and the outgoing scores go to the history. `model` may be None for the active
    model of the registry. `retrain` fits a model on a training frame; it is called when the drift check
    asks for it, and what it fits is saved.
    """
    if model is None:
        model = models.load_active(store, store.snapshot("model_registry", before=run_id))

    def work() -> tuple[int, str]:
        has_before = store.exists("raw_customers")
        if has_before:
            new = ingest.check_for_new_data(source, store.snapshot("raw_customers", before=run_id)).first().new_customers
            ingest.ingest(store, source, run_id, "incremental", order)
        else:
            ingest.ingest(store, source, run_id, "full", order)
            new = store.snapshot("raw_customers").count()
        rc = store.snapshot("raw_customers")
        store.write("processed_customers", features.build_processed(rc), run_id)

        old = store.snapshot("churn_predictions", before=run_id)
        current, archived = scoring.publish_scores(scoring.score(rc, model, now), old, now, "full")
        store.write("churn_predictions_history", archived, run_id, "append")
        store.write("churn_predictions", current, run_id)
        cp, log = store.snapshot("churn_predictions"), store.log("churn_predictions_history")

        split = stratified_split(labelled_features(rc), "churn_label", "customer_id")
        store.write("split_features", split, run_id)
        split = store.snapshot("split_features")
        scored = split.select("customer_id", "split").join(cp.select("customer_id", "churn_probability"), "customer_id")
        store.write("drift_metrics", drift.drift_metrics(split, scored), run_id)
        metrics = store.snapshot("drift_metrics")
        need = drift.retrain_needed(metrics).first()

        trained = "no"
        if need.retrain_needed and retrain is not None:
            challenger = retrain(split.where("split = 'train'").drop("split"))
            trained = promote(store, model, challenger, split.where("split = 'test'").drop("split"), now, run_id)

        moves = history.new_high_risk(history.weekly_transitions(cp, log.drop("run_id"), now))
        report = drift.monitoring_report(metrics, F.lit(model.model_version))
        alerts = reduce(DataFrame.unionByName, [drift.high_risk_alert(moves), drift.model_drift_alert(report)])
        stamped = alerts.select(F.xxhash64("alert_type", now).alias("id"), "*", now.alias("created_at"))
        store.write("alerts", stamped, run_id, "append")
        checks = monitor_predictions(store, cp, now, run_id)
        n = cp.count()
        steps = [("New customers", new), ("Customers scored", n), ("Greatest PSI", need.max_psi), ("Retraining needed", need.retrain_needed), ("Challenger", trained)]
        listed = store.spark.createDataFrame([(s, str(v)) for s, v in steps], "step string, result string")
        sections = [("Steps", listed), ("Risk segments", summaries.risk_segments(cp, rc)), ("Checks", checks.drop("place")), ("Alerts", alerts)]
        files.write_sections("Daily report", sections, f"{store.path('daily_report')}/run_id={run_id}")
        return n, f"new_customers={new}, max_psi={need.max_psi}, retrained={trained}"

    return recorded(store, "daily_pipeline", run_id, now, work)
