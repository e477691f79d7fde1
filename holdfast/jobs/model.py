"""Model lifecycle jobs: check the active model, retrain, validate, deploy; challenge the active model."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.jobs.runs import recorded
from holdfast.operators import evaluation, modeling, registry
from holdfast.sources import models
from holdfast.sources.tables import TableStore


def model_job(store: TableStore, split: DataFrame, train: Callable[[DataFrame], object], now: Column, run_id: str, floor: float = K.AUC_FLOOR) -> DataFrame:
    """Retrain when the active model is below the AUC floor; save and deploy with measured metrics if it validates.

    `split` holds the labelled model features with the train/test tag.
    """

    def work() -> tuple[int, str]:
        before = store.snapshot("model_registry", before=run_id)
        state = registry.check_performance(before, floor).first()
        if state is None:
            raise models.NoActiveModel("No active model found in model_registry.")
        if state.performance_ok:
            return 0, "performance_ok=True, retrained=False"
        model = train(split.where("split = 'train'").drop("split"))
        scored = model.transform(split.where("split = 'test'").drop("split")).select("customer_id", "churn_label", "churn_probability")
        metrics = evaluation.evaluate(scored)
        passed = registry.validate_scores(metrics, scored, floor).first().passed
        track(store, model, metrics, run_id)
        if passed:
            models.save(store, model)
            store.write("model_registry", registry.deploy(before, registry_entry(model, metrics, now)), run_id)
        return 0, f"performance_ok=False, retrained=True, deployed={passed}"

    return recorded(store, "model_pipeline", run_id, now, work)


def challenger_job(store: TableStore, split: DataFrame, now: Column, run_id: str, train: Callable[[DataFrame], object] = modeling.random_search) -> DataFrame:
    """Train a challenger (random search unless told otherwise) and promote it over the loaded active model if it is clearly better."""

    def work() -> tuple[int, str]:
        before = store.snapshot("model_registry", before=run_id)
        active = models.load_active(store, before)
        challenger = train(split.where("split = 'train'").drop("split"))
        outcome = promote(store, active, challenger, split.where("split = 'test'").drop("split"), now, run_id)
        return 0, f"active={active.model_version}, challenger={challenger.model_version}, outcome={outcome}"

    return recorded(store, "challenger_pipeline", run_id, now, work)


def promote(store: TableStore, active, challenger, test: DataFrame, now: Column, run_id: str) -> str:
    """Compare on the test part; save and register the challenger, active only if it is clearly better."""
    both = [
        evaluation.evaluate(m.transform(test).select("customer_id", "churn_label", "churn_probability")).select(F.lit("m").alias("model_name"), F.lit(tag).alias("model_version"), "*")
        for m, tag in ((active, "old"), (challenger, "new"))
    ]
    pair = evaluation.compare_versions(both[0].unionByName(both[1]), "old", "new")
    better = registry.promote_decision(pair).first().promoted
    track(store, challenger, both[1], run_id)
    models.save(store, challenger)
    entry = registry_entry(challenger, both[1], now)
    before = store.snapshot("model_registry", before=run_id)
    store.write("model_registry", registry.deploy(before, entry) if better else registry.register(before, entry), run_id)
    return "promoted" if better else "kept"


def registry_entry(model, metrics: DataFrame, now: Column) -> DataFrame:
    """The registry row (without id) of a model with its measured metrics."""
    return metrics.select(
        F.lit(model.name).alias("model_name"), F.lit(model.version).alias("model_version"), "accuracy",
        F.col("auc").alias("auc_score"), F.col("f1").alias("f1_score"), now.alias("trained_at"),
    )


def track(store: TableStore, model, metrics: DataFrame, run_id: str) -> None:
    """Append the parameters and metrics of a training run to `model_runs`."""
    run = F.lit(f"{run_id}/{model.model_version}")
    rows = registry.log_run(run, "metric", {m: F.col(m) for m in evaluation.METRICS}, metrics)
    params = getattr(getattr(model, "classifier", None), "extractParamMap", dict)()
    values = {p.name: F.lit(str(v)) for p, v in params.items()}
    if values:
        rows = rows.unionByName(registry.log_run(run, "param", values, store.spark.range(1)))
    store.write("model_runs", rows, run_id, "append")
