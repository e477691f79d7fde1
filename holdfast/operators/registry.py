"""Model registry, run tracking, run log and alert log (tables with one row per run, not per customer)."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast import constants as K
from holdfast.functions.rounding import half_up
from holdfast.plans.pick import latest_per_key


def register(registry: DataFrame, entries: DataFrame, active: bool = False) -> DataFrame:
    """Append training runs, with ids after the greatest one."""
    start = F.coalesce(registry.agg(F.max("id")).scalar(), F.lit(0))
    # a batch of training runs: a handful of rows
    place = F.row_number().over(W.orderBy("trained_at", "model_name", "model_version"))
    new = entries.withColumn("id", (start + place).cast("long")).withColumn("is_active", F.lit(active))
    return registry.unionByName(new.select(*registry.columns))


def _activate(registry: DataFrame, wanted: Column) -> DataFrame:
    return registry.withColumn("is_active", F.coalesce(F.col("id") == wanted, F.lit(False)))


def activate_best(registry: DataFrame) -> DataFrame:
    """Exactly one active row: the highest AUC, the lowest id on ties."""
    return _activate(registry, registry.agg(F.min_by("id", F.struct(-F.col("auc_score"), F.col("id")))).scalar())


def deploy(registry: DataFrame, entry: DataFrame) -> DataFrame:
    """Append one run with its measured metrics and make it the active one."""
    return register(registry.withColumn("is_active", F.lit(False)), entry, active=True)


def rollback(registry: DataFrame) -> DataFrame:
    """Activate the most recently trained row other than the active one; an error if there is no other."""
    if registry.limit(2).count() < 2:
        raise ValueError("No previous model to roll back to.")
    current = registry.where("is_active").agg(F.max("id")).scalar()
    others = registry.where(F.col("id") != F.coalesce(current, F.lit(-1)))
    return _activate(registry, others.agg(F.max_by("id", F.struct("trained_at", "id"))).scalar())


def model_performance(registry: DataFrame) -> DataFrame:
    """Registry with AUC rank and a highlight for the active model."""
    # the registry has one row per training run
    rank = F.rank().over(W.orderBy(F.desc("auc_score")))
    return registry.select(
        "model_name", "model_version", *[half_up(F.col(c), 4).alias(c) for c in ("accuracy", "auc_score", "f1_score")], "trained_at", "is_active",
        F.when(F.col("is_active"), F.lit("Best Model")).otherwise(F.lit("")).alias("highlight"), rank.alias("auc_rank"),
    ).orderBy("auc_rank", "model_name")


def best_per_model(registry: DataFrame) -> DataFrame:
    """The row with the best AUC of each model name."""
    return latest_per_key(registry, ["model_name"], ["auc_score", "id"])


def accuracy_delta(registry: DataFrame) -> DataFrame:
    """Accuracy of the active model and its lead over the best of the others (NULL without one)."""
    best = F.max_by("accuracy", F.struct("auc_score", -F.col("id")))
    row = registry.agg(
        F.max_by(F.when(F.col("is_active"), F.col("accuracy")), F.when(F.col("is_active"), F.struct("auc_score", -F.col("id")))).alias("accuracy"),
    ).withColumn("_other", registry.where(~F.col("is_active")).agg(best).scalar())
    return row.select("accuracy", half_up(F.col("accuracy") - F.col("_other"), 6).alias("accuracy_delta"))


def auc_history(registry: DataFrame) -> DataFrame:
    return registry.select("model_name", "model_version", "auc_score", "is_active", "trained_at").orderBy("trained_at")


def model_info(registry: DataFrame) -> DataFrame:
    row = registry.where("is_active").orderBy("id").limit(1)
    return row.select("model_name", F.concat_ws("_", "model_name", "model_version").alias("model_version"), F.lit("Production").alias("stage"), "accuracy", "auc_score", "f1_score", "trained_at")


def model_versions(registry: DataFrame, name: str) -> DataFrame:
    return registry.where(F.col("model_name") == name).select("model_version", "auc_score", "is_active", "trained_at").orderBy("model_version", "trained_at")


# --- gates ---------------------------------------------------------------------


def check_performance(registry: DataFrame, floor: float = K.AUC_FLOOR) -> DataFrame:
    active = registry.where("is_active").orderBy("id").limit(1)
    return active.select("model_name", F.col("id").alias("registry_id"), "auc_score", F.lit(floor).alias("threshold"), (F.col("auc_score") >= floor).alias("performance_ok"))


def validate_scores(metrics: DataFrame, scored: DataFrame, floor: float = K.AUC_FLOOR) -> DataFrame:
    """Gate before deployment: AUC floor, no NaN, no infinity, all scores in range.

    `metrics` is the one-row evaluation of `scored`.
    """
    p = F.col("churn_probability")
    infinite = p.isin(float("inf"), float("-inf"))
    row = scored.agg(
        (F.count_if(F.isnan(p) | p.isNull()) == 0).alias("no_nan_predictions"), (F.count_if(infinite) == 0).alias("no_inf_predictions"),
        (F.count_if(~p.between(0, 1)) == 0).alias("predictions_in_valid_range"),
    ).withColumn("_auc", metrics.select("auc").scalar())
    checks = ["auc_above_minimum", "no_nan_predictions", "no_inf_predictions", "predictions_in_valid_range"]
    row = row.withColumn("auc_above_minimum", F.col("_auc") >= floor)
    passed = F.col(checks[0]) & F.col(checks[1]) & F.col(checks[2]) & F.col(checks[3])
    return row.select(half_up(F.col("_auc"), 4).alias("auc"), *checks, passed.alias("passed"))


def promote_decision(pairs: DataFrame, delta: float = K.PROMOTE_AUC_DELTA) -> DataFrame:
    """Whether each challenger beats its baseline by more than `delta` (metrics rounded to 4 digits)."""
    old, new = half_up(F.col("baseline_auc"), 4), half_up(F.col("tuned_auc"), 4)
    change = half_up(new - old, 4)
    return pairs.select("model_name", old.alias("old_auc"), new.alias("new_auc"), change.alias("auc_delta"), (change > delta).alias("promoted"))


# --- tracked runs ----------------------------------------------------------------


def log_run(run_id: Column, kind: str, values: Mapping[str, Column], source: DataFrame) -> DataFrame:
    """Long rows (run_id, kind, key, value) for each row of `source`."""
    entries = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return source.select(run_id.alias("run_id"), F.inline(entries))


def run_table(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per run with the named metrics as columns, best AUC first."""
    wide = runs.where(F.col("kind") == "metric").groupBy("run_id").pivot("key", metrics).agg(F.max(F.col("value").cast("double")))
    return wide.orderBy(F.desc("auc"), "run_id")


def best_run(runs: DataFrame, metrics: list[str]) -> DataFrame:
    return run_table(runs, metrics).limit(1)


# --- logs ------------------------------------------------------------------------


def record_run(name: str, status: str, rows: Column, seconds: float, details: Column, now: Column, source: DataFrame) -> DataFrame:
    """The row to append to the run log; `source` is a one-row frame for `rows` and `details`."""
    return source.select(
        F.xxhash64(F.lit(name), now).alias("id"), F.lit(name).alias("pipeline_name"), F.lit(status).alias("status"), rows.cast("long").alias("rows_processed"),
        F.lit(float(seconds)).alias("duration_seconds"), details.cast("string").alias("details"), now.alias("run_at"),
    )


def run_history(runs: DataFrame, name: str | None = None, n: int = 20) -> DataFrame:
    """Latest runs, newest first; optionally of one pipeline."""
    rows = runs.where(F.col("pipeline_name") == name) if name else runs
    return rows.orderBy(F.desc("run_at"), F.desc("id")).limit(n)


def notification_history(alerts: DataFrame, n: int = 20) -> DataFrame:
    return alerts.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def top_features(importances: DataFrame, n: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)
