"""Scoring a table, retention columns, publishing scores."""

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.functions import risk as R
from holdfast.functions.rounding import half_up
from holdfast.operators.features import model_features
from holdfast.operators.joins import stale_customers

DIGITS = 6
PREDICTION = ["customer_id", "churn_probability", "risk_segment", "model_version", "predicted_at"]
RETENTION = ["retention_priority", "recommended_action", "estimated_revenue_at_risk", "days_since_last_score"]


@dataclass(frozen=True)
class LinearScorer:
    """Logistic scorecard over the model features: 1 / (1 + exp(-(intercept + sum coef * x)))."""

    name: str
    version: str
    intercept: float
    coefficients: Mapping[str, float]

    @property
    def model_version(self) -> str:
        return f"{self.name}_{self.version}"

    def terms(self) -> list[tuple[str, float]]:
        return [(f, self.coefficients[f]) for f in K.MODEL_FEATURES if f in self.coefficients]

    def logit(self) -> Column:
        z = F.lit(float(self.intercept))
        for feature, coef in self.terms():
            z = z + F.lit(float(coef)) * F.col(f"`{feature}`")
        return z

    def probability(self) -> Column:
        return F.round(1.0 / (1.0 + F.exp(-self.logit())), DIGITS)

    def transform(self, features: DataFrame) -> DataFrame:
        return features.withColumn("churn_probability", self.probability())


def score(rc: DataFrame, model, now: Column, high: float | None = None) -> DataFrame:
    """Score raw customers: a narrow projection from features to probability and segment.

    `model` is a LinearScorer or a fitted wrapper with the same `transform` and `model_version`.
    """
    scored = model.transform(model_features(rc))
    return scored.select(
        "customer_id", "monthly_charges", "churn_probability", R.risk_segment(F.col("churn_probability"), *R.thresholds(high)).alias("risk_segment"),
        F.lit(model.model_version).alias("model_version"), now.alias("predicted_at"),
    )


def score_models(features: DataFrame, models: list[LinearScorer], keep: list[str]) -> DataFrame:
    """Scores of several scorecards in long form, from one pass over the features."""
    entries = [
        F.struct(F.lit(i + 1).alias("model_id"), F.lit(m.name).alias("model_name"), F.lit(m.version).alias("model_version"), m.probability().alias("churn_probability"))
        for i, m in enumerate(models)
    ]
    return features.select(*keep, F.inline(F.array(*entries)))


def ensemble_scores(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Soft vote: the mean probability over the models of each row."""
    return scored.groupBy(*keys).agg(half_up(F.avg("churn_probability"), DIGITS).alias("churn_probability"))


def backfill(scored: DataFrame, now: Column) -> DataFrame:
    """Add the four retention columns; `scored` carries segment, probability, charges, predicted_at."""
    priority = R.retention_priority(F.col("risk_segment"), F.col("monthly_charges"))
    return scored.withColumns({
        "retention_priority": priority,
        "recommended_action": R.recommended_action(F.col("risk_segment"), priority),
        "estimated_revenue_at_risk": R.expected_loss(F.col("monthly_charges"), F.col("churn_probability")),
        "days_since_last_score": R.whole_days(F.col("predicted_at"), now),
    })


def _archive(rows: DataFrame, now: Column) -> DataFrame:
    """History rows for outgoing predictions; ids come from the content, so a rerun repeats them."""
    ident = F.xxhash64("customer_id", "predicted_at", "model_version")
    return rows.select(*PREDICTION, now.alias("archived_at"), ident.alias("id"))


def publish_scores(scored: DataFrame, cp: DataFrame, now: Column, mode: str = "full") -> tuple[DataFrame, DataFrame]:
    """(new predictions, rows to append to the history).

    full: every old row is archived and the table becomes the new scores. new: only old rows that
    are replaced are archived. The result has one row per customer even if an input has several:
    the highest probability among equally recent rows wins.
    """
    if mode not in ("full", "new"):
        raise ValueError(f"Unknown mode: {mode}")
    columns = [*PREDICTION, *RETENTION]
    fresh = backfill(scored, now).select(*columns)
    if mode == "full":
        return one_per_customer(fresh), _archive(cp, now)
    ids = scored.select("customer_id")
    kept = cp.select(*columns).join(ids, "customer_id", "left_anti")
    replaced = cp.join(ids, "customer_id", "left_semi")
    return one_per_customer(kept.unionByName(fresh)), _archive(replaced, now)


def one_per_customer(predictions: DataFrame) -> DataFrame:
    from holdfast.plans.pick import latest_per_key

    return latest_per_key(predictions, ["customer_id"], ["predicted_at", "churn_probability", "model_version"])


def rescore_stale(rc: DataFrame, cp: DataFrame, model, now: Column, days: int = K.STALE_DAYS) -> tuple[DataFrame, DataFrame]:
    """Score customers with an outdated score again; all other rows stay as they are."""
    return publish_scores(score(stale_customers(rc, cp, now, days), model, now), cp, now, "new")


def upsert_scores(table, history, scored: DataFrame, now: Column, run_id: str) -> None:
    """Publish scores into a bucketed table of predictions (`sources/buckets.py`): only the buckets of the scored
    customers are read and written. The rows that go are appended to the history table of the store `history`."""
    fresh = one_per_customer(backfill(scored, now).select(*PREDICTION, *RETENTION))
    gone = table.upsert(fresh, run_id)
    history.write("churn_predictions_history", _archive(gone, now), run_id, "append")


def scoring_summary(scored: DataFrame, mode: str = "full", high: float | None = None) -> DataFrame:
    """(metric, value) rows of a scoring run."""
    hi, mid = R.thresholds(high)
    counts = scored.agg(F.count("*").alias("customers_scored"), *[F.count_if(F.col("risk_segment") == s).alias(f"{s.lower()}_risk") for s in K.SEGMENTS])
    entries = [("mode", F.lit(mode)), ("high_threshold", F.lit(str(hi))), ("medium_threshold", F.lit(str(mid)))]
    entries += [(c, F.col(c).cast("string")) for c in counts.columns]
    return counts.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in entries])))
