"""Classifier metrics over (model..., id, label, score) frames.

Everything is computed from the counts per distinct score, so that a frame is reduced on the map
side before any order is needed, and equal scores get their mid-rank.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.rounding import half_up
from holdfast.plans.ordered import running_totals
from holdfast.plans.strata import stratified_folds

METRICS = ["accuracy", "auc", "f1", "precision", "recall"]
_P, _Y = "churn_probability", "churn_label"


def score_counts(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score."""
    known = scored.where(F.col(_P).isNotNull() & F.col(_Y).isNotNull())
    return known.groupBy(*by, F.col(_P).alias("score")).agg(F.sum(_Y).cast("long").alias("pos"), F.sum(1 - F.col(_Y)).cast("long").alias("neg"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def _confusion(threshold: float | Column, score: str = "score", pos: str = "pos", neg: str = "neg") -> dict[str, Column]:
    hit = F.col(score) >= threshold

    def total(when: Column, c: str) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")

    return {"tn": total(~hit, neg), "fp": total(hit, neg), "fn": total(~hit, pos), "tp": total(hit, pos)}


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2 * tp, 2 * tp + fp + fn)


def evaluate(scored: DataFrame, by: Sequence[str] = (), threshold: float = 0.5, digits: int | None = 6) -> DataFrame:
    """Accuracy, AUC, F1, precision and recall per group in one aggregate over the score counts."""
    spans = running_totals(score_counts(scored, by), "score", ["pos", "neg"], by)
    below = (F.col("neg_upto") - F.col("neg")).cast("double") + F.col("neg") / 2.0
    counts = spans.groupBy(*by).agg(
        *[c.alias(n) for n, c in _confusion(threshold).items()],
        F.sum(F.col("pos") * below).alias("u"), (F.max("pos_total").cast("double") * F.max("neg_total")).alias("pairs"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    found = {
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "auc": F.col("u") / F.nullif(F.col("pairs"), F.lit(0.0)),
        "f1": _f1(tp, fp, fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
    }
    return counts.select(*by, *[(half_up(c, digits) if digits else c).alias(m) for m, c in found.items()])


def confusion(scored: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """tn, fp, fn, tp per group."""
    pos, neg = F.col(_Y).alias("pos"), (1 - F.col(_Y)).alias("neg")
    rows = scored.where(F.col(_P).isNotNull()).select(*by, F.col(_P).alias("score"), pos, neg)
    return rows.groupBy(*by).agg(*[c.alias(n) for n, c in _confusion(threshold).items()])


def _curve(scored: DataFrame, by: Sequence[str], point, end: Mapping[str, float]) -> DataFrame:
    """A curve point per distinct score, and the end point (no threshold) after the highest score.

    `point(tp, fp, pos, neg)` gives the named values when everything from a score up is positive.
    """
    spans = running_totals(score_counts(scored, by), "score", ["pos", "neg"], by)
    tp = F.col("pos_total") - F.col("pos_upto") + F.col("pos")
    fp = F.col("neg_total") - F.col("neg_upto") + F.col("neg")
    values = point(tp, fp, F.col("pos_total"), F.col("neg_total"))
    own = F.struct(F.col("score").alias("threshold"), *[half_up(v, 6).alias(n) for n, v in values.items()])
    last = F.struct(F.lit(None).cast("double").alias("threshold"), *[F.lit(end.get(n)).cast("double").alias(n) for n in values])
    is_highest = (F.col("pos_upto") == F.col("pos_total")) & (F.col("neg_upto") == F.col("neg_total"))
    return spans.select(*by, F.inline(F.when(is_highest, F.array(own, last)).otherwise(F.array(own))))


def roc_curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, and the origin."""
    return _curve(scored, by, lambda tp, fp, pos, neg: {"fpr": _ratio(fp, neg), "tpr": _ratio(tp, pos)}, {"fpr": 0.0, "tpr": 0.0})


def pr_curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, precision, recall, f1) for every distinct score, and the end at recall 0."""

    def point(tp: Column, fp: Column, pos: Column, neg: Column) -> dict[str, Column]:
        return {"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, pos), "f1": _f1(tp, fp, pos - tp)}

    return _curve(scored, by, point, {"precision": 1.0, "recall": 0.0})


def best_f1_threshold(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The score with the highest F1 as a cut-off; the lowest one on ties."""
    points = pr_curve(scored, by).where(F.col("threshold").isNotNull())
    pick = F.min_by(F.struct("threshold", "f1"), F.struct(-F.col("f1"), F.col("threshold"))).alias("_b")
    return points.groupBy(*by).agg(pick).select(*by, F.col("_b.threshold").alias("best_threshold"), F.col("_b.f1").alias("best_f1"))


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float] = tuple(i / 10 for i in range(1, 10))) -> DataFrame:
    """F1 at each threshold, all from one aggregate row; the first best one is flagged."""
    rows = scored.where(F.col(_P).isNotNull()).select(F.col(_P).alias("score"), F.col(_Y).alias("pos"), (1 - F.col(_Y)).alias("neg"))
    entries = []
    for t in thresholds:
        c = _confusion(t)
        entries.append(F.struct(F.lit(t).alias("threshold"), half_up(_f1(c["tp"], c["fp"], c["fn"]), 6).alias("f1")))
    row = rows.agg(F.array(*entries).alias("sweep"))
    best = F.array_min(F.transform("sweep", lambda s: F.struct(-s["f1"], s["threshold"].alias("t"))))
    return row.withColumn("_best", best["t"]).select(F.inline("sweep"), "_best").select("threshold", "f1", (F.col("threshold") == F.col("_best")).alias("is_best"))


def fold_metrics(scored: DataFrame, k: int = 5, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """Metrics per stratified fold of already scored rows."""
    folds = stratified_folds(scored, _Y, "customer_id", k, seed)
    return evaluate(folds, [*by, "fold"])


def summarize_folds(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(metric, mean, population deviation) over the folds."""
    entries = [F.struct(F.lit(m).alias("metric"), half_up(F.avg(m), 6).alias("mean"), half_up(F.stddev_pop(m), 6).alias("std")) for m in METRICS]
    return metrics.groupBy(*by).agg(F.array(*entries).alias("e")).select(*by, F.inline("e"))


def leaderboard(scored: DataFrame, by: Sequence[str] = ("model_name", "model_version")) -> DataFrame:
    return evaluate(scored, by).orderBy(F.desc("auc"), *by)


def compare_versions(metrics: DataFrame, baseline: str, challenger: str, name: str = "model_name", version: str = "model_version") -> DataFrame:
    """Baseline and challenger of each model side by side, with the AUC change."""
    def of(which: str, metric: str) -> Column:
        return F.max(F.when(F.col(version) == which, F.col(metric)))

    shown = ("accuracy", "auc", "f1")
    sides = [of(v, m).alias(f"{tag}_{m}") for v, tag in ((baseline, "baseline"), (challenger, "tuned")) for m in shown]
    both = metrics.groupBy(name).agg(*sides).where(F.col("baseline_auc").isNotNull() & F.col("tuned_auc").isNotNull())
    return both.withColumn("auc_delta", half_up(F.col("tuned_auc") - F.col("baseline_auc"), 6))
