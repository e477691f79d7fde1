"""Searches learn from every row: cells against rows, cuts against a sort, fitted trees against MLlib's own reading of them."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.operators import modeling as M
from holdfast.operators import search as S


def rows_of(n, seed=3):
    """Labelled feature rows; the first feature has hundreds of values and steep ends, the others a few levels."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([np.round(np.exp(rng.normal(3, 1, n)), 1), rng.integers(0, 9, n), rng.integers(1, 4, n), rng.integers(1, 4, n), *np.eye(4)[rng.integers(0, 4, n)].T])
    y = (x[:, 0] / 20 + x[:, 1] * (x[:, 2] > 1) + 2 * x[:, 7] + rng.normal(0, 2, n) > 5).astype(int)
    frame = pd.DataFrame(x, columns=K.MODEL_FEATURES)
    frame.insert(0, "churn_label", y)
    frame.insert(0, "customer_id", [f"C{i:07d}" for i in range(n)])
    return frame


def in_fold(spark, frame, folds):
    from holdfast.plans.strata import stratified_folds

    dealt = stratified_folds(spark.createDataFrame(frame[["customer_id", "churn_label"]]), "churn_label", "customer_id", folds, 42).toPandas()
    return frame[["customer_id"]].merge(dealt, on="customer_id", how="left")["fold"].to_numpy()


def test_all_rows_are_learned_and_scored(spark):
    """More rows than any bound of the search before (50,000): none is left out of its folds."""
    frame = rows_of(52_000)
    train = spark.createDataFrame(frame)
    found = S.search(train, "boosting", [{"maxIter": 2, "maxDepth": 2}], folds=2).collect()
    assert [(r.folds, r.n_scored) for r in found] == [(2, 52_000)]
    cells = S.counted(train, 2)
    assert [int(c.learned.sum()) for c in (*cells.folds, cells.whole)] == [26_000, 26_000, 52_000] and cells.skipped == 0
    for c in (*cells.folds, cells.whole):
        assert max(len(x) for x in c.cuts) == S.BINS - 1 and len(c.codes) == len(np.unique(np.column_stack([c.codes, c.label]), axis=0))


def test_cells_are_what_the_rows_give(spark):
    """Cuts equal those of sorted rows, counts those of separate rows, and so do the scores and the AUC of rounds on all rows."""
    frame = rows_of(700)
    x, y, fold = frame[K.MODEL_FEATURES].to_numpy(float), frame["churn_label"].to_numpy(), in_fold(spark, frame, 3)
    cells, params = S.counted(spark.createDataFrame(frame), 3), {"maxDepth": 3, "stepSize": 0.2, "minInstancesPerNode": 3}
    for f, own in enumerate([*cells.folds, cells.whole]):
        learned = fold != f
        codes = S.binned(x, learned)
        table = pd.DataFrame(np.column_stack([codes, y])).assign(learned=learned, out=~learned).groupby(list(range(9))).sum().reset_index().to_numpy(int)
        assert sorted(map(tuple, table)) == sorted(map(tuple, np.column_stack([own.codes, own.label, own.learned, own.out])))
        if f < 3:
            of_rows = S.prefix_scores("boosting", x, y, learned, [5], params)[5]
            of_cells = S.cell_scores("boosting", own, [5], params)[5]
            assert S.auc(own.label, of_cells, own.out) == pytest.approx(S.auc(y[~learned], of_rows[~learned]), abs=1e-9)
            score = {tuple(c): p for c, p in zip(own.codes, of_cells)}
            assert np.allclose([score[tuple(c)] for c in codes], of_rows)


def test_cuts_do_not_depend_on_the_partitions(spark, monkeypatch):
    from holdfast.plans import ordered

    frame = rows_of(900, seed=8)
    train = spark.createDataFrame(frame)
    one = S.counted(train, 2)
    monkeypatch.setattr(S, "running_totals", lambda *a: ordered.running_totals(*a, rows=60))
    monkeypatch.setattr(S, "HELD", 50)
    many = S.counted(train.repartition(13), 2)
    for a, b in zip((*one.folds, one.whole), (*many.folds, many.whole)):
        assert all((u == v).all() for u, v in zip(a.cuts, b.cuts, strict=True))
        assert (a.codes == b.codes).all() and (a.learned == b.learned).all() and (a.out == b.out).all()


def test_draws_of_cells_are_sums_of_rows():
    cells = S.Cells([], np.zeros((4, 1), int), np.zeros(4, int), np.array([0, 1, 7, 500]), np.zeros(4, int))
    rng = np.random.default_rng(5)
    for kind, params, mean, variance in (("forest", {}, 1, 1), ("boosting", {"subsamplingRate": 0.7}, 0.7, 0.21), ("boosting", {}, 1, 0)):
        drawn = np.array([S._draws(kind, cells, params)(rng) for _ in range(4000)])
        assert np.allclose(drawn.mean(0), mean * cells.learned, rtol=0.05) and np.allclose(drawn.var(0), variance * cells.learned, rtol=0.15)


@pytest.mark.parametrize("kind,params", [("forest", {"numTrees": 12, "maxDepth": 30, "minInstancesPerNode": 2}), ("boosting", {"maxIter": 9, "maxDepth": 4, "stepSize": 0.2, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.7"})])
def test_the_fitted_model_is_the_candidate(spark, monkeypatch, kind, params):
    """The stored trees, read in pieces and run by MLlib, give each row the probability that the learner gives its cell."""
    monkeypatch.setattr(M, "_READ", 5)
    frame = rows_of(800)
    train = spark.createDataFrame(frame)
    model = M.tune("m", kind, [params], train, folds=2)
    whole = S.counted(train, 2).whole
    score = {tuple(c): p for c, p in zip(whole.codes, S.cell_scores(kind, whole, [len(model.classifier.trees)], params)[len(model.classifier.trees)])}
    codes = S.binned(frame[K.MODEL_FEATURES].to_numpy(float), np.ones(len(frame), bool))
    got = model.transform(train).orderBy("customer_id").toPandas()["churn_probability"]
    assert np.abs(got - [score[tuple(c)] for c in codes]).max() < 1e-9
    assert model.classifier.getMaxDepth() == params["maxDepth"] and len(model.classifier.trees) == params[S.LENGTH[kind]]
    assert sum(model.classifier.featureImportances.toArray()) == pytest.approx(1)


def test_boosted_nodes_equal_mllib(spark):
    """With every value a bin of its own and nothing random, MLlib's own fit has the same trees with the same statistics."""
    from pyspark.ml.classification import GBTClassifier

    frame = rows_of(400)
    frame[K.MODEL_FEATURES[0]] = frame[K.MODEL_FEATURES[0]].clip(5, 60) // 5
    train = spark.createDataFrame(frame)
    params = {"maxIter": 4, "maxDepth": 3, "stepSize": 0.3}
    ours = M.tune("m", "boosting", [params], train, folds=2)
    theirs = M._fit("m", GBTClassifier(**M._COLS, seed=42, **params), train)
    got, want = (m.transform(train).orderBy("customer_id").toPandas()["churn_probability"] for m in (ours, theirs))
    assert np.abs(got - want).max() < 1e-6
    assert ours.classifier.totalNumNodes == theirs.classifier.totalNumNodes
    assert np.allclose(ours.classifier.featureImportances.toArray(), theirs.classifier.featureImportances.toArray(), atol=1e-6)


def test_a_tuned_model_is_stored_and_explained(spark, tmp_path):
    from holdfast.operators import trees
    from pyspark.ml import PipelineModel

    train = spark.createDataFrame(rows_of(500))
    for kind, params in (("forest", {"numTrees": 5, "maxDepth": 4}), ("boosting", {"maxIter": 5, "maxDepth": 3})):
        model = M.tune("m", kind, [params], train, folds=2)
        model.pipeline.write().save(f"{tmp_path}/{kind}")
        again = PipelineModel.load(f"{tmp_path}/{kind}").transform(train).select("customer_id", vector_to_array("probability")[1].alias("p"))
        both = model.transform(train).join(again, "customer_id")
        assert both.where("abs(p - churn_probability) > 1e-12").count() == 0
        z = F.log(F.col("p") / (1 - F.col("p"))) if kind == "boosting" else F.col("p")
        sums = trees.explain_trees(train, model).groupBy("customer_id").agg((F.first("base_value") + F.sum("shap_value")).alias("z"))
        assert sums.join(again, "customer_id").where(F.abs(F.col("z") - z) > 1e-6).count() == 0


def test_the_training_rows_are_not_broadcast(tables):
    """Counting labels needs two columns of the customers, which Spark takes for small enough to gather in the driver."""
    plan = tables.split_features.where("split = 'train'").groupBy("churn_label").count()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_a_search_and_its_fit_start_few_jobs(spark):
    """What the driver keeps of jobs does not grow with rounds and levels."""
    context = spark.sparkContext
    train = spark.createDataFrame(rows_of(300))
    context.setJobGroup("few", "")
    try:
        M.tune("m", "boosting", [{"maxIter": 60, "maxDepth": 5}], train, folds=2)
        assert 0 < len(context.statusTracker().getJobIdsForGroup("few")) < 60
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_rows_without_key_label_or_feature(spark):
    """Rows without a key are in no fold but fitted, as before; a null label or feature ends the fit, a search goes by the others."""
    frame = rows_of(300)
    train = spark.createDataFrame(frame)
    no_key = train.withColumn("customer_id", F.when(F.col("customer_id") >= "C0000010", F.col("customer_id")))
    cells = S.counted(no_key, 3)
    assert int(cells.whole.learned.sum()) == 300 and sum(int(c.out.sum()) for c in cells.folds) == 290 and cells.skipped == 0
    assert {int((c.learned + c.out).sum()) for c in cells.folds} == {290}
    for hole in ("churn_label", K.MODEL_FEATURES[0]):
        holes = train.withColumn(hole, F.when(F.col("customer_id") >= "C0000010", F.col(f"`{hole}`")))
        assert S.search(holes, "forest", [{"numTrees": 2, "maxDepth": 2}], folds=3).first().n_scored == 290
        with pytest.raises(ValueError, match="10 rows have a null"):
            M.tune("m", "forest", [{"numTrees": 2, "maxDepth": 2}], holes, folds=3)
    with pytest.raises(ValueError):
        M.tune("m", "forest", [{"numTrees": 2, "maxDepth": 2}], train.limit(0), folds=3)


def test_auc_of_counts():
    rng = np.random.default_rng(6)
    y, p, n = rng.integers(0, 2, 60), rng.integers(0, 9, 60) / 9, rng.integers(0, 5, 60)
    assert S.auc(y, p, n) == pytest.approx(S.auc(np.repeat(y, n), np.repeat(p, n)))
    assert math.isnan(S.auc(y, p, n * y))
