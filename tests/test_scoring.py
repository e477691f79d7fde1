"""Publishing, attributions, registry: invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.operators import explain as X
from holdfast.operators import joins as J
from holdfast.operators import modeling as M
from holdfast.operators import registry as G
from holdfast.operators import scoring as S
from holdfast.operators import trees
from holdfast.operators.features import model_features


def test_publish_keeps_one_row_per_customer(tables):
    twice = tables.cp.unionByName(tables.cp.withColumn("churn_probability", F.col("churn_probability") / 2))
    scored = S.score(tables.rc, tables.card, tables.now)
    new, archived = S.publish_scores(scored, twice, tables.now, "full")
    assert new.count() == new.select("customer_id").distinct().count() == tables.rc.count()
    assert archived.count() == twice.count()
    part, gone = S.publish_scores(scored.limit(10), twice, tables.now, "new")
    assert part.count() == tables.rc.count() and gone.count() == 20


def test_only_stale_rows_change(tables):
    old = tables.cp
    ids = [r.customer_id for r in old.orderBy("customer_id").limit(10).collect()]
    aged = old.withColumn("predicted_at", F.when(F.col("customer_id").isin(ids), tables.now - F.expr("interval 10 days")).otherwise(tables.now))
    new, archived = S.rescore_stale(tables.rc, aged, tables.card, tables.now)
    changed = new.where("model_version = 'full_card_v1'").select("customer_id").toPandas().customer_id
    assert sorted(changed) == sorted(ids) and archived.count() == 10
    assert J.stale_customers(tables.rc, aged.unionByName(aged), tables.now).count() == 10


def test_linear_attribution_adds_up(tables):
    rows = X.explain(tables.rc, tables.card)
    total = rows.groupBy("customer_id").agg((F.max("base_value") + F.sum("shap_value")).alias("z"))
    logit = model_features(tables.rc).select("customer_id", tables.card.logit().alias("want"))
    gap = total.join(logit, "customer_id").agg(F.max(F.abs(F.col("z") - F.col("want")))).first()[0]
    assert gap < 2e-5
    assert rows.groupBy("customer_id").count().where(f"count <> {len(K.MODEL_FEATURES)}").count() == 0


@pytest.fixture(scope="module")
def train(tables):
    return tables.features


@pytest.mark.parametrize("fit", [lambda t: M.fit_gbt(t, rounds=3, depth=3), lambda t: M.fit_forest(t, trees=4, depth=3), M.fit_tree], ids=["gbt", "forest", "tree"])
def test_tree_attribution_adds_up(train, fit):
    model = fit(train)
    rows = trees.explain_trees(train, model)
    total = rows.groupBy("customer_id").agg((F.first("base_value") + F.sum("shap_value")).alias("z"))
    p = model.transform(train).select("customer_id", "churn_probability")
    both = total.join(p, "customer_id").toPandas()
    want = np.log(both.churn_probability / (1 - both.churn_probability)) if model.name == "boosting" else both.churn_probability
    assert np.allclose(both.z, want, atol=1e-6)


def test_tree_attribution_brute_force(train):
    """Shapley values of one tree from the conditional expectations themselves."""
    from itertools import combinations
    from math import factorial

    model = M.fit_tree(train, depth=3)
    root = model.classifier._java_obj.rootNode()

    def expect(node, x, known):
        if node.subtreeDepth() == 0:
            s = list(node.impurityStats().stats())
            return s[1] / sum(s)
        f, cut = node.split().featureIndex(), node.split().threshold()
        left, right = node.leftChild(), node.rightChild()
        if f in known:
            return expect(left if x[f] <= cut else right, x, known)
        n, nl = node.impurityStats().count(), left.impurityStats().count()
        return nl / n * expect(left, x, known) + (n - nl) / n * expect(right, x, known)

    sample = train.orderBy("customer_id").limit(5)
    got = trees.explain_trees(sample, model).toPandas()
    d = len(K.MODEL_FEATURES)
    for r in sample.collect():
        x = [float(r[f]) for f in K.MODEL_FEATURES]
        mine = got[got.customer_id == r.customer_id].set_index("feature").shap_value
        for i, f in enumerate(K.MODEL_FEATURES):
            others = [j for j in range(d) if j != i]
            phi = sum(
                factorial(m) * factorial(d - m - 1) / factorial(d) * (expect(root, x, {*s, i}) - expect(root, x, set(s)))
                for m in range(d) for s in combinations(others, m))
            assert mine[f] == pytest.approx(phi, abs=1e-9)


def test_rows_of_one_cell_are_attributed_once(monkeypatch):
    """Across batches, with values on and beyond the thresholds, and with no more than some cells remembered."""
    rng = np.random.default_rng(3)
    cuts = np.sort(rng.normal(size=(5, 2)))
    ends = np.column_stack([np.full(5, -np.inf), cuts, np.full(5, np.inf)])
    low = np.array([[e[i] for e, i in zip(ends, own)] for own in rng.integers(0, 2, (40, 5))])
    high = np.array([[e[i] for e, i in zip(ends, own)] for own in rng.integers(2, 4, (40, 5))])
    leaves = trees.Leaves(low, high, rng.uniform(0.1, 1, (40, 5)), rng.normal(size=40), 0.0)
    x = np.concatenate([rng.normal(size=(500, 5)), np.tile(cuts[:, 0], (3, 1)), np.full((2, 5), np.nan), np.full((1, 5), np.inf)])
    want = np.zeros(x.shape)
    nodes, weights = np.polynomial.legendre.leggauss(3)
    passed = (x[:, None] > low) & (x[:, None] <= high)
    for t, w in zip((nodes + 1) / 2, weights / 2):
        each = t * passed + (1 - t) * leaves.share
        want += (w * each.prod(axis=2, keepdims=True) / each * (passed - leaves.share) * leaves.value[:, None]).sum(axis=1)
    assert np.allclose(leaves.attributions(x), want)
    asked = []
    of_cells = trees.Leaves.of_cells
    monkeypatch.setattr(trees.Leaves, "of_cells", lambda self, cells: asked.append(len(cells)) or of_cells(self, cells))
    batches = [x[:200], x[200:400], x[400:]]
    assert np.allclose(np.concatenate(list(trees.attributed(leaves, iter(batches)))), want)
    assert sum(asked) == len(np.unique(trees.cells_of(x, leaves.cuts()), axis=0)) < 3**5 + 2
    monkeypatch.setattr(trees, "_CELLS", 10)
    assert np.allclose(np.concatenate(list(trees.attributed(leaves, iter(batches)))), want)


def test_training_rows_are_spread(spark, train, monkeypatch):
    """A learner reads its columns only, all rows, in as many parts as there are cores if there are rows for them."""
    one = train.coalesce(1)
    assert M.spread(one.limit(5)).rdd.getNumPartitions() == 1
    monkeypatch.setattr(M, "PART_ROWS", 10)
    rows = M.spread(M.with_balanced_weight(one))
    assert rows.rdd.getNumPartitions() == min(spark.sparkContext.defaultParallelism, -(-one.count() // 10))
    assert rows.columns == [*K.MODEL_FEATURES, M.LABEL, "weight"] and rows.count() == one.count()
    assert sorted(map(tuple, rows.drop("weight").collect())) == sorted(map(tuple, one.select(*rows.columns[:-1]).collect()))


def test_forests_remember_nodes_and_stay_the_same(train):
    mine = M.fit_forest(train, trees=3).classifier
    walked = M._pipeline(M.RandomForestClassifier(**M._COLS, numTrees=3, maxDepth=30, seed=M.SEED)).fit(M.spread(train)).stages[-1]
    tuned = M.tune_forest(train, {"numTrees": [2], "maxDepth": [3], "minInstancesPerNode": [1]}, folds=2).classifier
    assert all(c.getOrDefault("cacheNodeIds") for c in (mine, tuned)) and not walked.getOrDefault("cacheNodeIds")
    assert mine.toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:]


def test_explanation_words(spark):
    df = spark.sql("select array(named_struct('feature','a_b','direction','increases risk')) one, array(named_struct('feature','a','direction','increases risk'), named_struct('feature','b','direction','decreases risk')) two")
    r = df.select(X.factor_sentence(F.col("one")).alias("one"), X.factor_sentence(F.col("two")).alias("two"), X.factor_sentence(F.slice("one", 1, 0)).alias("none")).first()
    assert r.one == "The top factors influencing this prediction are a b (increases risk)."
    assert r.two == "The top factors influencing this prediction are a (increases risk), and b (decreases risk)."
    assert r.none == "No contributing factors were provided."


def test_registry_has_one_active_row(spark, tables):
    reg = tables.reg
    assert reg.where("is_active").count() == 1
    back = G.rollback(reg)
    assert back.where("is_active").count() == 1
    assert back.where("is_active").first().id != reg.where("is_active").first().id
    best = G.activate_best(back).where("is_active").first()
    assert best.auc_score == reg.agg(F.max("auc_score")).first()[0]


def test_trained_models_are_good(tables):
    from holdfast.operators.evaluation import evaluate

    parts = tables.split_features
    train, test = (parts.where(f"split = '{s}'").drop("split") for s in ("train", "test"))
    scores = M.score_with([M.fit_logistic(train), M.fit_tree(train)], test)
    for r in evaluate(scores, ["model_name"]).collect():
        assert 0.6 < r.auc <= 1 and r.accuracy > 0.6


def test_probability_bounds(tables):
    p = S.score(tables.rc, tables.card, tables.now).agg(F.min("churn_probability"), F.max("churn_probability")).first()
    assert 0 <= p[0] <= p[1] <= 1


def test_what_if_without_change_is_neutral(tables):
    same = X.what_if(tables.rc, tables.card, [X.Scenario("nothing")])
    assert same.where("probability_change <> 0").count() == 0
