"""The prefix-evaluated search: the learner against a plain one and against MLlib, prefixes against separate fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast import constants as K
from holdfast.operators import modeling as M
from holdfast.operators import search as S


def data(n=300, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, (n, 4)).astype(float)
    return x, (x[:, 0] + x[:, 1] * (x[:, 2] > 4) + rng.normal(0, 3, n) > 6).astype(int)


def plain_tree(x, t, rows, depth, least, gain_needed):
    """Recursive search of every cut between neighbouring values; gives the value of each row."""
    value = np.full(len(x), t[rows].mean())
    best = (1e-12, None)
    if depth:
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(left), len(right)) >= least:
                    gain = t[rows].var() - (len(left) * t[left].var() + len(right) * t[right].var()) / len(rows)
                    if gain > best[0] + 1e-12 and gain >= gain_needed:
                        best = (gain, (f, cut))
    if best[1]:
        f, cut = best[1]
        for side in (x[:, f] <= cut, x[:, f] > cut):
            value[side] = plain_tree(x, t, rows[side[rows]], depth - 1, least, gain_needed)[side]
    return value


@pytest.mark.parametrize("depth,least,gain", [(0, 1, 0), (3, 1, 0), (4, 5, 0), (3, 2, 0.02)])
def test_a_tree_equals_a_plain_one(depth, least, gain):
    x, _ = data()
    t = np.random.default_rng(2).normal(0, 1, len(x)) + x[:, 1]
    learned = np.arange(len(x)) % 4 > 0
    codes = S.binned(x, learned)
    got = S.grow(codes, t, learned.astype(float), depth, least, gain, 4, np.random.default_rng(0))
    want = plain_tree(x, t, np.flatnonzero(learned), depth, least, gain)
    assert np.allclose(got, want)


@pytest.mark.parametrize("kind,params", [("forest", {"maxDepth": 6, "minInstancesPerNode": 2}), ("boosting", {"maxDepth": 3, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.7"})])
def test_prefixes_equal_separate_fits(kind, params):
    x, y = data()
    learned = np.arange(len(x)) % 5 > 0
    together = S.prefix_scores(kind, x, y, learned, [3, 8, 20], params)
    for n in (3, 8, 20):
        assert (S.prefix_scores(kind, x, y, learned, [n], params)[n] == together[n]).all()
    assert S.auc(y[~learned], together[20][~learned]) > 0.7


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_trees_are_grown_on_cells(monkeypatch, kind):
    """Rows of the same bins and label are one row of their weight, with the scores of separate rows."""
    x, y = data(600)
    x = x.clip(2, 6)
    learned, sizes, grow = np.arange(600) % 5 > 0, [], S.grow
    monkeypatch.setattr(S, "grow", lambda codes, *rest: sizes.append(len(codes)) or grow(codes, *rest))
    params = {"maxDepth": 4, "minInstancesPerNode": 2, "subsamplingRate": 0.8}
    got = S.prefix_scores(kind, x[:, 2:], y, learned, [10], params)[10]
    assert set(sizes) == {len(np.unique(np.column_stack([x[:, 2:], y]), axis=0))}
    codes, total = S.binned(x[:, 2:], learned), np.zeros(600)
    for i in range(10):
        rng = np.random.default_rng([42, i])
        if kind == "forest":
            total += grow(codes, y.astype(float), learned * rng.poisson(1.0, 600), 4, 2, 0, 2, rng) / 10
        else:
            target = 2.0 * y - 1 if i == 0 else 4 * (2 * y - 1) / (1 + np.exp(2 * (2 * y - 1) * total))
            total += (0.1 if i else 1) * grow(codes, target, learned * (rng.random(600) < 0.8), 4, 2, 0, 2, rng)
    assert np.allclose(got, total if kind == "forest" else 1 / (1 + np.exp(-2 * total)))


def test_boosting_equals_mllib(spark):
    """With every value a bin of its own and all features tried there is nothing random left."""
    x, y = data()
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(*map(float, r), int(v), i) for i, (r, v) in enumerate(zip(x, y))], [*names, "churn_label", "i"])
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    model = GBTClassifier(featuresCol="v", labelCol="churn_label", maxIter=6, maxDepth=3, stepSize=0.3)
    rows = VectorAssembler(inputCols=names, outputCol="v").transform(df)
    want = model.fit(rows).transform(rows).select("i", vector_to_array("probability")[1].alias("p")).orderBy("i").toPandas()["p"].to_numpy()
    got = S.prefix_scores("boosting", x, y, np.ones(len(x), bool), [6], {"maxDepth": 3, "stepSize": 0.3})[6]
    assert np.abs(got - want).max() < 1e-6


def test_auc():
    rng = np.random.default_rng(4)
    y, p = rng.integers(0, 2, 80), rng.integers(0, 9, 80) / 9
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert S.auc(y, p) == pytest.approx(np.mean(pairs)) and np.isnan(S.auc(np.ones(3, int), p[:3]))


def test_candidates_and_groups():
    assert len(S.grid_candidates(M.FOREST_GRID)) == 36 and len(S.grid_candidates(M.BOOSTING_GRID)) == 108
    assert [len(S.groups_of(k, S.grid_candidates(g))) for k, g in (("forest", M.FOREST_GRID), ("boosting", M.BOOSTING_GRID))] == [12, 36]
    drawn = S.random_candidates(M.BOOSTING_DISTRIBUTIONS, 50)
    assert len({tuple(c.items()) for c in drawn}) == 50 and drawn == S.random_candidates(M.BOOSTING_DISTRIBUTIONS, 50)
    assert len(S.random_candidates({"maxIter": [1, 2]}, 50)) == 2


def test_search_scores_every_row_once(tables):
    train = tables.features
    grid = {"maxIter": [2, 5], "maxDepth": [2, 3]}
    rows = S.search(train, "boosting", S.grid_candidates(grid)).collect()
    assert {(r.candidate, r.folds, r.n_scored) for r in rows} == {(i, 5, train.count()) for i in range(4)}
    model = M.tune_boosting(train, grid)
    best = max(rows, key=lambda r: (r.mean_auc, -r.candidate))
    assert model.classifier.getNumTrees == S.grid_candidates(grid)[best.candidate]["maxIter"]
    assert model.transform(train).where(~F.col("churn_probability").between(0, 1)).count() == 0


def test_sample_is_bounded_and_stratified(tables):
    train = tables.features
    whole, some = S.sample(train, 5), S.sample(train, 3, rows=60)
    assert len(whole.y) == train.count() and len(some.y) <= 62 and set(some.fold) == {0, 1, 2}
    assert some.x.shape[1] == len(K.MODEL_FEATURES) and abs(some.y.mean() - whole.y.mean()) < 0.03
    with_nulls = train.withColumn("churn_label", F.when(F.rand(3) > 0.5, F.col("churn_label")))
    assert len(S.sample(with_nulls, 5).y) == with_nulls.where("churn_label is not null").count()
    assert len(S.sample(train.limit(0), 5).y) == 0
    nothing = S.search(train.limit(0), "forest", [{"numTrees": 2, "maxDepth": 2}]).collect()
    assert [(r.folds, r.n_scored, r.mean_auc) for r in nothing] == [(5, 0, None)]
