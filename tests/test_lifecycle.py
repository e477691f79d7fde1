"""Model store and life cycle, reports, monitoring, exact money, explanations of any model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.jobs import daily, model, monitoring, reports
from holdfast.operators import explain, registry, trees, value
from holdfast.operators import modeling as M
from holdfast.plans.neighbours import nearest_points, weighted_points
from holdfast.sources import files, models
from holdfast.sources.tables import TableStore


@pytest.fixture(scope="module")
def fitted(tables):
    train = tables.split_features.where("split = 'train'").drop("split")
    return {"tree": M.fit_tree(train), "gbt": M.fit_gbt(train, rounds=4, depth=3), "logistic": M.fit_logistic(train)}


def scores(m, features):
    return {r.customer_id: r.churn_probability for r in m.transform(features).select("customer_id", "churn_probability").collect()}


def test_models_come_back(spark, tables, fitted, tmp_path):
    store = TableStore(spark, str(tmp_path))
    both = M.Ensemble("ensemble", "v1", (fitted["tree"], fitted["logistic"], tables.card))
    for m in (fitted["tree"], tables.card, both):
        models.save(store, m)
        again = models.load(store, m.name, m.version)
        assert again.model_version == m.model_version
        want, got = scores(m, tables.features), scores(again, tables.features)
        assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-12 for k in want)


def test_no_active_model_is_an_error(spark, tables, tmp_path):
    store = TableStore(spark, str(tmp_path))
    with pytest.raises(models.NoActiveModel):
        models.load_active(store)
    with pytest.raises(models.NoActiveModel):
        daily.daily_job(store, tables.rc, None, tables.now, "2024-01-31", order=["customer_id"])


def test_model_job_then_daily_job(spark, tables, tmp_path):
    """A weak active model is replaced, the new one is stored, and the next job scores with it."""
    store = TableStore(spark, str(tmp_path))
    weakest = registry._activate(tables.reg, tables.reg.agg(F.min_by("id", "auc_score")).scalar()).withColumn("auc_score", F.lit(0.5))
    store.write("model_registry", weakest, "2024-01-30")
    row = model.model_job(store, tables.split_features, M.fit_logistic, tables.now, "2024-01-31", floor=0.55).first()
    assert row.details == "performance_ok=False, retrained=True, deployed=True"
    active = models.load_active(store)
    assert active.name == "logistic_regression" and store.log("model_runs").where("kind = 'metric'").count() == 5
    daily.daily_job(store, tables.rc, None, tables.now, "2024-02-01", order=["customer_id"])
    assert [r[0] for r in store.snapshot("churn_predictions").select("model_version").distinct().collect()] == [active.model_version]
    outcome = model.challenger_job(store, tables.split_features, tables.now, "2024-02-02", train=M.fit_tree).first().details
    assert "challenger=decision_tree_v1" in outcome
    assert store.snapshot("model_registry").where("is_active").count() == 1
    assert store.snapshot("prediction_checks").count() == 4 and store.log("score_snapshots").count() == 1
    assert monitoring.monitoring_job(store, tables.now, "2024-02-03").first().status == "success"
    text = [r.value for r in spark.read.text(store.path("daily_report") + "/run_id=2024-02-01").collect()]
    assert text[0] == "# Daily report" and "## Risk segments" in text and any(x.startswith("| Customers scored |") for x in text)


@pytest.mark.parametrize("name", ["tree", "gbt", "logistic"])
def test_explanations_of_any_model(tables, fitted, name):
    m, rc = fitted[name], tables.rc.limit(60)
    long = explain.explain(rc, m).toPandas()
    assert (long.groupby("customer_id").size() == 8).all()
    drivers = {r.feature: r.mean_abs_shap for r in explain.top_drivers(rc, m).collect()}
    want = long.assign(a=long.shap_value.abs()).groupby("feature").a.mean()
    assert all(abs(drivers[f] - want[f]) < 2e-6 for f in drivers)
    assert explain.drivers_by_segment(rc, tables.cp, m).groupBy("risk_segment").count().agg(F.max("count")).first()[0] == 5
    records = explain.predict_records(rc, m, tables.now).collect()
    assert all(len(r.top_risk_factors) == 5 and r.model_version == m.model_version for r in records)
    assert explain.explanation_text(rc, m).first().explanation.startswith("The top factors")


def test_attribution_of_a_deep_forest_adds_up(tables):
    m = M.fit_forest(tables.features, trees=5)
    rows = trees.explain_trees(tables.features, m)
    total = rows.groupBy("customer_id").agg((F.first("base_value") + F.sum("shap_value")).alias("z")).join(m.transform(tables.features), "customer_id").toPandas()
    assert np.allclose(total.z, total.churn_probability, atol=1e-9)


def test_money_does_not_depend_on_the_layout(tables):
    def bits(n):
        cp, rc = tables.cp.repartition(n), tables.rc.repartition(n)
        frames = [value.revenue_by_segment(cp, rc), value.clv_by_segment(cp, rc), value.tier_summary(value.retention_targets(cp, rc)).drop("avg_churn_probability")]
        return [sorted(map(tuple, f.collect())) for f in frames]

    assert bits(4) == bits(64)


def test_neighbours_do_not_depend_on_layout_or_cells(spark):
    """A grid is full of ties."""
    grid = spark.range(144).select((F.col("id") % 12).cast("double").alias("a"), F.floor(F.col("id") / 12).cast("double").alias("b"))

    def lists(df, cell_rows):
        return {tuple(r.v): [(p.d2, tuple(p.v)) for p in r.near] for r in nearest_points(weighted_points(df, ["a", "b"]), 2, 3, cell_rows).collect()}

    want = lists(grid, 1000)
    points = list(want)
    for v in points:
        brute = sorted((((v[0] - w[0]) ** 2 + (v[1] - w[1]) ** 2), w) for w in points if w != v)[:3]
        assert want[v] == brute
    assert lists(grid.repartition(7, "b"), 20) == want and lists(grid.orderBy(F.desc("a")), 5) == want


def test_reports(spark, tables, tmp_path):
    x = reports.Inputs(tables.rc, tables.cp, tables.split_features, tables.card, tables.now)
    store = TableStore(spark, str(tmp_path))
    reports.write_all(store, x, "r1")
    for name, (title, build) in reports.REPORTS.items():
        text = [r.value for r in spark.read.text(f"{store.path('reports')}/{name}/run_id=r1").collect()]
        assert text[0] == f"# {title}"
        for section, frame in build(x):
            assert f"## {section}" in text and f"| {' | '.join(frame.columns)} |" in text
    rows = value.revenue_by_segment(tables.cp, tables.rc).collect()
    wanted = ["| " + " | ".join(str(v) for v in r) + " |" for r in rows]
    lines = [r.line for r in files.section_lines("t", [("s", value.revenue_by_segment(tables.cp, tables.rc))]).collect()]
    assert lines[-len(wanted):] == wanted


def test_cross_validation_of_several_models(tables):
    out = M.cross_validate_all(tables.features, {"tree": M.fit_tree, "logistic": M.fit_logistic}, folds=3)
    assert out.groupBy("model_name").count().count() == 2 and out.where("metric = 'auc' and mean > 0.5").count() == 2
