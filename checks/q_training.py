"""Trained models: what must hold whatever the training did is compared with SQL."""

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.registry import query
from checks.sqltext import rnd
from holdfast import constants as K
from holdfast.functions.rounding import half_up
from holdfast.jobs.model import registry_entry
from holdfast.operators import balancing as B
from holdfast.operators import evaluation as E
from holdfast.operators import explain as X
from holdfast.operators import features as P
from holdfast.operators import quality as Q
from holdfast.operators import registry as G
from holdfast.sources import models
from holdfast.sources.tables import TableStore
from holdfast.operators import modeling as M
from holdfast.operators import scoring as S
from holdfast.operators import trees


def _parts(t):
    return t.split_features.where("split = 'train'").drop("split"), t.split_features.where("split = 'test'").drop("split")


# models fitted in this process at full size: (application, input folder, name)
_FITTED: dict[tuple[str, str, str], object] = {}
_FITS = {
    "logistic": M.fit_logistic, "tree": M.fit_tree, "forest": M.fit_forest, "boosting": M.fit_gbt, "balanced": M.fit_balanced,
    "tuned_forest": M.tune_forest, "tuned_boosting": M.tune_boosting, "challenger": M.random_search,
}


def _model(t, name: str):
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    if key not in _FITTED:
        _FITTED[key] = _FITS[name](_parts(t)[0])
    return _FITTED[key]


FLOOR = 0.6  # plausible for any of the models on any size of the tables


def _checked(t, model):
    """What must hold for a model on the test part, whatever the training did."""
    scored = model.transform(_parts(t)[1]).select("customer_id", "churn_label", "churn_probability")
    auc = E.evaluate(scored).select("auc").scalar()
    row = scored.agg(F.count("*").alias("n_test"), F.sum("churn_label").alias("positives"), F.bool_and(F.col("churn_probability").between(0, 1)).alias("in_range"))
    return row.select(F.lit(model.model_version).alias("model_version"), "*", (auc >= FLOOR).alias("auc_plausible"))


def _expected(version: str, more: str = "") -> str:
    return f"select '{version}' as model_version, count(*) as n_test, count(*) filter (where churn_label=1) as positives, true as in_range, true as auc_plausible{more} from t_test where model_id=1"


_FEATURES = "(values " + ", ".join(f"('{f}')" for f in K.MODEL_FEATURES) + ") f(feature)"


_SCALED = ", ".join(f"{rnd(f'({c}-avg({c}) over ())/stddev_samp({c}) over ()', 6)} as {c}" for c in K.NUMERIC_COLUMNS)


@query("P14_preprocessor", f"select customer_id, {_SCALED}, 15.0::double as active_levels from t_rc")
def _(t):
    path = f"{t.folder}/preprocessor"
    M.fit_preprocessor(t.rc).write().overwrite().save(path)
    out = PipelineModel.load(path).transform(t.rc).select("customer_id", vector_to_array("prepared").alias("v"))
    n = len(K.NUMERIC_COLUMNS)
    active = F.aggregate(F.slice("v", n + 1, 1000), F.lit(0.0), lambda a, x: a + x)
    return out.select("customer_id", *[half_up(F.col("v")[i], 6).alias(c) for i, c in enumerate(K.NUMERIC_COLUMNS)], active.alias("active_levels"))


@query("M02_logistic_regression", _expected("logistic_regression_v1"))
def _(t):
    return _checked(t, _model(t, "logistic"))


@query("M03_decision_tree", _expected("decision_tree_v1"))
def _(t):
    return _checked(t, _model(t, "tree"))


@query("M04_random_forest", _expected("random_forest_v1"))
def _(t):
    return _checked(t, _model(t, "forest"))


def _sound(importances, column: str):
    """Importances lie in [0, 1] and sum to 1."""
    total = importances.agg(F.sum(column)).scalar()
    return F.col(column).between(0, 1) & (F.abs(total - 1) < 1e-9)


@query("M04_forest_importances", f"select feature, true as sound from {_FEATURES}")
def _(t):
    found = M.feature_importances(_model(t, "forest"))
    return found.select("feature", _sound(found, "importance").alias("sound"))


@query("M05_boosting", _expected("boosting_v1"))
def _(t):
    return _checked(t, _model(t, "boosting"))


@query("M05_boosting_balanced", _expected("boosting_balanced_v1"))
def _(t):
    return _checked(t, _model(t, "balanced"))


SEARCH_FLOOR = 0.8  # the derived labels follow the features closely; the worst candidates of the grids reach 0.86


def _grid_sql(grid) -> str:
    """Every combination as (candidate, params), the last parameter varying fastest."""
    tables = ", ".join(f"(values {', '.join(f'({i}, ' + repr(str(v)) + ')' for i, v in enumerate(values))}) {p}(i, v)" for p, values in grid.items())
    params = " || ', ' || ".join(f"'{p}=' || {p}.v" for p in sorted(grid))
    return f"select cast(row_number() over (order by {', '.join(f'{p}.i' for p in grid)}) - 1 as int) as candidate, {params} as params from {tables}"


_SEARCHED = "5 as folds, (select count(*) from t_split where split='train') as n_scored, true as auc_plausible"


def _candidates(model):
    return model.found.select("candidate", "params", "folds", "n_scored", (F.col("mean_auc") >= SEARCH_FLOOR).alias("auc_plausible"))


@query("M06_grid_search", f"select candidate, params, {_SEARCHED} from ({_grid_sql(M.FOREST_GRID)})")
def _(t):
    return _candidates(_model(t, "tuned_forest"))


@query("M06_boosting_grid", f"select candidate, params, {_SEARCHED} from ({_grid_sql(M.BOOSTING_GRID)})")
def _(t):
    return _candidates(_model(t, "tuned_boosting"))


@query("M07_random_search", f"select i::int as candidate, 7 as parameters, {_SEARCHED} from range(50) r(i)")
def _(t):
    found = _candidates(_model(t, "challenger"))
    return found.select("candidate", F.size(F.split("params", ", ")).alias("parameters"), "folds", "n_scored", "auc_plausible")


@query("M08_trained_ensemble", _expected("ensemble_v1", ", true as is_mean"))
def _(t):
    members = [_model(t, n) for n in ("tuned_boosting", "balanced", "tuned_forest")]
    together = M.fit_ensemble(None, *members)
    scored = M.score_with([together, *members], _parts(t)[1]).groupBy("customer_id").agg(
        F.avg(F.when(F.col("model_name") == "ensemble", F.col("churn_probability"))).alias("vote"), F.avg(F.when(F.col("model_name") != "ensemble", F.col("churn_probability"))).alias("mean"))
    return _checked(t, together).withColumn("is_mean", scored.agg(F.max(F.abs(F.col("vote") - F.col("mean"))) < 1e-9).scalar())


@query("M13_cross_validate_model", "select metric, true as in_range from (values ('accuracy'),('auc'),('f1'),('precision'),('recall')) m(metric)")
def _(t):
    return E.summarize_folds(M.cross_validate(t.features, M.fit_tree)).select("metric", (F.col("mean").between(0, 1) & (F.col("std") >= 0)).alias("in_range"))


@query("M16_score_trained", "select customer_id, 'decision_tree_v1' as model_version, timestamp '2024-01-31' as predicted_at, true as in_range, true as segment_fits from t_rc")
def _(t):
    rows = S.score(t.rc, _model(t, "tree"), t.now)
    p = F.col("churn_probability")
    segment = F.when(p >= K.HIGH_THRESHOLD, "High").when(p >= K.MEDIUM_THRESHOLD, "Medium").otherwise("Low")
    return rows.select("customer_id", "model_version", "predicted_at", p.between(0, 1).alias("in_range"), (F.col("risk_segment") == segment).alias("segment_fits"))


@query("M20_model_store", "select count(*) as customers, count(*) as same_scores from t_rc")
def _(t):
    """A stored model comes back through the registry with the same scores."""
    store, model = TableStore(t.spark, t.folder), _model(t, "boosting")
    models.save(store, model)
    scored = model.transform(_parts(t)[1]).select("customer_id", "churn_label", "churn_probability")
    store.write("model_registry", G.deploy(t.reg, registry_entry(model, E.evaluate(scored), t.now)), "2024-01-31")
    again = models.load_active(TableStore(t.spark, t.folder))
    both = model.transform(t.features).select("customer_id", F.col("churn_probability").alias("p")).join(again.transform(t.features), "customer_id")
    return both.agg(F.count("*").alias("customers"), F.count_if(F.col("p") == F.col("churn_probability")).alias("same_scores"))


@query("M23_importance_drift", f"select feature, true as sound_tree, true as sound_forest, true as logistic_positive from {_FEATURES}")
def _(t):
    drift = M.importance_drift([_model(t, "tree"), _model(t, "forest"), _model(t, "logistic")])
    return drift.select("feature", _sound(drift, "decision_tree_v1").alias("sound_tree"), _sound(drift, "random_forest_v1").alias("sound_forest"), (F.col("logistic_regression_v1") >= 0).alias("logistic_positive"))


def _adds_up(t, model, margin):
    """Per customer: number of factors, and whether base value plus contributions give the margin."""
    rows = trees.explain_trees(t.features, model)
    total = rows.groupBy("customer_id").agg(F.count("*").alias("factors"), (F.first("base_value") + F.sum("shap_value")).alias("z"))
    both = total.join(model.transform(t.features).select("customer_id", margin(F.col("churn_probability")).alias("m")), "customer_id")
    return both.select("customer_id", "factors", (F.abs(F.col("z") - F.col("m")) < 1e-6).alias("adds_up"))


@query("X01_explain_trees", "select customer_id, 8::bigint as factors, true as adds_up from t_rc")
def _(t):
    return _adds_up(t, _model(t, "boosting"), lambda p: F.log(p / (1 - p)))


@query("X01_explain_forest", "select customer_id, 8::bigint as factors, true as adds_up from t_rc")
def _(t):
    return _adds_up(t, _model(t, "forest"), lambda p: p)


@query("X08_predict_records_trees", "select customer_id, 'boosting_v1' as model_version, 5 as factors, true as in_order from t_rc")
def _(t):
    rows = X.predict_records(t.rc, _model(t, "boosting"), t.now)
    strengths = F.transform("top_risk_factors", lambda f: -F.abs(f["shap_value"]))
    return rows.select("customer_id", "model_version", F.size("top_risk_factors").alias("factors"), (strengths == F.array_sort(strengths)).alias("in_order"))


def _balanced(t):
    return B.smote(P.with_churn_label(P.engineer(t.rc)), TableStore(t.spark, t.folder), "2024-01-31")


@query("M15_smote", """select churn_label, s.synthetic, case when s.synthetic then max(n) over () - n else n end as n, true as inside
 from (select churn_label, count(*) n from t_pc group by 1) a, (values (false), (true)) s(synthetic) qualify case when s.synthetic then max(n) over () - n else n end > 0""")
def _(t):
    """Rows by class and origin; synthetic ones lie between the extremes of their class."""
    rows = _balanced(t)
    real = rows.where("not synthetic")
    bounds = real.groupBy("churn_label").agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(B.BALANCE_FEATURES) for n, f in (("lo", F.min), ("hi", F.max))])
    inside = F.lit(True)
    for i, c in enumerate(B.BALANCE_FEATURES):
        inside = inside & F.col(c).between(F.col(f"lo_{i}") - 1e-9, F.col(f"hi_{i}") + 1e-9)
    # two classes
    return rows.join(F.broadcast(bounds), "churn_label").groupBy("churn_label", "synthetic").agg(F.count("*").alias("n"), F.bool_and(inside).alias("inside"))


@query("M15_class_balance", """select 'after' as stage, churn_label, max(n) over () as n from (select churn_label, count(*) n from t_pc group by 1) a
 union all select 'before', churn_label, count(*) from t_pc group by 2""")
def _(t):
    after = Q.class_balance(_balanced(t)).withColumn("stage", F.lit("after"))
    return after.unionByName(Q.class_balance(t.pc).withColumn("stage", F.lit("before")))
