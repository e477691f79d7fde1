from pyspark.sql import functions as F

from checks.registry import query
from checks.sqltext import FEATURES, MODELS, _TRAINED, metrics_sql, rnd
from holdfast import constants as K
from holdfast.operators import evaluation as E
from holdfast.operators import quality as Q
from holdfast.operators import registry as G
from holdfast.operators import scoring as S
from holdfast.operators import value as V
from holdfast.plans.strata import stratified_folds, stratified_split
from holdfast.sources.buckets import BucketTable
from holdfast.sources.tables import TableStore

BY = ["model_name", "model_version"]
_BY = "model_name, model_version"


def _split(t):
    return stratified_split(t.pc.select("customer_id", "churn_label"), "churn_label", "customer_id")


@query("M01_stratified_split", "select customer_id, churn_label, split from t_split")
def _(t):
    return _split(t)


@query("M01_split_balance", "select split, churn_label, count(*) as n from t_split group by 1,2")
def _(t):
    return Q.class_balance(_split(t), by=["split"])


@query("M08_ensemble_scores", f"select customer_id, churn_label, {rnd('avg(churn_probability)', 6)} as churn_probability from t_scored group by 1,2")
def _(t):
    return S.ensemble_scores(t.scored, ["customer_id", "churn_label"])


@query("M09_evaluate", metrics_sql("t_test", _BY))
def _(t):
    return E.evaluate(t.test, BY)


@query("M09_evaluate_current_scores", metrics_sql("(select churn_label, churn_probability from (select customer_id, churn_label from t_pc) p join (select customer_id, churn_probability from t_cp) c using (customer_id))"))
def _(t):
    return E.evaluate(t.pc.select("customer_id", "churn_label").join(t.cp.select("customer_id", "churn_probability"), "customer_id"))


_TAILS = f"""select distinct {_BY}, churn_probability threshold, sum(churn_label) over w tp, sum(1-churn_label) over w fp, sum(churn_label) over (partition by {_BY}) pos, sum(1-churn_label) over (partition by {_BY}) neg
 from t_test window w as (partition by {_BY} order by churn_probability desc range between unbounded preceding and current row)"""


@query("M10_roc_curve", f"select {_BY}, threshold, {rnd('1.0::double*fp/neg', 6)} as fpr, {rnd('1.0::double*tp/pos', 6)} as tpr from ({_TAILS}) t union all select distinct {_BY}, null, 0.0::double, 0.0::double from t_test")
def _(t):
    return E.roc_curve(t.test, BY)


_PR = f"select {_BY}, threshold, {rnd('1.0::double*tp/(tp+fp)', 6)} as precision, {rnd('1.0::double*tp/pos', 6)} as recall, {rnd('2.0::double*tp/(tp+fp+pos)', 6)} as f1 from ({_TAILS}) t"


@query("M10_pr_curve", f"{_PR} union all select distinct {_BY}, null, 1.0::double, 0.0::double, null from t_test")
def _(t):
    return E.pr_curve(t.test, BY)


@query("M10_best_f1_threshold", f"select {_BY}, threshold as best_threshold, f1 as best_f1 from (select *, row_number() over (partition by {_BY} order by f1 desc, threshold) rn from ({_PR}) p) x where rn=1")
def _(t):
    return E.best_f1_threshold(t.test, BY)


@query("M11_confusion", f"""select {_BY}, count(*) filter (where churn_probability<0.5 and churn_label=0) as tn, count(*) filter (where churn_probability>=0.5 and churn_label=0) as fp,
 count(*) filter (where churn_probability<0.5 and churn_label=1) as fn, count(*) filter (where churn_probability>=0.5 and churn_label=1) as tp from t_test group by 1,2""")
def _(t):
    return E.confusion(t.test, BY)


_F1 = "coalesce(2.0::double*count(*) filter (where churn_probability>=th and churn_label=1)/nullif(count(*) filter (where churn_probability>=th)+sum(churn_label),0),0)"


@query("M12_threshold_sweep", f"""select threshold, f1, row_number() over (order by f1 desc, threshold)=1 as is_best from (select th as threshold, {rnd(_F1, 6)} as f1 from t_test, (values (0.1::double),(0.2),(0.3),(0.4),(0.5),(0.6),(0.7),(0.8),(0.9)) v(th)
 where model_id=5 group by 1) s""")
def _(t):
    return E.threshold_sweep(t.test.where("model_id = 5"))


_FOLD = "(select customer_id, churn_label, ((row_number() over (partition by churn_label order by md5(concat(customer_id,'#42')))-1)%5)::int fold from t_pc)"


@query("M13_fold_assignment", f"select customer_id, churn_label, fold from {_FOLD} f")
def _(t):
    return stratified_folds(t.pc.select("customer_id", "churn_label"), "churn_label", "customer_id", 5)


_FOLDED = metrics_sql(f"(select fold, s.churn_label, churn_probability from t_scored s join (select customer_id, fold from {_FOLD} f) g using (customer_id) where model_id=5)", "fold")


@query("M13_fold_metrics", _FOLDED)
def _(t):
    return E.fold_metrics(t.scored.where("model_id = 5"))


@query("M13_cv_summary", " union all ".join(f"select '{m}' as metric, {rnd(f'avg({m})', 6)} as mean, {rnd(f'stddev_pop({m})', 6)} as std from ({_FOLDED}) f" for m in E.METRICS))
def _(t):
    return E.summarize_folds(E.fold_metrics(t.scored.where("model_id = 5")))


@query("M14_leaderboard", metrics_sql("t_test", _BY))
def _(t):
    return E.leaderboard(t.test)


_PAIRS = f"""select model_name, o.accuracy as baseline_accuracy, o.auc as baseline_auc, o.f1 as baseline_f1, n.accuracy as tuned_accuracy, n.auc as tuned_auc, n.f1 as tuned_f1, {rnd('n.auc-o.auc', 6)} as auc_delta
 from (select * from ({metrics_sql('t_test', _BY)}) m where model_version='v1') o join (select * from ({metrics_sql('t_test', _BY)}) m where model_version='v2') n using (model_name)"""


@query("M14_compare_versions", _PAIRS)
def _(t):
    return E.compare_versions(E.evaluate(t.test, BY), "v1", "v2")


_CARD = "t_scored where model_id=5"


@query("M16_score", "select customer_id, monthly_charges, churn_probability, case when churn_probability>=0.7 then 'High' when churn_probability>=0.4 then 'Medium' else 'Low' end as risk_segment, 'full_card_v1' as model_version, timestamp '2024-01-31' as predicted_at from t_scored join (select customer_id, monthly_charges from t_rc) r using (customer_id) where model_id=5")
def _(t):
    return S.score(t.rc, t.card, t.now)


@query("M16_score_custom_threshold", "select customer_id, churn_probability, case when churn_probability>=0.6 then 'High' when churn_probability>=0.3 then 'Medium' else 'Low' end as risk_segment from t_scored where model_id=5")
def _(t):
    return S.score(t.rc, t.card, t.now, high=0.6).select("customer_id", "churn_probability", "risk_segment")


from checks.sqltext import PRIORITY, action_of  # noqa: E402

_NEWROWS = f"""(select *, {action_of('risk_segment', 'retention_priority')} as recommended_action, {rnd('monthly_charges*churn_probability', 2)} as estimated_revenue_at_risk, 0 as days_since_last_score from (select *, {PRIORITY} as retention_priority from (
 select customer_id, churn_probability, case when churn_probability>=0.7 then 'High' when churn_probability>=0.4 then 'Medium' else 'Low' end as risk_segment, 'full_card_v1' as model_version, timestamp '2024-01-31' as predicted_at, monthly_charges
 from t_scored join (select customer_id, monthly_charges from t_rc) r using (customer_id) where model_id=5) a) b)"""
_COLS = "customer_id, churn_probability, risk_segment, model_version, predicted_at, retention_priority, recommended_action, estimated_revenue_at_risk, days_since_last_score"
_HCOLS = "customer_id, churn_probability, risk_segment, model_version, predicted_at, timestamp '2024-01-31' as archived_at"


@query("M17_publish_full", f"select {_COLS} from {_NEWROWS} n")
def _(t):
    return S.publish_scores(S.score(t.rc, t.card, t.now), t.cp, t.now, "full")[0]


@query("M17_publish_full_history", f"select {_HCOLS} from t_cp")
def _(t):
    return S.publish_scores(S.score(t.rc, t.card, t.now), t.cp, t.now, "full")[1].drop("id")


@query("M17_publish_new", f"select {_COLS} from {_NEWROWS} n anti join t_h using (customer_id) union all select {_COLS} from t_cp semi join t_h using (customer_id)")
def _(t):
    from holdfast.operators.joins import unscored_customers
    return S.publish_scores(S.score(unscored_customers(t.rc, t.known_cp), t.card, t.now), t.known_cp, t.now, "new")[0]


_STALE = "predicted_at < timestamp '2024-01-24 00:00:00'"


@query("M18_rescore_stale", f"select {_COLS} from {_NEWROWS} n where customer_id in (select customer_id from t_cp where {_STALE}) union all select {_COLS} from t_cp where not ({_STALE})")
def _(t):
    return S.rescore_stale(t.rc, t.cp, t.card, t.now)[0]


@query("M18_rescore_stale_history", f"select {_HCOLS} from t_cp where {_STALE}")
def _(t):
    return S.rescore_stale(t.rc, t.cp, t.card, t.now)[1].drop("id")


def _upserted(t):
    """A bucketed table of the predictions, with the stale customers' new scores put in."""
    table, store = BucketTable(t.spark, f"{t.folder}/predictions", "customer_id", 16), TableStore(t.spark, t.folder)
    table.replace(t.cp.select(*S.PREDICTION, *S.RETENTION), "load")
    stale = S.stale_customers(t.rc, t.cp, t.now, K.STALE_DAYS)
    S.upsert_scores(table, store, S.score(stale, t.card, t.now), t.now, "rescore")
    return table, store


@query("M18_upsert_scores", f"select {_COLS} from {_NEWROWS} n where customer_id in (select customer_id from t_cp where {_STALE}) union all select {_COLS} from t_cp where not ({_STALE})")
def _(t):
    return _upserted(t)[0].snapshot()


@query("M18_upsert_history", f"select {_HCOLS} from t_cp where {_STALE}")
def _(t):
    return _upserted(t)[1].snapshot("churn_predictions_history").drop("id")


@query("P23_lookup_bucket", f"select {_COLS} from t_cp where customer_id in ('CUST-000000042', 'CUST-000000007')")
def _(t):
    table = BucketTable(t.spark, f"{t.folder}/predictions", "customer_id", 16)
    table.replace(t.cp.select(*S.PREDICTION, *S.RETENTION), "load")
    return table.lookup("CUST-000000042", "CUST-000000007")


_COUNTS = ", ".join(f"('{s.lower()}_risk', (count(*) filter (where churn_probability>={lo} and churn_probability<{hi}))::varchar)" for s, lo, hi in (("High", 0.7, 2), ("Medium", 0.4, 0.7), ("Low", -1, 0.4)))


@query("M19_scoring_summary", f"""select m.metric, m.value from (select unnest([{{'metric':'mode','value':'full'}},{{'metric':'high_threshold','value':'0.7'}},{{'metric':'medium_threshold','value':'0.4'}},{{'metric':'customers_scored','value':count(*)::varchar}},
 {{'metric':'high_risk','value':(count(*) filter (where churn_probability>=0.7))::varchar}},{{'metric':'medium_risk','value':(count(*) filter (where churn_probability>=0.4 and churn_probability<0.7))::varchar}},{{'metric':'low_risk','value':(count(*) filter (where churn_probability<0.4))::varchar}}]) m from {_CARD}) x""")
def _(t):
    return S.scoring_summary(S.score(t.rc, t.card, t.now))


@query("M19_top_10", f"select customer_id, churn_probability from {_CARD} order by churn_probability desc, customer_id limit 10")
def _(t):
    return V.top_risk(S.score(t.rc, t.card, t.now), 10).select("customer_id", "churn_probability")


_REG = "id, model_name, model_version, accuracy, auc_score, f1_score, trained_at"


def _entry(t):
    """Metrics of the ensemble as a registry entry."""
    ens = S.ensemble_scores(t.test, ["customer_id", "churn_label"])
    return E.evaluate(ens).select(F.lit("ensemble").alias("model_name"), F.lit("v1").alias("model_version"), "accuracy", F.col("auc").alias("auc_score"), F.col("f1").alias("f1_score"), t.now.alias("trained_at"))


_ENSEMBLE = f"(select customer_id, churn_label, {rnd('avg(churn_probability)', 6)} churn_probability from t_test group by 1,2)"
_ENS = f"(select 7::bigint as id, 'ensemble' as model_name, 'v1' as model_version, accuracy, auc as auc_score, f1 as f1_score, timestamp '2024-01-31' as trained_at from ({metrics_sql(_ENSEMBLE)}) m)"


@query("M20_register", f"select {_REG}, is_active from t_reg union all select {_REG}, false from {_ENS} e")
def _(t):
    return G.register(t.reg, _entry(t))


@query("M20_activate_best", f"select {_REG}, row_number() over (order by auc_score desc, id)=1 as is_active from (select {_REG} from t_reg union all select {_REG} from {_ENS} e) x")
def _(t):
    return G.activate_best(G.register(t.reg, _entry(t)))


@query("M20_deploy", f"select {_REG}, id=7 as is_active from (select {_REG} from t_reg union all select {_REG} from {_ENS} e) x")
def _(t):
    return G.deploy(t.reg, _entry(t))


@query("M20_rollback", f"select {_REG}, id=(select arg_max(id, trained_at) from t_reg where not is_active) as is_active from t_reg")
def _(t):
    return G.rollback(t.reg)


@query("W01_model_performance", f"select model_name, model_version, {rnd('accuracy', 4)} as accuracy, {rnd('auc_score', 4)} as auc_score, {rnd('f1_score', 4)} as f1_score, trained_at, is_active, case when is_active then 'Best Model' else '' end as highlight, (rank() over (order by auc_score desc))::int as auc_rank from t_reg")
def _(t):
    return G.model_performance(t.reg)


@query("W11_best_per_model", f"select {_REG}, is_active from (select *, row_number() over (partition by model_name order by auc_score desc, id desc) rn from t_reg) x where rn=1")
def _(t):
    return G.best_per_model(t.reg)


@query("W11_accuracy_delta", f"select accuracy, {rnd('accuracy-(select accuracy from t_reg where not is_active order by auc_score desc, id limit 1)', 6)} as accuracy_delta from t_reg where is_active")
def _(t):
    return G.accuracy_delta(t.reg)


@query("W12_auc_history", "select model_name, model_version, auc_score, is_active, trained_at from t_reg")
def _(t):
    return G.auc_history(t.reg)


@query("M24_model_info", "select model_name, concat(model_name,'_',model_version) as model_version, 'Production' as stage, accuracy, auc_score, f1_score, trained_at from t_reg where is_active")
def _(t):
    return G.model_info(t.reg)


@query("M24_model_versions", "select model_version, auc_score, is_active, trained_at from t_reg where model_name='full_card'")
def _(t):
    return G.model_versions(t.reg, "full_card")


@query("M21_check_performance", "select model_name, id as registry_id, auc_score, 0.85::double as threshold, auc_score>=0.85 as performance_ok from t_reg where is_active")
def _(t):
    return G.check_performance(t.reg)


_ONE = "(select * from t_test where model_id=5)"


@query("M21_validate_scores", f"select {rnd('auc', 4)} as auc, auc>=0.85 as auc_above_minimum, nn as no_nan_predictions, ni as no_inf_predictions, ir as predictions_in_valid_range, auc>=0.85 and nn and ni and ir as passed from ({metrics_sql(_ONE)}) m, (select bool_and(not isnan(churn_probability)) nn, bool_and(not isinf(churn_probability)) ni, bool_and(churn_probability between 0 and 1) ir from {_ONE} o) c")
def _(t):
    one = t.test.where("model_id = 5")
    return G.validate_scores(E.evaluate(one), one)


@query("M21_promote_decision", f"select model_name, old_auc, new_auc, {rnd('new_auc-old_auc', 4)} as auc_delta, {rnd('new_auc-old_auc', 4)}>0.01 as promoted from (select model_name, {rnd('baseline_auc', 4)} as old_auc, {rnd('tuned_auc', 4)} as new_auc from ({_PAIRS}) p) x")
def _(t):
    return G.promote_decision(E.compare_versions(E.evaluate(t.test, BY), "v1", "v2"))


@query("A08_project_stats", f"""select (select count(*) from t_rc) as total_customers, (select {rnd("100.0*count(*) filter (where churn='Yes')/count(*)", 2)} from t_rc) as churn_rate_pct, (select count(*) from t_cp where risk_segment='High') as high_risk_count,
 model_name as best_model_name, auc_score as best_model_auc, (select count(*) from t_cp) as total_predictions, (select {rnd('sum(monthly_charges)', 2)} from t_cp join (select customer_id, monthly_charges from t_rc) r using (customer_id) where risk_segment<>'Low') as revenue_at_risk,
 trained_at as last_trained_at from t_reg where is_active""")
def _(t):
    from holdfast.operators.summaries import project_stats
    return project_stats(t.rc, t.cp, t.reg)


def _runs(t):
    metrics = E.evaluate(t.test, BY)
    return G.log_run(F.concat_ws("_", *BY), "metric", {m: F.col(m) for m in E.METRICS}, metrics)


_RUNWIDE = f"select concat(model_name,'_',model_version) as run_id, accuracy, auc, f1 from ({metrics_sql('t_test', _BY)}) m"


@query("M22_log_run", " union all ".join(f"select concat(model_name,'_',model_version) as run_id, 'metric' as kind, '{m}' as key, {rnd(f'{m}', 6)} as value from ({metrics_sql('t_test', _BY)}) m" for m in E.METRICS))
def _(t):
    return _runs(t).withColumn("value", F.col("value").cast("double"))


@query("M22_run_table", _RUNWIDE)
def _(t):
    return G.run_table(_runs(t), ["accuracy", "auc", "f1"])


@query("M22_best_run", _RUNWIDE + " order by auc desc, run_id limit 1")
def _(t):
    return G.best_run(_runs(t), ["accuracy", "auc", "f1"])


@query("K07_run_history", "select * from t_runs order by run_at desc, id desc limit 20")
def _(t):
    return G.run_history(t.runs, "daily_pipeline")


@query("K07_notification_history", "select * from t_alerts order by created_at desc, id desc limit 20")
def _(t):
    return G.notification_history(t.alerts)


_FIVE = dict(MODELS[4][3])


@query("K06_top_features", "select feature, importance from (" + " union all ".join(f"""select '{f}' as feature, {rnd(f'abs({_FIVE[f]}::double)*stddev_pop("{f}")', 6)} as importance from t_feat""" for f in FEATURES) + ") i order by importance desc, feature limit 5")
def _(t):
    from holdfast.functions.rounding import half_up
    entries = [F.struct(F.lit(f).alias("feature"), half_up(F.lit(abs(c)) * F.stddev_pop(F.col(f"`{f}`")), 6).alias("importance")) for f, c in t.card.terms()]
    return G.top_features(t.features.agg(F.array(*entries).alias("e")).select(F.inline("e")), 5)
