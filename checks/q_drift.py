from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.q_history import TRANS, WOW
from checks.registry import query
from checks.sqltext import FEATURES, SCORECARD, pct, psi_sql, rnd
from holdfast.functions import risk as R
from holdfast.functions.rounding import half_up
from holdfast.operators import drift as D
from holdfast.operators import history as H
from holdfast.operators import joins as J
from holdfast.operators import sketches as Z
from holdfast.sources.tables import TableStore

_STATUS = "case when psi<0.1 then 'Stable' when psi<0.2 then 'Moderate' else 'Significant' end"
_LONG = "(" + " union all ".join(f"""select split, '{f}' as feature, "{f}"::double as value from t_feat join (select customer_id, split from t_split) s using (customer_id)""" for f in FEATURES) + ")"
_SCORES = "(select split, 'churn_probability' as feature, churn_probability as value from t_cp join t_split using (customer_id))"
_RAW = "(select split, 'tenure' as feature, tenure::double as value from t_rc join (select customer_id, split from t_split) s using (customer_id) union all select split, 'monthly_charges', monthly_charges from t_rc join (select customer_id, split from t_split) s using (customer_id))"
_TAGGED = "t_rc join (select customer_id, split from t_split) s using (customer_id)"


def _scored(t):
    return t.cp.select("customer_id", "churn_probability").join(t.split.select("customer_id", "split"), "customer_id")


def _tagged(t):
    return J.tag_split(t.rc, t.split)


@query("J10_tag_split", f"select customer_id, tenure, monthly_charges, churn, split from {_TAGGED}")
def _(t):
    return _tagged(t).select("customer_id", "tenure", "monthly_charges", "churn", "split")


_TWO = "(select 'train' as split, 'churn_probability' as feature, churn_probability as value from t_cp union all select 'test', 'churn_probability', churn_probability from t_h)"


@query("D01_psi", f"select feature, psi, {_STATUS} as status from ({psi_sql(_TWO)}) p")
def _(t):
    return D.psi(t.cp, t.h, "churn_probability")


@query("D02_psi_status", "select day, psi, " + _STATUS + f""" as status from (select archived_at::date as day, {rnd('abs(avg(churn_probability)-(select avg(churn_probability) from t_h))*10', 4)} as psi from t_h group by 1) x""")
def _(t):
    mean = t.h.agg(F.avg("churn_probability")).scalar()
    from holdfast.functions.rounding import half_up
    daily = t.h.groupBy(F.to_date("archived_at").alias("day")).agg(F.avg("churn_probability").alias("m")).withColumn("all", mean)
    psi = half_up(F.abs(F.col("m") - F.col("all")) * 10, 4)
    return daily.select("day", psi.alias("psi"), R.psi_status(psi).alias("status"))


@query("D03_feature_drift", f"select feature, psi, {_STATUS} as status from ({psi_sql(_LONG)}) p")
def _(t):
    return D.feature_drift(t.split_features)


@query("D04_prediction_drift", f"select 'prediction_scores' as metric, psi, {_STATUS} as status, {rnd('e_mean', 4)} as expected_mean, {rnd('a_mean', 4)} as actual_mean from ({psi_sql(_SCORES)}) p")
def _(t):
    return D.prediction_drift(_scored(t))


@query("D05_business_drift", f"select feature, psi, {_STATUS} as status, {rnd('e_mean', 2)} as train_mean, {rnd('a_mean', 2)} as test_mean from ({psi_sql(_RAW)}) p")
def _(t):
    return D.business_drift(_tagged(t))


_RATE = f"(select avg(case when churn='Yes' then 1.0 else 0.0 end) filter (where split='train') e, avg(case when churn='Yes' then 1.0 else 0.0 end) filter (where split='test') a from {_TAGGED}) r"
_MAX = "greatest({},0.0001)"
_E1, _A1, _E2, _A2 = (_MAX.format(x) for x in ("1-e", "1-a", "e", "a"))


@query("D06_churn_rate_drift", f"""select 'churn_rate' as feature, psi, {_STATUS} as status, {rnd('e*100', 2)} as train_churn_rate_pct, {rnd('a*100', 2)} as test_churn_rate_pct, {rnd('(a-e)*100', 2)} as delta_pct_points,
 abs({rnd('(a-e)*100', 2)})>5 as drifted from (select *, {rnd(f'({_A1}-{_E1})*ln({_A1}/{_E1}) + ({_A2}-{_E2})*ln({_A2}/{_E2})', 4)} as psi from {_RATE}) x""")
def _(t):
    return D.churn_rate_drift(_tagged(t))


_METRICS = f"(select 'prediction_scores' as metric, psi from ({psi_sql(_SCORES)}) a union all select feature, psi from ({psi_sql(_LONG)}) b)"


def _metrics(t):
    return D.drift_metrics(t.split_features, _scored(t))


@query("D07_monitoring_report", f"""select 'scorecard_v1' as model_name, prediction_psi, psi as max_psi, {_STATUS} as overall_status from (select max(psi) filter (where metric='prediction_scores') as prediction_psi, max(psi) as psi from {_METRICS} m) x""")
def _(t):
    return D.monitoring_report(_metrics(t), F.lit("scorecard_v1"))


_DRIFTED = f"(select 'prediction_scores' as metric, psi from ({psi_sql(_TWO)}) p)"


@query("D07_drift_alerts", f"""select metric, psi, concat('Prediction score drift PSI=', printf('%.4f', psi), ' exceeds threshold 0.2 — model outputs on current data no longer resemble training data.') as message from {_DRIFTED} d where psi>0.2""")
def _(t):
    metrics = D.psi(t.cp, t.h, "churn_probability").select(F.lit("prediction_scores").alias("metric"), "psi")
    return D.drift_alerts(metrics)


@query("M21_retrain_needed", f"select psi>0.2 as retrain_needed, psi as max_psi, 0.2::double as threshold, prediction_psi, {_STATUS} as overall_status from (select max(psi) filter (where metric='prediction_scores') as prediction_psi, max(psi) as psi from {_METRICS} m) x")
def _(t):
    return D.retrain_needed(_metrics(t))


_CHECK = f"select bool_and(churn_probability is not null and churn_probability between 0 and 1) as passed, min(churn_probability) as min, max(churn_probability) as max, {rnd('avg(churn_probability)', 6)} as mean, {rnd('stddev_samp(churn_probability)', 6)} as std, count(*) as n from t_cp"


@query("D08_check_scores", _CHECK)
def _(t):
    return D.check_scores(t.cp)


def _seg(s: str) -> str:
    return f"100.0::double*count(*) filter (where risk_segment='{s}')/count(*)"


_SEGCHECK = f"""select valid_values and realistic_spread as passed, * from (select bool_and(risk_segment in ('High','Medium','Low')) as valid_values, count(distinct risk_segment)=3 and {' and '.join(f'{_seg(s)} between 1 and 95' for s in ('High', 'Medium', 'Low'))} as realistic_spread,
 {rnd(_seg('High'), 2)} as high_pct, {rnd(_seg('Medium'), 2)} as medium_pct, {rnd(_seg('Low'), 2)} as low_pct from t_cp) x"""


@query("D09_check_segments", _SEGCHECK)
def _(t):
    return D.check_segments(t.cp)


_PROBES = [0.1, 0.25, 0.4, 0.5, 0.7, 0.9]

_SNAP = f"""select p is not null as has_previous_snapshot, {rnd('p', 6)} as previous_mean, {rnd('c', 6)} as current_mean, {rnd('coalesce(abs(c-p),0)', 6)} as drift, coalesce(abs(c-p)>0.1,false) as alert
 from (select avg(churn_probability) c, (select arg_max(mean_score, snapshot_at) from t_snaps where snapshot_at<timestamp '2024-01-31') p from t_cp) x"""


@query("D10_score_snapshot_drift", _SNAP)
def _(t):
    return D.score_snapshot_drift(t.cp, t.snaps, t.now)


@query("D10_take_snapshot", f"select {rnd('avg(churn_probability)', 6)} as mean_score, timestamp '2024-01-31' as snapshot_at from t_cp")
def _(t):
    from holdfast.functions.rounding import half_up
    return D.take_snapshot(t.cp, t.now).withColumn("mean_score", half_up(F.col("mean_score"), 6))


def _sketched(t):
    """A store with one sketch of the archived scores per day, and one of today's."""
    store = TableStore(t.spark, t.folder)
    Z.record(store, t.h.withColumn("day", F.to_date("archived_at")), ["churn_probability"], "history")
    Z.record(store, t.cp.withColumn("day", F.to_date(t.now)), ["churn_probability"], "today")
    return store


@query("D10_sketch_shares", " union all ".join(f"select {p}::double as below, {rnd(f'1.0::double*count(*) filter (where churn_probability<{p})/count(*)', 6)} as share, true as within_bound from t_h where archived_at<timestamp '2024-01-31'" for p in _PROBES))
def _(t):
    """Shares below fixed scores over all stored days, read from merged sketches, against the exact ones."""
    merged = Z.merge(Z.stored(_sketched(t), "1970-01-01", "2024-01-30")).withColumn("q", Z.grid(F.col("sketch")))
    found = merged.select(F.explode(F.array(*[F.struct(F.lit(p).alias("below"), Z.share_below(F.col("q"), F.lit(p)).alias("sketched")) for p in _PROBES])).alias("x")).select("x.*")
    scores = t.h.where(F.col("archived_at") < t.now)
    exact = scores.agg(*[(F.count_if(F.col("churn_probability") < p) / F.count("*")).alias(f"p{i}") for i, p in enumerate(_PROBES)])
    exact = exact.select(F.inline(F.array(*[F.struct(F.lit(p).alias("below"), F.col(f"p{i}").alias("share")) for i, p in enumerate(_PROBES)])))
    return found.join(exact, "below").select("below", half_up(F.col("share"), 6).alias("share"), (F.abs(F.col("sketched") - F.col("share")) <= Z.rank_error()).alias("within_bound"))


@query("D10_distribution_drift", f"""select 'churn_probability' as feature, (select count(*) from t_h where archived_at<timestamp '2024-01-31') as n_expected, count(*) as n_actual,
 {rnd("avg(churn_probability)-(select avg(churn_probability) from t_h where archived_at<timestamp '2024-01-31')", 6)} as mean_shift, true as psi_close, true as shift_in_range from t_cp""")
def _(t):
    """Today's scores against the stored baseline; the exact PSI of the same rows is near."""
    store = _sketched(t)
    found = Z.distribution_drift(Z.stored(store, "1970-01-01", "2024-01-30"), Z.stored(store, "2024-01-31", "2024-01-31"))
    exact = D.psi(t.h.where(F.col("archived_at") < t.now), t.cp, "churn_probability").select("psi").scalar()
    close = F.abs(F.col("psi") - exact) <= 0.02 + 0.1 * exact
    return found.select("feature", "n_expected", "n_actual", half_up(F.col("mean_shift"), 6).alias("mean_shift"), close.alias("psi_close"), F.col("greatest_shift").between(0, 1).alias("shift_in_range"))


def _f4(c: str) -> str:
    return f"printf('%.4f', {rnd(c, 4)})"


@query("D12_prediction_report", f"""select 1 as place, 'Score Distribution' as "check", case when passed then 'PASS' else 'FAIL' end as status, concat('n=', n, '  min=', {_f4('min')}, '  max=', {_f4('max')}, '  mean=', {_f4('mean')}, '  std=', {_f4('std')}) as detail from ({_CHECK}) c
 union all select 2, 'Segment Distribution', case when passed then 'PASS' else 'FAIL' end, concat('High: ', printf('%.2f', high_pct), '%, Medium: ', printf('%.2f', medium_pct), '%, Low: ', printf('%.2f', low_pct), '%') from ({_SEGCHECK}) s
 union all select 3, 'Score Drift', case when alert then 'ALERT' else 'OK' end, concat('previous mean: ', {_f4('previous_mean')}, '  current mean: ', {_f4('current_mean')}, '  drift: ', {_f4('drift')}) from ({_SNAP}) d
 union all select 4, 'Overall', case when c.passed and s.passed then 'PASS' else 'FAIL' end, case when c.passed and s.passed then 'ALL CHECKS PASSED' else 'SOME CHECKS FAILED' end from ({_CHECK}) c, ({_SEGCHECK}) s""")
def _(t):
    return D.prediction_report(t.cp, t.snaps, t.now)


_NEW = f"(select customer_id from ({TRANS}) x where risk_segment_this_week='High' and risk_segment_last_week<>'High') n"


@query("D11_build_alerts", f"""select 'high_risk' as alert_type, case when count(*)>0 then 'warning' else 'info' end as severity, case when count(*)=0 then 'No new high-risk customers to alert on.' else
 concat(count(*), ' customer(s) newly flagged High risk: ', array_to_string((array_agg(customer_id order by customer_id))[1:10], ', '), case when count(*)>10 then concat(', and ', count(*)-10, ' more') else '' end) end as message from {_NEW}
 union all select 'model_drift', case when max(psi)>0.2 then 'critical' else 'info' end, concat('Model drift PSI=', printf('%.4f', max(psi)), ' (threshold=0.2) — ', case when max(psi)>0.2 then 'significant drift detected.' else 'within threshold.' end) from {_DRIFTED} d
 union all select 'pipeline_failure', 'critical', concat('Pipeline failure: ', details) from t_runs where status='failed'
 union all select 'weekly_digest', 'info', concat('Weekly digest: ', this_week_high_risk, ' high-risk customers (avg probability delta ', printf('%.4f', avg_probability_delta), ')') from ({WOW}) w""")
def _(t):
    report = D.monitoring_report(D.psi(t.cp, t.h, "churn_probability").select(F.lit("prediction_scores").alias("metric"), "psi"), F.lit("scorecard_v1"))
    parts = [D.high_risk_alert(H.new_high_risk(H.weekly_transitions(t.cp, t.h, t.now))), D.model_drift_alert(report), D.failure_alerts(t.runs),
             D.weekly_digest_alert(H.week_over_week(t.cp, t.h, t.now))]
    return reduce(DataFrame.unionByName, parts)
