from pyspark.sql import functions as F

from checks.registry import query
from checks.sqltext import rnd
from holdfast.operators import features as P
from holdfast.operators import history as H
from holdfast.plans.asof import asof_join

_PAIR = "t_cp join (select customer_id, prev_probability, prev_segment from t_latest) l using (customer_id)"


@query("W02_latest_history", "select customer_id, prev_probability, prev_segment, archived_at from t_latest")
def _(t):
    return H.latest_history(t.h)


@query("W03_score_drift", f"select customer_id, prev_probability, churn_probability as current_probability, {rnd('churn_probability-prev_probability', 4)} as score_change, prev_segment, risk_segment as current_segment from {_PAIR}")
def _(t):
    return H.score_drift(t.cp, t.h)


for _id, _from, _to in (("W04_medium_to_high", "Medium", "High"), ("W05_high_to_medium", "High", "Medium")):
    @query(_id, f"select customer_id, churn_probability, prev_segment, risk_segment as current_segment from {_PAIR} where prev_segment='{_from}' and risk_segment='{_to}'")
    def _(t, source=_from, target=_to):
        return H.moved(t.cp, t.h, source, target)


@query("J06_current_and_previous", f"select customer_id, churn_probability, risk_segment, prev_probability, prev_segment from {_PAIR}")
def _(t):
    return t.cp.select("customer_id", "churn_probability", "risk_segment").join(H.latest_history(t.h).drop("archived_at"), "customer_id")


ALL = "(select customer_id, churn_probability, risk_segment, predicted_at, 9223372036854775807 as record from t_cp union all select customer_id, churn_probability, risk_segment, predicted_at, id from t_h)"


@query("U03_all_predictions", f"select * from {ALL} a")
def _(t):
    return H.all_predictions(t.cp, t.h)


def window(lo: int, hi: int) -> str:
    return f"""(select customer_id, churn_probability, risk_segment, predicted_at from (select *, row_number() over (partition by customer_id order by predicted_at desc, record desc) rn from {ALL} a
 where predicted_at >= timestamp '2024-01-31' - interval {lo} day and predicted_at < timestamp '2024-01-31' - interval {hi} day) x where rn=1)"""


@query("W08_window_snapshot", f"select * from {window(7, 0)} w")
def _(t):
    return H.window_snapshot(t.cp, t.h, t.now, 7, 0)


TRANS = f"""select a.customer_id, a.churn_probability churn_probability_this_week, a.risk_segment risk_segment_this_week, a.predicted_at predicted_at_this_week,
 b.churn_probability churn_probability_last_week, b.risk_segment risk_segment_last_week, b.predicted_at predicted_at_last_week from {window(7, 0)} a join {window(14, 7)} b on a.customer_id=b.customer_id"""


@query("J07_weekly_transitions", TRANS)
def _(t):
    return H.weekly_transitions(t.cp, t.h, t.now)


_MOVE = "customer_id, risk_segment_last_week, risk_segment_this_week, churn_probability_last_week, churn_probability_this_week"


@query("W09_new_high_risk", f"select {_MOVE} from ({TRANS}) x where risk_segment_this_week='High' and risk_segment_last_week<>'High'")
def _(t):
    return H.new_high_risk(H.weekly_transitions(t.cp, t.h, t.now))


@query("W10_recovered", f"select {_MOVE} from ({TRANS}) x where risk_segment_this_week='Low' and risk_segment_last_week<>'Low'")
def _(t):
    return H.recovered(H.weekly_transitions(t.cp, t.h, t.now))


WOW = f"""select *, {rnd('this_week_avg_probability-last_week_avg_probability', 4)} as avg_probability_delta from
 (select count(*) as this_week_customers, {rnd('avg(churn_probability)', 4)} as this_week_avg_probability, count(*) filter (where risk_segment='High') as this_week_high_risk from {window(7, 0)} a) x,
 (select count(*) as last_week_customers, {rnd('avg(churn_probability)', 4)} as last_week_avg_probability, count(*) filter (where risk_segment='High') as last_week_high_risk from {window(14, 7)} b) y"""


@query("A48_week_over_week", WOW)
def _(t):
    return H.week_over_week(t.cp, t.h, t.now)


_TREND = f"""select risk_segment as segment, count(*) as customer_count, {rnd('avg(churn_probability)', 4)} as avg_churn_probability, {rnd('sum(monthly_charges)', 2)} as revenue_at_risk,
 count(*)-coalesce(max(prev_count),0) as trend_vs_previous from t_cp join (select customer_id, monthly_charges from t_rc) r using (customer_id)
 left join (select prev_segment as risk_segment, count(*) prev_count from t_latest group by 1) p using (risk_segment) group by 1"""


@query("J08_segment_trend", _TREND)
def _(t):
    return H.segment_trend(t.cp, t.rc, t.h)


def _dir(op: str, name: str) -> str:
    return f"select '{name}_scores', risk_segment, customer_id, null, null, null, null, churn_probability, prev_probability, '{name}' from {_PAIR} where churn_probability {op} prev_probability"


@query("A11_prediction_summary", f"""select 'segment_summary' as section, segment, cast(null as varchar) as customer_id, customer_count, avg_churn_probability, revenue_at_risk, trend_vs_previous,
 cast(null as double) as churn_probability, cast(null as double) as prev_probability, cast(null as varchar) as score_direction from ({_TREND}) s
 union all select * from (select 'top_20_highest_risk', risk_segment, customer_id, null::bigint, null::double, null::double, null::bigint, churn_probability, null::double, null::varchar from t_cp order by churn_probability desc, customer_id limit 20) k
 union all {_dir('<', 'improving')} union all {_dir('>', 'worsening')}""")
def _(t):
    return H.prediction_summary(t.cp, t.rc, t.h)


@query("K03_top_20", "select 'top_20_highest_risk' as section, risk_segment as segment, customer_id, churn_probability from t_cp order by churn_probability desc, customer_id limit 20")
def _(t):
    return H.prediction_summary(t.cp, t.rc, t.h).where("section = 'top_20_highest_risk'").select("section", "segment", "customer_id", "churn_probability")


_DEC = "select decile::int as decile, count(*) as customer_count, {0} as min_score, {1} as max_score, {2} as avg_score from (select {4} p, ntile({3}) over (order by {4}) decile from {5}) d group by 1"


def deciles(n, source="t_cp", col="churn_probability"):
    return _DEC.format(rnd("min(p)", 4), rnd("max(p)", 4), rnd("avg(p)", 4), n, col, source)


@query("A12_score_deciles", deciles(10))
def _(t):
    return H.score_deciles(t.cp)


@query("W06_score_ntiles", deciles(7, "t_h"))
def _(t):
    return H.score_deciles(t.h, 7)


@query("A45_daily_scores", f"select predicted_at::date as day, {rnd('avg(churn_probability)', 6)} as avg_probability, count(*) as n from {ALL} a group by 1")
def _(t):
    return H.daily_scores(t.cp, t.h)


_DAILY = "(select * from (select *, archived_at::date d, row_number() over (partition by customer_id, archived_at::date order by archived_at desc, id desc) rn from t_h) x where rn=1) y"


@query("A46_daily_risk_trend", f"select d as date, {rnd('avg(churn_probability)', 6)} as avg_probability, count(*) filter (where risk_segment='High') as high_risk_count from {_DAILY} group by 1")
def _(t):
    return H.daily_risk_trend(t.h)


@query("A47_daily_segment_trend", f"select d as date, risk_segment, count(*) as count from {_DAILY} group by 1,2")
def _(t):
    return H.daily_segment_trend(t.h)


_CUST = "(select customer_id, churn, contract, monthly_charges, risk_segment, prev_segment, case when churn='Yes' then 1.0 else 0.0 end y from t_rc join (select customer_id, risk_segment from t_cp) p using (customer_id) left join (select customer_id, prev_segment from t_latest) l using (customer_id) where contract='Month-to-month') c"


@query("A49_kpi_deltas", f"""select {rnd('avg(y)', 4)} as churn_rate, count(*) filter (where risk_segment='High') as high_risk_count, {rnd("sum(case when risk_segment<>'Low' then monthly_charges else 0 end)", 2)} as revenue_at_risk,
 {rnd("avg(y)-avg(y) filter (where prev_segment is not null)", 4)} as churn_rate_delta, count(*) filter (where risk_segment='High') - count(*) filter (where prev_segment='High') as high_risk_delta,
 {rnd("sum(case when risk_segment<>'Low' then monthly_charges else 0 end) - sum(case when prev_segment<>'Low' then monthly_charges else 0 end)", 2)} as revenue_delta from {_CUST}""")
def _(t):
    customers = t.rc.select("customer_id", "churn", "contract", "monthly_charges").join(t.cp.select("customer_id", "risk_segment"), "customer_id", "left")
    return H.kpi_deltas(P.filter_customers(customers, contract="Month-to-month"), t.h)


_ASOF = "select {cols} from {left} l left join t_h h on h.customer_id = l.customer_id and h.archived_at {op} l.{time} qualify row_number() over (partition by {row} order by h.archived_at desc nulls last, h.churn_probability desc) = 1"


@query("J06_asof_score", _ASOF.format(cols="l.customer_id, l.predicted_at, h.archived_at as before_at, h.churn_probability as before_score", left="t_cp", op="<=", time="predicted_at", row="l.customer_id"))
def _(t):
    """For each current score the last archived one up to its own time."""
    rows = asof_join(t.cp.select("customer_id", "predicted_at"), t.h, ["customer_id"], "predicted_at", "archived_at", ties=["churn_probability"], same_instant=True)
    return rows.select("customer_id", "predicted_at", F.col("asof.archived_at").alias("before_at"), F.col("asof.churn_probability").alias("before_score"))


@query("J06_asof_history", "select customer_id, count(*) as scores, count(before) as with_earlier, " + "round(sum(before), 6) as earlier_sum from (select l.customer_id, l.archived_at, (select arg_max(h.churn_probability, (h.archived_at, h.churn_probability)) from t_h h where h.customer_id = l.customer_id and h.archived_at < l.archived_at) as before from t_h l) x group by 1")
def _(t):
    """For each archived score the one before it, equal instants left out; summed per customer."""
    rows = asof_join(t.h.select("customer_id", "archived_at"), t.h, ["customer_id"], "archived_at", "archived_at", ties=["churn_probability"])
    before = F.col("asof.churn_probability")
    return rows.groupBy("customer_id").agg(F.count("*").alias("scores"), F.count(before).alias("with_earlier"), F.round(F.sum(before), 6).alias("earlier_sum"))
