from pyspark.sql import functions as F

from checks.q_cohorts import _CORR
from checks.q_history import TRANS, WOW
from checks.q_models import _COLS, _NEWROWS
from checks.q_quality import GOOD
from checks.registry import query
from checks.sqltext import CHURNED, TENURE_SQL, pct, rnd
from holdfast import constants as K
from holdfast import schemas
from holdfast.functions.rounding import half_up
from holdfast.jobs import daily, eda, model, weekly
from holdfast.operators import modeling as M
from holdfast.operators import registry as G
from holdfast.sources.tables import TableStore
from holdfast.streaming import jobs as R

_CH = " union all ".join(f"select 'charges_{n}', churn, {e} from t_rc group by churn" for n, e in (
    ("mean", rnd("avg(monthly_charges)", 2)), ("std", rnd("stddev_samp(monthly_charges)", 2)), ("min", "min(monthly_charges)"), ("max", "max(monthly_charges)")))


@query("B01_eda_summary", f"""select 'churn_rate' as section, 'overall' as label, {pct(CHURNED, 'count(*)')} as value from t_rc union all select 'contract', contract, {pct(CHURNED, 'count(*)')} from t_rc group by 2
 union all select 'tenure_group', {TENURE_SQL}, {pct(CHURNED, 'count(*)')} from t_rc where tenure between 0 and 72 group by 2
 union all select * from (select 'top_correlation', feature, {rnd('r', 6)} as rr from ({_CORR}) c where r is not null and not isnan(r) order by abs(rr) desc, feature limit 5) k union all {_CH}""")
def _(t):
    return eda.eda_summary(t.rc)


_W = "customer_id, risk_segment_last_week as before, risk_segment_this_week as after"


@query("B03_weekly_summary", f"""select 'new_high_risk' as list, {_W} from ({TRANS}) x where risk_segment_this_week='High' and risk_segment_last_week<>'High'
 union all select 'recovered', {_W} from ({TRANS}) x where risk_segment_this_week='Low' and risk_segment_last_week<>'Low'""")
def _(t):
    summary = weekly.weekly_summary(t.cp, t.h, t.now)
    parts = [summary[n].select(F.lit(n).alias("list"), "customer_id", F.col("risk_segment_last_week").alias("before"), F.col("risk_segment_this_week").alias("after")) for n in ("new_high_risk", "recovered")]
    return parts[0].unionByName(parts[1])


_N = "(select count(*) from ({}) x where risk_segment_this_week='{}' and risk_segment_last_week<>'{}')"
_NHIGH, _NLOW = _N.format(TRANS, "High", "High"), _N.format(TRANS, "Low", "Low")


@query("B03_weekly_digest", f"""select l.place::int as place, l.line from (select unnest([{{'place':0,'line':concat('Customers scored: ', last_week_customers, ' -> ', this_week_customers)}},
 {{'place':1,'line':concat('Avg churn probability: ', printf('%.4f',last_week_avg_probability), ' -> ', printf('%.4f',this_week_avg_probability), ' (delta ', printf('%.4f',avg_probability_delta), ')')}},
 {{'place':2,'line':concat('High risk customers: ', last_week_high_risk, ' -> ', this_week_high_risk)}}, {{'place':3,'line':concat('New High Risk (', {_NHIGH}, ')')}}, {{'place':4,'line':concat('Recovered to Low Risk (', {_NLOW}, ')')}}]) l from ({WOW}) w) x""")
def _(t):
    return weekly.digest(weekly.weekly_summary(t.cp, t.h, t.now))


def _store(t) -> TableStore:
    return TableStore(t.spark, t.folder)


@query("B02_daily_job", f"""select 'daily_pipeline' as pipeline_name, 'success' as status, count(*) as rows_processed from ({GOOD}) g""")
def _(t):
    store = _store(t)
    run = daily.daily_job(store, t.messy, t.card, t.now, "2024-01-31", order=["load_no"])
    return run.select("pipeline_name", "status", "rows_processed")


@query("B02_daily_job_scores", f"select {_COLS} from {_NEWROWS} n")
def _(t):
    store = _store(t)
    store.write("raw_customers", t.known_rc, "2024-01-30")
    store.write("churn_predictions", t.known_cp, "2024-01-30")
    daily.daily_job(store, t.rc, t.card, t.now, "2024-01-31", retrain=M.fit_tree, order=["customer_id"])
    return store.snapshot("churn_predictions")


@query("B03_weekly_job", f"select 'weekly_pipeline' as pipeline_name, this_week_customers as rows_processed, concat('new_high_risk=', {_NHIGH}, ', recovered=', {_NLOW}) as details from ({WOW}) w")
def _(t):
    store = _store(t)
    store.write("churn_predictions", t.cp, "2024-01-31")
    store.write("churn_predictions_history", t.h, "2024-01-31")
    return weekly.weekly_job(store, t.now, "2024-01-31").select("pipeline_name", "rows_processed", "details")


@query("B04_model_job", """select id, model_name, model_version, false as is_active, null as details from t_reg
 union all select max(id)+1, 'decision_tree', 'v1', true, 'performance_ok=False, retrained=True, deployed=True' from t_reg""")
def _(t):
    """A failing active model is replaced: the registry afterwards, with the run's details at the new row."""
    store = _store(t)
    weakest = G._activate(t.reg, t.reg.agg(F.min_by("id", "auc_score")).scalar())
    failing = weakest.withColumn("auc_score", F.when(F.col("is_active"), 0.0).otherwise(F.col("auc_score")))
    store.write("model_registry", failing, "2024-01-30")
    run = model.model_job(store, t.split_features, M.fit_tree, t.now, "2024-01-31", floor=0.5)
    rows = store.snapshot("model_registry").withColumn("run", run.select("details").scalar())
    return rows.select("id", "model_name", "model_version", "is_active", F.when(F.col("is_active"), F.col("run")).alias("details"))


@query("B05_record_run", "select 'batch_scorer' as pipeline_name, 'success' as status, count(*) as rows_processed, 1.5::double as duration_seconds, concat('high=', count(*) filter (where risk_segment='High')) as details, timestamp '2024-01-31' as run_at from t_cp")
def _(t):
    facts = t.cp.agg(F.count("*").alias("n"), F.count_if(F.col("risk_segment") == "High").alias("high"))
    return G.record_run("batch_scorer", "success", F.col("n"), 1.5, F.concat(F.lit("high="), F.col("high").cast("string")), t.now, facts).drop("id")


@query("R01_stream_ingest", GOOD)
def _(t):
    store, landing = _store(t), f"{t.folder}/landing"
    t.messy.repartition("load_no").write.parquet(landing)
    rows = R.landing_stream(t.spark, landing, t.messy.schema)
    R.stream_ingest(rows, store, f"{t.folder}/checkpoint", ["load_no"]).awaitTermination()
    return store.snapshot("raw_customers").select(*K.REQUIRED_COLUMNS)


@query("R01_stream_then_compact", "select customer_id, tenure, contract, monthly_charges, 6 as parts, 1 as files from t_rc")
def _(t):
    """One micro-batch per landed file; then the parts are gathered and what they were made of is removed."""
    store, landing = _store(t), f"{t.folder}/landing"
    t.rc.repartition(6, "customer_id").write.parquet(landing)
    rows = R.landing_stream(t.spark, landing, t.rc.schema, files_per_batch=1)
    R.stream_ingest(rows, store, f"{t.folder}/checkpoint", ["customer_id"]).awaitTermination()
    parts = store.compact("raw_customers")
    store.expire("raw_customers")
    found = store.snapshot("raw_customers")
    return found.select("customer_id", "tenure", "contract", "monthly_charges", F.lit(parts).alias("parts"), F.lit(len(found.inputFiles())).alias("files"))


@query("R02_stream_score", f"select {_COLS} from {_NEWROWS} n")
def _(t):
    store, landing = _store(t), f"{t.folder}/landing"
    t.rc.repartition(4, "customer_id").write.parquet(landing)
    rows = R.landing_stream(t.spark, landing, t.rc.schema, files_per_batch=2)
    R.stream_score(rows, store, t.card, f"{t.folder}/checkpoint", t.now).awaitTermination()
    return store.snapshot("churn_predictions")


@query("R02_stream_then_daily", f"select {_COLS} from {_NEWROWS} n")
def _(t):
    """Customers arrive in micro-batches, then the daily job runs over the same tables."""
    store, landing = _store(t), f"{t.folder}/landing"
    t.known_rc.repartition(2, "customer_id").write.parquet(landing)
    rows = R.landing_stream(t.spark, landing, t.rc.schema, files_per_batch=1)
    R.stream_ingest(rows, store, f"{t.folder}/checkpoint", ["customer_id"]).awaitTermination()
    daily.daily_job(store, t.rc, t.card, t.now, "2024-01-31", order=["customer_id"])
    return store.snapshot("churn_predictions")


@query("R03_stream_daily", f"""select archived_at::date as day, {rnd('avg(churn_probability)', 6)} as avg_probability, count(*) as n from t_h
 where archived_at::date + interval 1 day <= (select max(archived_at) from t_h) - interval 1 day group by 1""")
def _(t):
    landing, out = f"{t.folder}/landing", f"{t.folder}/daily"
    t.h.write.parquet(landing)
    R.stream_daily(R.landing_stream(t.spark, landing, t.h.schema), out, f"{t.folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(out).withColumn("avg_probability", half_up(F.col("avg_probability"), 6))
