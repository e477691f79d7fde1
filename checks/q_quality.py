from pyspark.sql import functions as F

from checks.registry import query
from checks.sqltext import CHURNED, rnd
from holdfast import constants as K
from holdfast import schemas
from holdfast.functions.rounding import half_up
from holdfast.operators import ingest as I
from holdfast.operators import quality as Q
from holdfast.operators import summaries as S
from holdfast.sources import files, tables

COLS = ", ".join(K.REQUIRED_COLUMNS)
_TEXT = [c for c in K.REQUIRED_COLUMNS if c not in ("senior_citizen", "tenure", "monthly_charges", "total_charges")]
CLEAN = ("select load_no, " + ", ".join(f"trim({c}) {c}" for c in _TEXT)
         + ", senior_citizen, tenure, monthly_charges, coalesce(try_cast(trim(total_charges) as double),0.0) total_charges from t_messy")
FIRST = f"select * exclude (rn) from (select *, row_number() over (partition by customer_id order by load_no) rn from ({CLEAN}) c) f where rn=1"
BAD = {
    "invalid_churn": "churn not in ('Yes','No')",
    "non_positive_monthly_charges": "monthly_charges<=0",
    "tenure_out_of_range": "tenure not between 0 and 72",
    "unknown_contract": "contract not in ('Month-to-month','One year','Two year')",
    "unknown_payment_method": "payment_method not in ('Electronic check','Mailed check','Bank transfer (automatic)','Credit card (automatic)')",
}
GOOD = f"select {COLS} from ({FIRST}) g where not ({' or '.join(f'({c})' for c in BAD.values())})"


@query("S01_read_customers_csv", f"select {COLS} from t_rc")
def _(t):
    path = f"{t.folder}/customers"
    files.write_customers_csv(t.rc.select(*K.REQUIRED_COLUMNS), path)
    return Q.clean_raw(files.read_customers_csv(t.spark, path)).select(*K.REQUIRED_COLUMNS)


@query("S02_load_table", "select c_custkey, c_mktsegment from customer")
def _(t):
    return tables.load_table(t.spark, f"{t.sf_dir}/customer.parquet", ["c_custkey", "c_mktsegment"])


@query("S03_require_columns", "select customer_id, tenure, monthly_charges from t_messy")
def _(t):
    return Q.require_columns(t.messy).select("customer_id", "tenure", "monthly_charges")


@query("S04_clean_raw", CLEAN)
def _(t):
    return Q.clean_raw(t.messy)


@query("S05_dedupe_customers", FIRST)
def _(t):
    return Q.dedupe_customers(Q.clean_raw(t.messy), ["load_no"])


@query("S05_duplicate_count", f"select count(*)-count(distinct customer_id) as duplicates from ({CLEAN}) c")
def _(t):
    return Q.duplicate_count(Q.clean_raw(t.messy))


@query("S06_good_rows", GOOD)
def _(t):
    return I.prepare(t.messy, ["load_no"])[0].select(*K.REQUIRED_COLUMNS)


@query("S06_quarantine", "select customer_id, violations from (select customer_id, concat_ws(',', " + ", ".join(f"case when {c} then '{r}' end" for r, c in BAD.items()) + f") violations from ({FIRST}) f) v where violations<>''")
def _(t):
    return I.prepare(t.messy, ["load_no"])[1].select("customer_id", F.array_join("violations", ",").alias("violations"))


@query("S06_rule_counts", " union all ".join(f"select '{r}' as rule, count(*) as rows from ({FIRST}) f where {c} having count(*)>0" for r, c in BAD.items()))
def _(t):
    return I.prepare(t.messy, ["load_no"])[2]


_REQ = {
    "senior_citizen_not_0_or_1": "senior_citizen not in (0,1)", "tenure_out_of_range": "tenure not between 0 and 100",
    "non_positive_monthly_charges": "monthly_charges<=0", "negative_total_charges": "total_charges<0",
    "total_below_monthly_charges": "total_charges<monthly_charges-10",
}


@query("S06_request_rules", " union all ".join(f"select '{r}' as rule, count(*) as rows from ({CLEAN}) f where {c} having count(*)>0" for r, c in _REQ.items()))
def _(t):
    return Q.validate_rows(Q.clean_raw(t.messy), Q.request_rules())[2]


@query("S07_ingest_full", GOOD)
def _(t):
    store = tables.TableStore(t.spark, t.folder)
    I.ingest(store, t.messy, "2024-01-31", "full", ["load_no"])
    return store.snapshot("raw_customers").select(*K.REQUIRED_COLUMNS)


_SEMI = "select * from t_rc semi join t_h using (customer_id)"


@query("S08_new_rows", f"select {COLS} from t_rc anti join t_h using (customer_id)")
def _(t):
    return I.new_rows(t.rc, t.known_rc).select(*K.REQUIRED_COLUMNS)


@query("S08_ingest_incremental", f"select {COLS} from ({_SEMI}) k union all select {COLS} from ({GOOD}) g anti join ({_SEMI}) k using (customer_id)")
def _(t):
    store = tables.TableStore(t.spark, t.folder)
    store.write("raw_customers", t.known_rc, "2024-01-30")
    I.ingest(store, t.messy, "2024-01-31", "incremental", ["load_no"])
    return store.snapshot("raw_customers").select(*K.REQUIRED_COLUMNS)


@query("S09_check_for_new_data", "select count(*) as new_customers, count(*)>0 as has_new_data from t_rc anti join t_h using (customer_id)")
def _(t):
    return I.check_for_new_data(t.rc, t.known_rc)


@query("U04_new_ids", "select customer_id from t_rc anti join t_h using (customer_id)")
def _(t):
    return I.new_rows(t.rc.select("customer_id"), t.known_rc)


@query("S10_verification_report", f"""select 'rows' as section, 'all' as label, cast(count(*) as double) as value from t_rc
union all select 'churn', churn, count(*) from t_rc group by 2
union all select 'churn_pct', churn, {rnd('100.0*count(*)/sum(count(*)) over ()', 1)} from t_rc group by 2
union all select 'gender', gender, count(*) from t_rc group by 2 union all select 'contract', contract, count(*) from t_rc group by 2
union all select 'avg_monthly_charges', churn, {rnd('avg(monthly_charges)', 2)} from t_rc group by 2
union all """ + " union all ".join(f"select 'nulls', '{c}', count(*)-count({c}) from t_rc" for c in K.REQUIRED_COLUMNS))
def _(t):
    return Q.verification_report(t.rc)


@query("S11_missing_summary", " union all ".join(
    f"select '{c}' as column_name, count(*)-count({c}) as null_count, {rnd(f'100.0*(count(*)-count({c}))/count(*)', 2)} as null_pct, "
    + (f"count_if(trim({c})='')" if c not in ("senior_citizen", "tenure", "monthly_charges") else "0") + "::bigint as blank_count from t_holes" for c in K.REQUIRED_COLUMNS))
def _(t):
    return Q.missing_summary(t.holes)


@query("S12_describe_numeric", " union all ".join(
    f"select '{c}' as feature, count({c}) as count, {rnd(f'avg({c})', 4)} as mean, {rnd(f'stddev_samp({c})', 4)} as std, min({c})::double as min, "
    f"{rnd(f'quantile_cont({c}::double,0.25)', 4)} as p25, {rnd(f'quantile_cont({c}::double,0.5)', 4)} as p50, {rnd(f'quantile_cont({c}::double,0.75)', 4)} as p75, max({c})::double as max from t_rc"
    for c in K.NUMERIC_COLUMNS))
def _(t):
    return Q.describe_numeric(t.rc, K.NUMERIC_COLUMNS)


@query("S13_export_predictions", "select customer_id, churn_probability, risk_segment, model_version, date '2024-01-31' as run_date from t_cp")
def _(t):
    path = f"{t.folder}/predictions"
    files.export_predictions(t.cp, path, "2024-01-31")
    schema = "customer_id string, churn_probability double, risk_segment string, model_version string, run_date date"
    return t.spark.read.schema(schema).option("header", True).csv(path)


@query("S14_report_csv", "select risk_segment, count(*) as customer_count from t_cp group by 1")
def _(t):
    path = f"{t.folder}/report"
    files.write_report(S.risk_distribution(t.cp), path)
    return t.spark.read.schema("risk_segment string, customer_count bigint").option("header", True).csv(path)


@query("S14_report_markdown", """select '# Risk' as value union all select '' union all select '| risk_segment | customer_count |' union all select '|---|---|'
union all select concat('| ', risk_segment, ' | ', count(*), ' |') from t_cp group by risk_segment""")
def _(t):
    path = f"{t.folder}/report_md"
    files.write_markdown(S.risk_distribution(t.cp), "Risk", path)
    return t.spark.read.text(path)


@query("S15_ensure_columns", "select customer_id, churn_probability, risk_segment, cast(null as varchar) as retention_priority, cast(null as varchar) as recommended_action, cast(null as double) as estimated_revenue_at_risk, cast(null as int) as days_since_last_score from t_cp")
def _(t):
    return files.ensure_columns(t.cp.select("customer_id", "churn_probability", "risk_segment"), schemas.RETENTION_COLUMNS)


@query("A40_charge_stats_by_churn", f"select churn, {rnd('avg(monthly_charges)', 2)} as mean, {rnd('stddev_samp(monthly_charges)', 2)} as std, min(monthly_charges) as min, max(monthly_charges) as max from t_rc group by 1")
def _(t):
    return Q.charge_stats_by_churn(t.rc)


@query("A50_class_balance", "select churn_label, count(*) as n from t_pc group by 1")
def _(t):
    return Q.class_balance(t.pc)
