from pyspark.sql import functions as F

from checks.registry import query
from checks.sqltext import CONTRACT_RISK, NOW, PAYMENT_RISK, SERVICES, TENURE_MODEL, TENURE_SQL, TIER, action_of, days_between, rnd, segment_of, seg_clv
from holdfast import constants as K
from holdfast.functions import risk as R
from holdfast.functions.rounding import half_up
from holdfast.operators import features as P
from holdfast.operators import scoring as S

_NUM = {c: f"coalesce(try_cast(trim(cast({c} as varchar)) as double), (select quantile_cont(try_cast(trim(cast({c} as varchar)) as double),0.5) from t_holes))" for c in K.NUMERIC_COLUMNS}


@query("P01_clean_data", "select customer_id, churn, senior_citizen, " + ", ".join(f"coalesce(trim({c}),'Unknown') {c}" for c in K.CATEGORICAL_COLUMNS)
       + ", " + ", ".join(f"{rnd(e, 4)} {c}" for c, e in _NUM.items()) + " from t_holes")
def _(t):
    return P.clean_data(t.holes).withColumns({c: half_up(F.col(c), 4) for c in K.NUMERIC_COLUMNS})


@query("P02_tenure_group", f"select customer_id, {TENURE_MODEL} as tenure_group, {TENURE_SQL} as tenure_range from t_rc")
def _(t):
    df = P.with_tenure_group(P.with_tenure_group(t.rc), K.TENURE_LABELS_SQL, "tenure_range")
    return df.select("customer_id", "tenure_group", "tenure_range")


@query("P03_charge_per_month", f"select customer_id, {rnd('total_charges/case when tenure=0 then 1 else tenure end', 6)} as charge_per_month from t_rc")
def _(t):
    return P.with_charge_per_month(t.rc).select("customer_id", half_up(F.col("charge_per_month"), 6).alias("charge_per_month"))


@query("P04_services_count", f"select customer_id, {SERVICES} as services_count from t_rc")
def _(t):
    return P.with_services_count(t.rc).select("customer_id", "services_count")


@query("P05_contract_risk", f"select customer_id, {CONTRACT_RISK} as contract_risk_score from t_rc")
def _(t):
    return P.with_contract_risk(t.rc).select("customer_id", "contract_risk_score")


@query("P06_payment_risk", f"select customer_id, {PAYMENT_RISK} as payment_risk_score from t_rc")
def _(t):
    return P.with_payment_risk(t.rc).select("customer_id", "payment_risk_score")


@query("P07_churn_label", "select customer_id, case when churn='Yes' then 1 else 0 end as churn_label from t_rc")
def _(t):
    return P.with_churn_label(t.rc).select("customer_id", "churn_label")


@query("P08_build_processed", f"select * replace ({rnd('charge_per_month', 6)} as charge_per_month) from t_pc")
def _(t):
    return P.build_processed(t.rc).withColumn("charge_per_month", half_up(F.col("charge_per_month"), 6))


@query("P09_charge_tier", "select customer_id, case when monthly_charges<35 then 'low' when monthly_charges<70 then 'medium' else 'high' end as tier from t_rc")
def _(t):
    return P.with_charge_tier(t.rc, "monthly_charges", "tier").select("customer_id", "tier")


@query("P10_household", """select customer_id, case when partner='Yes' then case when dependents='Yes' then 'Partner+Dependents' else 'Partner Only' end
 when dependents='Yes' then 'Dependents Only' else 'Neither' end as household from t_rc""")
def _(t):
    return P.with_household(t.rc).select("customer_id", "household")


@query("P11_senior_label", "select customer_id, case when senior_citizen=1 then 'Senior' else 'Non-Senior' end as senior_label from t_rc")
def _(t):
    return P.with_senior_label(t.rc).select("customer_id", "senior_label")


_OH = {f"{c}_{v}": f"case when {c}='{v}' then 1 else 0 end" for c, vals in K.CATEGORY_LEVELS.items() for v in vals}


@query("P12_one_hot", "select customer_id, senior_citizen, tenure, monthly_charges, total_charges, churn, " + ", ".join(f'{e} as "{n}"' for n, e in _OH.items()) + " from t_rc")
def _(t):
    return P.one_hot(t.rc)


@query("P12_fit_levels", " union all ".join(f"select distinct '{c}' as feature, {c} as level from t_rc where {c} is not null" for c in K.CATEGORICAL_COLUMNS))
def _(t):
    levels = P.fit_levels(t.rc, K.CATEGORICAL_COLUMNS)
    present = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(v).alias("level")) for c, vs in levels.items() for v in vs])
    return t.spark.range(1).select(F.inline(present))


@query("P13_scale_numerics", "select customer_id, " + ", ".join(rnd(f"({c}-avg({c}) over ())/stddev_pop({c}) over ()", 6) + f" as {c}" for c in K.NUMERIC_COLUMNS) + " from t_rc")
def _(t):
    return P.scale_numerics(t.rc).select("customer_id", *[half_up(F.col(c), 6).alias(c) for c in K.NUMERIC_COLUMNS])


@query("P15_classify_risk", f"select customer_id, {segment_of('churn_probability')} as risk_segment, {segment_of('churn_probability', 0.6, 0.3)} as custom_segment from t_cp")
def _(t):
    p = F.col("churn_probability")
    return t.cp.select("customer_id", R.risk_segment(p).alias("risk_segment"), R.risk_segment(p, *R.thresholds(0.6)).alias("custom_segment"))


@query("P16_retention_tier", f"select customer_id, {TIER} as tier, retention_priority from t_cp join (select customer_id, monthly_charges from t_rc) r using (customer_id)")
def _(t):
    df = t.cp.select("customer_id", "risk_segment").join(t.rc.select("customer_id", "monthly_charges"), "customer_id")
    charges = F.col("monthly_charges")
    return df.select("customer_id", R.retention_tier(charges).alias("tier"), R.retention_priority(F.col("risk_segment"), charges).alias("retention_priority"))


_ACTS = "case risk_segment " + " ".join(f"when '{s}' then '{' | '.join(a)}'" for s, a in K.RETENTION_ACTIONS.items()) + " end"


@query("P17_recommended_action", f"select customer_id, {action_of('risk_segment', 'retention_priority')} as recommended_action, {_ACTS} as actions from t_cp")
def _(t):
    seg = F.col("risk_segment")
    return t.cp.select("customer_id", R.recommended_action(seg, F.col("retention_priority")).alias("recommended_action"),
                       F.array_join(R.retention_actions(seg), " | ").alias("actions"))


@query("P18_expected_loss", f"select customer_id, {rnd('monthly_charges*churn_probability', 2)} as estimated_revenue_at_risk from t_base")
def _(t):
    return S.backfill(t.base, t.now).select("customer_id", "estimated_revenue_at_risk")


@query("P19_days_since", f"select customer_id, {days_between('predicted_at')} as days_since_prediction from t_cp")
def _(t):
    return P.with_days_since(t.cp, t.now).select("customer_id", "days_since_prediction")


_FLAGS = "(contract_risk_score>=3)::int+(payment_risk_score>=2)::int+(services_count<=2)::int+(tenure<=12)::int"


@query("P20_high_risk_rules", f"""select customer_id, gender, senior_citizen, tenure, contract, internet_service, online_security, tech_support, monthly_charges, total_charges, churn,
 payment_method, contract_risk_score, payment_risk_score, services_count, {_FLAGS} as risk_flags_count, case when {_FLAGS}>=3 then 'High' when {_FLAGS}=2 then 'Medium' else 'Low' end as risk_segment
 from t_rc join (select customer_id, contract_risk_score, payment_risk_score, services_count from t_pc) p using (customer_id)""")
def _(t):
    return P.high_risk_rules(t.rc, t.pc)


@query("P21_filter_customers", """select customer_id, churn, contract, tenure, monthly_charges, risk_segment, churn_probability from t_rc left join (select customer_id, risk_segment, churn_probability from t_cp) p using (customer_id)
 where risk_segment='High' and contract='Month-to-month' and tenure between 3 and 24""")
def _(t):
    df = t.rc.select("customer_id", "churn", "contract", "tenure", "monthly_charges").join(t.cp.select("customer_id", "risk_segment", "churn_probability"), "customer_id", "left")
    return P.filter_customers(df, "High", "Month-to-month", (3, 24))


@query("P22_search_customers", "select customer_id, contract from t_rc where contains(lower(customer_id), lower('sT-00000012'))")
def _(t):
    return P.search_customers(t.rc, "sT-00000012").select("customer_id", "contract")


@query("P23_lookup_customer", "select customer_id, tenure, contract, monthly_charges from t_rc where customer_id='CUST-000000042'")
def _(t):
    return P.lookup_customer(t.rc, "CUST-000000042").select("customer_id", "tenure", "contract", "monthly_charges")


JOINED = f"(timestamp '{NOW}' - to_seconds(tenure*2630016))"


@query("P24_implied_join", f"""select customer_id, {JOINED} as implied_join_date, date_trunc('week', {JOINED})::date as join_week, date_trunc('month', {JOINED})::date as join_month,
 month({JOINED})::int as calendar_month_num, monthname({JOINED}) as calendar_month from t_rc""")
def _(t):
    return P.with_implied_join(t.rc, t.now).select("customer_id", "implied_join_date", "join_week", "join_month", "calendar_month_num", "calendar_month")


@query("P25_customer_clv", f"""select customer_id, churn_probability, risk_segment, monthly_charges, {rnd('least(60.0, 1.0/nullif(churn_probability,0))', 1)} as expected_tenure_months,
 {rnd(seg_clv(), 2)} as clv from t_base""")
def _(t):
    return P.customer_clv(t.cp, t.rc)
