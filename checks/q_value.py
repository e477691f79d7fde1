from pyspark.sql import functions as F

from checks.registry import query
from checks.sqltext import CHURNED, SERVICES, TENURE_MODEL, TIER, days_between, pct, rnd, seg_clv
from holdfast import constants as K
from holdfast.operators import joins as J
from holdfast.operators import segments as G
from holdfast.operators import value as V

JOIN = "t_cp join (select customer_id, monthly_charges, contract, tenure, gender, senior_citizen, phone_service, payment_method, internet_service, online_security, paperless_billing from t_rc) r using (customer_id)"
CLV = seg_clv()


@query("J01_predictions_with_profile", f"""select customer_id, gender, senior_citizen, tenure, contract, internet_service, payment_method, monthly_charges, total_charges, churn as actual_churn,
 churn_probability, risk_segment, model_version, predicted_at, {days_between('predicted_at')} as days_since_prediction from t_cp join t_rc using (customer_id)""")
def _(t):
    return J.predictions_with_profile(t.cp, t.rc, t.now)


@query("J03_unscored_customers", "select customer_id, tenure, contract from t_rc anti join t_h using (customer_id)")
def _(t):
    return J.unscored_customers(t.rc, t.known_cp).select("customer_id", "tenure", "contract")


@query("J04_stale_customers", "select customer_id, tenure, contract from t_rc where customer_id in (select customer_id from t_cp where predicted_at < timestamp '2024-01-24 00:00:00')")
def _(t):
    return J.stale_customers(t.rc, t.cp, t.now).select("customer_id", "tenure", "contract")


@query("J05_customers_in_segment", "select customer_id, contract from t_rc where customer_id in (select customer_id from t_cp where risk_segment='Medium')")
def _(t):
    return J.customers_in_segment(t.rc, t.cp, "Medium").select("customer_id", "contract")


@query("J05_customers_in_list", "select customer_id, risk_segment from t_cp where customer_id in (select customer_id from t_h)")
def _(t):
    return J.customers_in_list(t.cp, t.h).select("customer_id", "risk_segment")


_AVG = {"charge_per_month": "total_charges/case when tenure=0 then 1 else tenure end", "services_count": SERVICES,
        "contract_risk_score": "case contract when 'Month-to-month' then 3 when 'One year' then 2 else 1 end",
        "payment_risk_score": "case payment_method when 'Electronic check' then 3 when 'Mailed check' then 2 else 1 end",
        "tenure": "tenure", "monthly_charges": "monthly_charges"}


@query("J09_compare_to_average", " union all ".join(
    f"select customer_id, '{n}' as feature, {rnd(f'({e})', 4)} as customer_value, {rnd(f'avg({e}) over ()', 4)} as population_average, {rnd(f'({e})-avg({e}) over ()', 4)} as diff from t_rc" for n, e in _AVG.items()))
def _(t):
    return J.compare_to_average(t.rc)


@query("J11_similar_customers", """select customer_id, risk_segment, contract, cast(rank as int) as rank, tenure_diff, similar_id, similar_tenure, similar_charges, similar_probability from (
 select a.customer_id, a.risk_segment, a.contract, abs(a.tenure-b.tenure) tenure_diff, b.customer_id similar_id, b.tenure similar_tenure, b.monthly_charges similar_charges, b.churn_probability similar_probability,
 row_number() over (partition by a.customer_id order by abs(a.tenure-b.tenure), b.customer_id) rank
 from (select p.customer_id, risk_segment, contract, tenure from t_cp p join t_rc using (customer_id)) a
 join (select p.customer_id, risk_segment, contract, tenure, monthly_charges, churn_probability from t_cp p join t_rc using (customer_id)) b
 on a.risk_segment=b.risk_segment and a.contract=b.contract and a.customer_id<>b.customer_id) x where rank<=5""")
def _(t):
    return J.similar_customers(J.predictions_with_profile(t.cp, t.rc, t.now))


@query("A13_revenue_by_segment", f"select risk_segment, count(*) as customer_count, {rnd('sum(monthly_charges)', 2)} as monthly_revenue_at_risk, {rnd('avg(monthly_charges)', 2)} as avg_monthly_charges from {JOIN} group by 1")
def _(t):
    return V.revenue_by_segment(t.cp, t.rc)


@query("A14_revenue_at_risk", f"select {rnd('sum(monthly_charges)', 2)} as revenue_at_risk from {JOIN} where risk_segment='High'")
def _(t):
    return V.revenue_at_risk(t.cp, t.rc)


@query("A14_revenue_at_risk_high_medium", f"select {rnd('sum(monthly_charges)', 2)} as revenue_at_risk from {JOIN} where risk_segment in ('High','Medium')")
def _(t):
    return V.revenue_at_risk(t.cp, t.rc, V.AT_RISK)


@query("A15_clv_by_segment", f"select risk_segment, count(*) as customer_count, {rnd(f'avg({CLV})', 2)} as avg_clv, {rnd(f'sum({CLV})', 2)} as total_clv from {JOIN} group by 1")
def _(t):
    return V.clv_by_segment(t.cp, t.rc)


@query("A16_clv_at_risk", f"select count(*) as high_risk_customers, {rnd(f'sum({CLV})', 2)} as total_clv_at_risk, {rnd(f'avg({CLV})', 2)} as avg_clv_at_risk from {JOIN} where risk_segment='High'")
def _(t):
    return V.clv_at_risk(t.cp, t.rc)


@query("A17_revenue_saved_by_segment", f"select risk_segment, count(*) as customer_count, {rnd(f'sum({CLV})', 2)} as revenue_saved_if_prevented from {JOIN} where risk_segment<>'Low' group by 1")
def _(t):
    return V.revenue_saved_by_segment(t.cp, t.rc)


_TIERS = f"(select retention_priority, count(*) n, avg(monthly_charges) m from {JOIN} where retention_priority is not null group by 1) s"


@query("A18_roi_by_tier", f"select retention_priority, n as customers_targeted, {rnd('n*15.0', 2)} as campaign_cost, {rnd('n*0.3::double*m*12', 2)} as revenue_recovered, {rnd('(n*0.3::double*m*12-n*15.0::double)/nullif(n*15.0::double,0)*100', 1)} as roi_pct from {_TIERS}")
def _(t):
    return V.roi_by_tier(t.cp, t.rc)


@query("A19_cost_per_saved", f"select retention_priority, n as customers_targeted, {rnd('n*0.3::double', 1)} as expected_customers_retained, {rnd('n*15.0::double/nullif(n*0.3::double,0)', 2)} as cost_per_customer_saved from {_TIERS}")
def _(t):
    return V.cost_per_saved(t.cp)


@query("A20_revenue_recovered_by_tier", f"select retention_priority, n as customers_targeted, {rnd('m', 2)} as avg_monthly_charges, {rnd('n*0.3::double*m*12', 2)} as annual_revenue_recovered from {_TIERS}")
def _(t):
    return V.revenue_recovered_by_tier(t.cp, t.rc)


@query("A21_break_even_by_tier", f"select retention_priority, n as customers_targeted, {rnd('n*15.0', 2)} as campaign_cost, {rnd('15.0::double/(m*12)*100', 2)} as break_even_success_rate_pct, {rnd('n*(15.0::double/(m*12))', 1)} as break_even_customers_to_retain from {_TIERS}")
def _(t):
    return V.break_even_by_tier(t.cp, t.rc)


@query("A22_expected_savings", f"select risk_segment, count(*) as customer_count, {rnd('count(*)*15.0', 2)} as campaign_cost, {rnd('count(*)*0.3::double*avg(monthly_charges)*12', 2)} as expected_annual_savings from {JOIN} where risk_segment in ('High','Medium') group by 1")
def _(t):
    return V.expected_savings(t.cp, t.rc)


@query("A23_estimate_retention_savings", f"""select n as customers_targeted, 15.0::double as campaign_cost_per_customer, 0.3::double as success_rate, {rnd('n*15.0', 2)} as total_cost, {rnd('n*0.3::double', 1)} as expected_customers_retained,
 {rnd('n*0.3::double*m*12', 2)} as revenue_recovered, {rnd('(n*0.3::double*m*12-n*15.0::double)/(n*15.0::double)*100', 1)} as roi_pct from (select count(*) n, avg(monthly_charges) m from {JOIN} where risk_segment='High') s""")
def _(t):
    return V.estimate_retention_savings(t.cp, t.rc)


_TARGETS = f"select customer_id, churn_probability, risk_segment, contract, monthly_charges, tenure, payment_method, internet_service, {TIER} as priority_tier from {JOIN} where risk_segment='High'"


@query("K05_retention_targets", _TARGETS)
def _(t):
    return V.retention_targets(t.cp, t.rc)


@query("A24_tier_summary", f"select priority_tier, count(*) as customer_count, {rnd('avg(churn_probability)', 2)} as avg_churn_probability, {rnd('avg(monthly_charges)', 2)} as avg_monthly_charges, {rnd('sum(monthly_charges)', 2)} as total_monthly_revenue from ({_TARGETS}) x group by 1")
def _(t):
    return V.tier_summary(V.retention_targets(t.cp, t.rc))


@query("A24_target_contracts", f"select contract, count(*) as customer_count from ({_TARGETS}) x group by 1")
def _(t):
    return V.target_contracts(V.retention_targets(t.cp, t.rc))


@query("A25_backfill_summary", f"select risk_segment, retention_priority, count(*) as n, {rnd('avg(estimated_revenue_at_risk)', 2)} as avg_revenue_at_risk, {rnd('avg(days_since_last_score)', 2)} as avg_days_since_score from t_cp group by 1,2")
def _(t):
    return V.backfill_summary(t.cp)


def _share(cond: str) -> str:
    return f"coalesce({rnd(f'avg(case when {cond} then 1.0 else 0.0 end)*100', 1)},0.0)"


PROFILES = f"""select l.segment, count(customer_id) as customer_count, coalesce({rnd('avg(tenure)', 1)},0.0) as avg_tenure_months, coalesce({rnd('avg(monthly_charges)', 2)},0.0) as avg_monthly_charges,
 {_share("contract='Month-to-month'")} as pct_month_to_month, {_share("payment_method='Electronic check'")} as pct_electronic_check, {_share("online_security='No'")} as pct_no_online_security,
 {_share("paperless_billing='Yes'")} as pct_paperless_billing, {_share("senior_citizen=1")} as pct_senior_citizen
 from (values ('High'),('Medium'),('Low')) l(segment) left join ({"select * from " + JOIN}) j on j.risk_segment=l.segment group by 1"""


@query("A26_compare_segments", PROFILES)
def _(t):
    return G.compare_segments(t.cp, t.rc)


def _p0(c: str) -> str:
    return f"cast(cast({rnd(c, 0)} as int) as varchar)"


_RULES = f"""case when pct_month_to_month>=50 then concat({_p0('pct_month_to_month')},'% are on month-to-month contracts — prioritize annual/two-year contract upgrade offers.') end,
 case when pct_no_online_security>=50 then concat({_p0('pct_no_online_security')},'% lack online security — bundle it in as a low-cost retention add-on.') end,
 case when pct_electronic_check>=40 then concat({_p0('pct_electronic_check')},'% pay by electronic check — encourage autopay/credit-card enrollment, historically a lower-churn payment method.') end,
 case when avg_tenure_months<=12 then concat('Average tenure is only ',{_p0('avg_tenure_months')},' months — this segment skews new; focus on onboarding and early-lifecycle engagement.') end"""


@query("A27_segment_recommendations", f"""select segment, cast(i-1 as int) as place, lines[i] as recommendation from (select segment, lines, unnest(range(1, len(lines)+1)) i from (
 select segment, case when len(f)>0 then f else ['No standout risk levers — this segment looks broadly healthy.'] end lines from (select segment, list_filter([{_RULES}], lambda x: x is not null) f from ({PROFILES}) p) q) r) s""")
def _(t):
    return G.segment_recommendations(G.compare_segments(t.cp, t.rc))


_E = "(select round(quantile_cont(monthly_charges, {}),9) from t_rc)"
SEGMENTED = f"""select customer_id, churn_probability, risk_segment, tenure, monthly_charges, contract, {rnd(CLV, 4)} clv,
 case when round(monthly_charges,9)<={_E.format('1.0/3')} then 'Low' when round(monthly_charges,9)<={_E.format('2.0/3')} then 'Medium' else 'High' end value_segment,
 {TENURE_MODEL} tenure_segment from {JOIN}"""


def _segmented(t):
    return G.segment_customers(t.cp, t.rc)


@query("G01_segment_by_value", f"select customer_id, clv, value_segment from ({SEGMENTED}) s")
def _(t):
    from holdfast.functions.rounding import half_up
    df = t.cp.select("customer_id", "churn_probability").join(t.rc.select("customer_id", "monthly_charges"), "customer_id")
    return G.segment_by_value(df).select("customer_id", half_up(F.col("clv"), 4).alias("clv"), "value_segment")


@query("G02_segment_customers", SEGMENTED)
def _(t):
    from holdfast.functions.rounding import half_up
    return _segmented(t).withColumn("clv", half_up(F.col("clv"), 4))


@query("A28_segment_matrix", f"""select l.value_segment, count_if(risk_segment='Low') as "Low", count_if(risk_segment='Medium') as "Medium", count_if(risk_segment='High') as "High"
 from (values ('Low'),('Medium'),('High')) l(value_segment) left join ({SEGMENTED}) s using (value_segment) group by 1""".replace("count_if(", "(count(*) filter (where ").replace("'Low') as", "'Low'))::bigint as").replace("'Medium') as", "'Medium'))::bigint as").replace("'High') as", "'High'))::bigint as"))
def _(t):
    return G.segment_matrix(_segmented(t))


@query("A29_segment_characteristics", f"""select value_segment, risk_segment, count(*) as customers, {rnd('avg(tenure)', 1)} as avg_tenure, {rnd('avg(monthly_charges)', 2)} as avg_monthly_charges, {rnd('avg(churn_probability)', 4)} as avg_churn_probability,
 {rnd('sum(monthly_charges)', 2)} as total_monthly_revenue from ({SEGMENTED}) s group by 1,2""")
def _(t):
    return G.segment_characteristics(_segmented(t))


@query("A30_segment_sizes", " union all ".join(
    f"select '{k}' as kind, l.segment, count(s.customer_id) as customers from (values {','.join(f'({chr(39)}{v}{chr(39)})' for v in vs)}) l(segment) left join ({SEGMENTED}) s on s.{k}=l.segment group by 2"
    for k, vs in (("value_segment", K.LEVEL_ORDER), ("risk_segment", K.LEVEL_ORDER), ("tenure_segment", K.TENURE_LABELS_MODEL))))
def _(t):
    return G.segment_sizes(_segmented(t))


@query("A51_segment_kpis", f"select count(*) as total_customers, {rnd('sum(monthly_charges)', 2)} as total_monthly_revenue, count(*) filter (where value_segment='High') as high_value_customers, count(*) filter (where value_segment='High' and risk_segment='High') as high_value_high_risk from ({SEGMENTED}) s")
def _(t):
    return G.segment_kpis(_segmented(t))


@query("A52_prediction_kpis", f"select count(*) filter (where risk_segment='High') as high_count, count(*) filter (where risk_segment='Medium') as medium_count, count(*) filter (where risk_segment='Low') as low_count, {rnd('avg(churn_probability)', 4)} as avg_probability from t_cp")
def _(t):
    return V.prediction_kpis(t.cp)


@query("K01_top_clv", f"select customer_id, contract, tenure, monthly_charges, churn_probability, risk_segment, {rnd(CLV, 2)} as clv from {JOIN} where risk_segment in ('High','Medium') order by clv desc, customer_id limit 10")
def _(t):
    return V.top_clv(t.cp, t.rc)


@query("K02_top_revenue_at_risk", f"select customer_id, contract, tenure, monthly_charges, churn_probability from {JOIN} where risk_segment='High' order by monthly_charges desc, customer_id limit 10")
def _(t):
    return V.top_revenue_at_risk(t.cp, t.rc)


_HIGH = f"select customer_id, gender, senior_citizen, phone_service, payment_method, contract, tenure, monthly_charges, churn_probability, risk_segment from {JOIN} where risk_segment='High'"


@query("K04_high_risk_customers", _HIGH)
def _(t):
    return V.high_risk_customers(t.cp, t.rc)


@query("K04_high_risk_customers_top", _HIGH + " order by churn_probability desc, customer_id limit 50")
def _(t):
    return V.high_risk_customers(t.cp, t.rc, 50)


@query("K08_top_risk", "select customer_id, churn_probability, risk_segment from t_cp order by churn_probability desc, customer_id limit 1")
def _(t):
    return V.top_risk(t.cp).select("customer_id", "churn_probability", "risk_segment")


@query("K08_tier_list", f"select * from ({_TARGETS}) x where priority_tier='Tier 2'")
def _(t):
    return V.tier_list(V.retention_targets(t.cp, t.rc), "Tier 2")
