from checks.registry import query
from checks.sqltext import CHURNED, SERVICES, TENURE_MODEL, TENURE_SQL, pct, rnd
from holdfast.operators import summaries as S

_TIER = "case when {0}<35 then 'low' when {0}<70 then 'medium' else 'high' end"
_SENIOR = "case when senior_citizen=1 then 'Senior' else 'Non-Senior' end"


def _union(source: str, dims: dict[str, str], churned: str, extra: str = "") -> str:
    return "\nunion all\n".join(
        f"select '{d}' as dimension, cast({e} as varchar) as segment, count(*) as total_customers, cast({churned} as bigint) as churned, "
        f"{pct(churned, 'count(*)')} as churn_rate_pct{extra} from {source} group by 2"
        for d, e in dims.items()
    )


_AVERAGES = f", {rnd('avg(tenure)', 2)} as avg_tenure_months, {rnd('avg(monthly_charges)', 2)} as avg_monthly_charges"
OVERVIEW = _union("t_rc", {
    "overall": "'all'", "contract": "contract", "gender": "gender", "senior_citizen": _SENIOR, "tenure_group": TENURE_SQL,
    "monthly_charge_tier": _TIER.format("monthly_charges"), "services_count": SERVICES}, CHURNED, _AVERAGES)


@query("A01_churn_overview", OVERVIEW)
def _(t):
    return S.churn_overview(t.rc)


@query("A02_churn_by_features", _union("t_rc", {
    "contract": "contract", "internet_service": "internet_service", "payment_method": "payment_method", "senior_citizen": _SENIOR,
    "partner_dependents": "case when partner='Yes' and dependents='Yes' then 'Partner+Dependents' when partner='Yes' and dependents='No' then 'Partner Only' when partner='No' and dependents='Yes' then 'Dependents Only' else 'Neither' end"}, CHURNED))
def _(t):
    return S.churn_by_features(t.rc)


@query("A03_churn_by_engineered_features", _union("t_pc", {
    "tenure_group": "tenure_group", "contract_risk_score": "contract_risk_score", "payment_risk_score": "payment_risk_score",
    "services_count": "services_count", "charge_per_month_tier": _TIER.format("charge_per_month")}, "sum(churn_label)"))
def _(t):
    return S.churn_by_engineered_features(t.pc)


_U01 = {"gender": "gender", "paperless_billing": "paperless_billing"}


@query("U01_rate_by_dimensions", _union("t_rc", _U01, CHURNED))
def _(t):
    from pyspark.sql import functions as F
    from holdfast.functions.customer import churned
    return S.rate_by_dimensions(t.rc, {d: F.col(d) for d in _U01}, churned(F.col("churn")))


_SUMMARY = f"select {SERVICES} as services_count, count(*) as customer_count, {pct(CHURNED, 'count(*)')} as churn_rate_pct, {rnd('avg(monthly_charges)', 2)} as avg_monthly_charges from t_rc group by 1"
_COMBOS = f"""select concat('security=',online_security,',backup=',online_backup,',device_protect=',device_protection,',tech_support=',tech_support,',streaming_tv=',streaming_tv,',streaming_movies=',streaming_movies) as segment,
 count(*) as customer_count, {rnd('avg(monthly_charges)', 2)} as avg_monthly_charges, {pct('count(*)', "(select count(*) from t_rc where churn='Yes')")} as pct_of_churners
 from t_rc where churn='Yes' group by 1 order by customer_count desc, segment limit 10"""


@query("A04_services_count_summary", _SUMMARY)
def _(t):
    return S.services_count_summary(t.rc)


@query("A05_top_addon_combinations", _COMBOS)
def _(t):
    return S.top_addon_combinations(t.rc)


@query("W07_share_of_total", f"select risk_segment, count(*) as customer_count, {pct('count(*)', 'sum(count(*)) over ()')} as pct_of_total from t_cp group by 1")
def _(t):
    return S.risk_segments(t.cp, t.rc).where("risk_segment in ('High','Medium','Low')").select("risk_segment", "customer_count", "pct_of_total")


@query("U02_churn_by_services", f"""select 'services_count_summary' as section, cast(services_count as varchar) as segment, customer_count, churn_rate_pct, avg_monthly_charges, cast(null as double) as pct_of_churners from ({_SUMMARY}) a
union all select 'top_combinations_churners', segment, customer_count, null, avg_monthly_charges, pct_of_churners from ({_COMBOS}) b""")
def _(t):
    return S.churn_by_services(t.rc)


_AT_RISK = "sum(case when risk_segment in ('High','Medium') then monthly_charges else 0 end)"


@query("A06_churn_by_tenure", f"""select {TENURE_SQL} as tenure_group, count(*) as customer_count, {pct(CHURNED, 'count(*)')} as churn_rate_pct,
 {rnd('avg(monthly_charges)', 2)} as avg_monthly_charges, {rnd(_AT_RISK, 2)} as revenue_at_risk
 from t_rc left join (select customer_id, risk_segment from t_cp) p using (customer_id) group by 1""")
def _(t):
    return S.churn_by_tenure(t.rc, t.cp)


@query("J02_left_join_unscored", f"""select {TENURE_SQL} as tenure_group, count(*) as customer_count, {pct(CHURNED, 'count(*)')} as churn_rate_pct,
 {rnd('avg(monthly_charges)', 2)} as avg_monthly_charges, {rnd(_AT_RISK, 2)} as revenue_at_risk
 from t_rc left join (select customer_id, risk_segment from t_cp semi join t_h using (customer_id)) p using (customer_id) group by 1""")
def _(t):
    return S.churn_by_tenure(t.rc, t.known_cp)


_STATS = f"""select risk_segment, count(*) as customer_count, {pct('count(*)', 'sum(count(*)) over ()')} as pct_of_total,
  {rnd('avg(monthly_charges)', 2)} as avg_monthly_charges, {rnd('avg(tenure)', 2)} as avg_tenure, {rnd('sum(monthly_charges)', 2)} as total_monthly_revenue
  from t_cp join t_rc using (customer_id) group by 1"""
_MODE = """select risk_segment, contract as most_common_contract from (select risk_segment, contract, row_number() over (partition by risk_segment order by count(*) desc, contract) rn
  from t_cp join t_rc using (customer_id) group by 1,2) m where rn=1"""


@query("A07_risk_segments", f"""select risk_segment, customer_count, pct_of_total, avg_monthly_charges, avg_tenure, most_common_contract, total_monthly_revenue,
 case when risk_segment in ('High','Medium') then total_monthly_revenue end as revenue_at_risk from ({_STATS}) s join ({_MODE}) m using (risk_segment)
union all select 'High+Medium (At Risk)', cast(sum(customer_count) as bigint), {rnd('sum(pct_of_total)', 2)}, {rnd('sum(avg_monthly_charges*customer_count)/sum(customer_count)', 2)},
 {rnd('sum(avg_tenure*customer_count)/sum(customer_count)', 2)}, null, {rnd('sum(total_monthly_revenue)', 2)}, {rnd('sum(total_monthly_revenue)', 2)} from ({_STATS}) s where risk_segment in ('High','Medium')""")
def _(t):
    return S.risk_segments(t.cp, t.rc)


@query("A08_churn_rate", f"select count(*) as total_customers, {rnd(f'1.0*{CHURNED}/count(*)', 4)} as churn_rate, {pct(CHURNED, 'count(*)')} as churn_rate_pct from t_rc")
def _(t):
    return S.churn_rate(t.rc)


@query("A09_risk_distribution", "select risk_segment, count(*) as customer_count from t_cp group by 1")
def _(t):
    return S.risk_distribution(t.cp)


@query("A10_value_counts", f"select l.churn, coalesce(n,0) as n, coalesce(pct,0.0) as pct from (values ('Yes'),('No')) l(churn) left join (select churn, count(*) n, {pct('count(*)', 'sum(count(*)) over ()')} pct from t_rc group by 1) c using (churn)")
def _(t):
    return S.value_counts_of(t.rc, "churn", ["Yes", "No"])


@query("A41_churn_rate_by_column", f"select internet_service, count(*) as customers, {pct(CHURNED, 'count(*)')} as churn_rate_pct from t_rc group by 1")
def _(t):
    return S.churn_rate_by(t.rc, "internet_service")


def _cell(contract: str) -> str:
    return rnd(f"avg(case when contract='{contract}' then case when churn='Yes' then 1.0 else 0.0 end end)", 4)


@query("A42_tenure_contract_pivot", f"""select tenure_group, m as month_to_month, o as one_year, w as two_year from (values ('New Customer'),('Growing Customer'),('Established Customer'),('Loyal Customer')) l(tenure_group)
 left join (select {TENURE_MODEL} as tenure_group, {_cell('Month-to-month')} m, {_cell('One year')} o, {_cell('Two year')} w from t_rc group by 1) g using (tenure_group)""")
def _(t):
    return S.tenure_contract_pivot(t.rc)
