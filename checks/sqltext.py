"""The derived tables as SQL. `t_*` names are common table expressions of the oracle queries.

The text of t_rc, t_base and t_h runs in both engines up to the tokens {STR} and {AGE}.
"""

import re

NOW = "2024-01-31 00:00:00"

RAW_CUSTOMERS = """
select concat('CUST-', lpad(cast(k as {STR}),9,'0')) customer_id,
 case when k%2=0 then 'Male' else 'Female' end gender,
 case when k%25<4 then 1 else 0 end senior_citizen,
 case when k%25<12 then 'Yes' else 'No' end partner,
 case when k%10<3 then 'Yes' else 'No' end dependents,
 case when recency is null then 0 else 1+cast(floor(recency/7.0) as int)%72 end tenure,
 case when k%10=9 then 'No' else 'Yes' end phone_service,
 case when k%10=9 then 'No phone service' when k%3=0 then 'Yes' else 'No' end multiple_lines,
 case when k%9<3 then 'DSL' when k%9<7 then 'Fiber optic' else 'No' end internet_service,
 case when k%9>=7 then 'No internet service' when spend%7<2 then 'Yes' else 'No' end online_security,
 case when k%9>=7 then 'No internet service' when spend%11<4 then 'Yes' else 'No' end online_backup,
 case when k%9>=7 then 'No internet service' when spend%13<4 then 'Yes' else 'No' end device_protection,
 case when k%9>=7 then 'No internet service' when spend%17<5 then 'Yes' else 'No' end tech_support,
 case when k%9>=7 then 'No internet service' when spend%19<7 then 'Yes' else 'No' end streaming_tv,
 case when k%9>=7 then 'No internet service' when spend%23<9 then 'Yes' else 'No' end streaming_movies,
 case when seg in ('AUTOMOBILE','BUILDING','FURNITURE') then 'Month-to-month' when seg='HOUSEHOLD' then 'One year' else 'Two year' end contract,
 case when k%5<3 then 'Yes' else 'No' end paperless_billing,
 case when spend%100<34 then 'Electronic check' when spend%100<57 then 'Mailed check' when spend%100<79 then 'Bank transfer (automatic)' else 'Credit card (automatic)' end payment_method,
 cast(1800+spend%10000 as double)/100 monthly_charges,
 cast((1800+spend%10000)*(case when recency is null then 0 else 1+cast(floor(recency/7.0) as int)%72 end) as double)/100 total_charges,
 case when (case when seg in ('AUTOMOBILE','BUILDING','FURNITURE') then 30 else 0 end)
   + (case when recency is null or cast(floor(recency/7.0) as int)%72<11 then 20 else 0 end)
   + (case when k%9>=3 and k%9<7 then 10 else 0 end) + spend%23 >= 52 then 'Yes' else 'No' end churn
from (
 select c_custkey k, c_mktsegment seg,
  cast({AGE} as int) recency,
  cast(floor(coalesce(o.cents,0)/100.0) as bigint) spend
 from {customer} left join (
   select o_custkey, max(o_orderdate) last_dt, sum(cast(round(o_totalprice*100) as bigint)) cents
   from {orders} group by o_custkey) o on o.o_custkey=c_custkey) b
"""

_Z = """-2.6 + 0.9*(case contract when 'Month-to-month' then 3 when 'One year' then 2 else 1 end)
  + 0.35*(case payment_method when 'Electronic check' then 3 when 'Mailed check' then 2 else 1 end)
  + (case when tenure<=12 then 1.4 when tenure<=24 then 0.2 else -1.3 end)
  - 0.12*((case when phone_service='Yes' then 1 else 0 end)+(case when internet_service<>'No' then 1 else 0 end)) - 0.5"""

SCORECARD = f"""
select customer_id, monthly_charges, churn_probability,
 case when churn_probability>=0.7 then 'High' when churn_probability>=0.4 then 'Medium' else 'Low' end risk_segment
from (select customer_id, monthly_charges, round(1.0/(1.0+exp(-({_Z}))),6) churn_probability from {{t_rc}}) s
"""

HISTORY = """
select concat('CUST-', lpad(cast(user_id as {STR}),9,'0')) customer_id, churn_probability,
 case when churn_probability>=0.7 then 'High' when churn_probability>=0.4 then 'Medium' else 'Low' end risk_segment,
 'scorecard_v0' model_version, ts predicted_at, ts archived_at, event_id id
from (select user_id, ts, event_id, round(least(1.0, value/150.0),6) churn_probability from {events}) e
"""


def rnd(expr: str, digits: int) -> str:
    """Half-up rounding through a decimal."""
    return f"cast(round(cast({expr} as decimal(38,8)),{digits}) as double)"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return rnd(f"100.0*({part})/nullif({whole},0)", digits)


CHURNED = "sum(case when churn='Yes' then 1 else 0 end)"
TENURE_SQL = "case when tenure<=12 then '0-12' when tenure<=24 then '12-24' when tenure<=48 then '24-48' else '48+' end"
TENURE_MODEL = "case when tenure<=12 then 'New Customer' when tenure<=24 then 'Growing Customer' when tenure<=48 then 'Established Customer' else 'Loyal Customer' end"
SERVICES = " + ".join(
    [f"(case when {c}='Yes' then 1 else 0 end)" for c in (
        "phone_service", "online_security", "online_backup", "device_protection", "tech_support", "streaming_tv", "streaming_movies")]
    + ["(case when internet_service<>'No' then 1 else 0 end)"]
)
CONTRACT_RISK = "case contract when 'Month-to-month' then 3 when 'One year' then 2 when 'Two year' then 1 end"
PAYMENT_RISK = "case payment_method when 'Electronic check' then 3 when 'Mailed check' then 2 when 'Bank transfer (automatic)' then 1 when 'Credit card (automatic)' then 1 end"
PRIORITY = "case when risk_segment='High' then case when monthly_charges>70 then 'Tier1' when monthly_charges>=40 then 'Tier2' else 'Tier3' end end"
TIER = "case when monthly_charges>70 then 'Tier 1' when monthly_charges>=40 then 'Tier 2' else 'Tier 3' end"


def segment_of(p: str, high: float = 0.7, medium: float = 0.4) -> str:
    return f"case when {p}>={high} then 'High' when {p}>={medium} then 'Medium' else 'Low' end"


def action_of(segment: str, priority: str) -> str:
    return (
        f"case when {segment}='High' and {priority}='Tier1' then 'Priority outreach: offer loyalty discount + contract upgrade incentive'"
        f" when {segment}='High' and {priority}='Tier2' then 'Standard outreach: satisfaction survey + modest loyalty discount'"
        f" when {segment}='High' then 'Low-cost outreach: email survey, monitor for escalation'"
        f" when {segment}='Medium' then 'Monitor closely; consider proactive engagement before next cycle'"
        f" when {segment}='Low' then 'No action needed - monitor periodically' end"
    )


def days_between(since: str, now: str = f"timestamp '{NOW}'") -> str:
    return f"cast(trunc((epoch({now})-epoch({since}))/86400) as int)"


def seg_clv(prefix_rc: str = "", prefix_cp: str = "") -> str:
    return f"{prefix_rc}monthly_charges*least(60.0, 1.0/nullif({prefix_cp}churn_probability,0))"


# scorecards that stand for trained models: (name, version, intercept, coefficients, trained on)
MODELS = [
    ("contract_card", "v1", -3.6, {"contract_risk_score": 1.3}, "2024-01-02 08:00:00"),
    ("contract_card", "v2", -4.2, {"contract_risk_score": 1.2, "payment_risk_score": 0.4}, "2024-01-09 08:00:00"),
    ("tenure_card", "v1", -1.5, {"tenure_group_Established Customer": -1.0, "tenure_group_Growing Customer": 0.3, "tenure_group_Loyal Customer": -1.0, "tenure_group_New Customer": 2.2}, "2024-01-04 08:00:00"),
    ("tenure_card", "v2", -1.0, {"services_count": -0.15, "tenure_group_Established Customer": -1.0, "tenure_group_Growing Customer": 0.3, "tenure_group_Loyal Customer": -1.0, "tenure_group_New Customer": 2.2}, "2024-01-11 08:00:00"),
    ("full_card", "v1", -2.9, {"charge_per_month": 0.004, "services_count": -0.11, "contract_risk_score": 0.9, "payment_risk_score": 0.35, "tenure_group_Established Customer": -1.3, "tenure_group_Growing Customer": 0.2, "tenure_group_Loyal Customer": -1.3, "tenure_group_New Customer": 1.4}, "2024-01-06 08:00:00"),
    ("full_card", "v2", -3.6, {"charge_per_month": 0.006, "services_count": -0.05, "contract_risk_score": 1.4, "payment_risk_score": 0.1, "tenure_group_Established Customer": -1.1, "tenure_group_Growing Customer": -0.6, "tenure_group_Loyal Customer": -1.1, "tenure_group_New Customer": 1.6}, "2024-01-13 08:00:00"),
]
FEATURES = ["charge_per_month", "services_count", "contract_risk_score", "payment_risk_score", "tenure_group_Established Customer", "tenure_group_Growing Customer", "tenure_group_Loyal Customer", "tenure_group_New Customer"]


def logit(i: int) -> str:
    _, _, intercept, coefs, _ = MODELS[i]
    return f"{intercept}::double" + "".join(f' + ({coefs[f]}::double)*"{f}"' for f in FEATURES if f in coefs)


def probability(i: int) -> str:
    return f"round(1.0/(1.0+exp(-({logit(i)}))),6)"


def feature_sql(source: str, extra: str = "") -> str:
    """The model inputs of a raw customer source."""
    dummies = ", ".join(f"""case when ({TENURE_MODEL})='{f[13:]}' then 1 else 0 end "{f}\"""" for f in FEATURES[4:])
    return f"""select customer_id, case when churn='Yes' then 1 else 0 end churn_label, total_charges/(case when tenure=0 then 1 else tenure end) charge_per_month, {SERVICES} services_count,
      {CONTRACT_RISK} contract_risk_score, {PAYMENT_RISK} payment_risk_score, {dummies}{extra} from {source}"""


def _duck(text: str) -> str:
    return text.replace("{STR}", "varchar").replace("{customer}", "customer").replace("{orders}", "orders").replace(
        "{events}", "events").replace("{AGE}", "datediff('day', o.last_dt, (select max(o_orderdate) from orders))")


RC_COLUMNS = "gender senior_citizen partner dependents phone_service multiple_lines internet_service online_security online_backup device_protection tech_support streaming_tv streaming_movies paperless_billing payment_method".split()
_SAME = ", ".join(RC_COLUMNS)

# three loads with typical faults: padded ids and blank totals; broken rows under new ids; repeated ids
MESSY = f"""
select 1 load_no, concat('  ', customer_id, ' ') customer_id, {_SAME}, tenure, contract, monthly_charges,
  case when tenure<=2 then ' ' else cast(total_charges as {{STR}}) end total_charges, churn from {{t_rc}}
union all select 2, concat('NEW-', customer_id), {_SAME}, tenure+60, case when partner='Yes' then 'Weekly' else contract end,
  monthly_charges-60, 'n/a', case when gender='Male' then 'Maybe' else churn end from {{t_rc}} where tenure>=12
union all select 3, customer_id, {_SAME}, tenure, contract, monthly_charges+1, cast(total_charges as {{STR}}), churn from {{t_rc}} where contract='Two year'
"""
# missing values: categories, blank text numbers, numbers
HOLES = f"""
select customer_id, {_SAME.replace("partner,", "nullif(partner,'No') partner,")}, churn, contract,
  case when senior_citizen=1 then null else tenure end tenure, case when contract='One year' then null else monthly_charges end monthly_charges,
  case when tenure<=2 then ' ' else cast(total_charges as {{STR}}) end total_charges from {{t_rc}}
"""

CTES = {
    "t_rc": _duck(RAW_CUSTOMERS),
    "t_base": SCORECARD.replace("{t_rc}", "t_rc"),
    "t_cp": f"""select customer_id, churn_probability, risk_segment, 'scorecard_v1' model_version, predicted_at,
      {PRIORITY} retention_priority, {action_of("risk_segment", f"({PRIORITY})")} recommended_action,
      {rnd("monthly_charges*churn_probability", 2)} estimated_revenue_at_risk, {days_between("predicted_at")} days_since_last_score
      from (select *, timestamp '2024-01-30 23:00:00' - to_days(cast(cast(substr(customer_id,6) as bigint) % 21 as int)) predicted_at from t_base) b""",
    "t_messy": MESSY.replace("{STR}", "varchar").replace("{t_rc}", "t_rc"),
    "t_holes": HOLES.replace("{STR}", "varchar").replace("{t_rc}", "t_rc"),
    "t_h": _duck(HISTORY),
    "t_pc": f"""select customer_id, {TENURE_MODEL} tenure_group, total_charges/(case when tenure=0 then 1 else tenure end) charge_per_month,
      {SERVICES} services_count, {CONTRACT_RISK} contract_risk_score, {PAYMENT_RISK} payment_risk_score,
      case when churn='Yes' then 1 else 0 end churn_label, cast(null as double) churn_probability, cast(null as varchar) risk_segment from t_rc""",
    "t_feat": feature_sql("t_rc"),
    "t_split": """select customer_id, churn_label, case when rn<=floor(n*0.2+0.5) then 'test' else 'train' end split from (select customer_id, churn_label,
      row_number() over (partition by churn_label order by md5(concat(customer_id,'#42'))) rn, count(*) over (partition by churn_label) n from t_pc) x""",
    "t_scored": " union all ".join(f"select {i + 1} model_id, '{m[0]}' model_name, '{m[1]}' model_version, customer_id, churn_label, {probability(i)} churn_probability from t_feat" for i, m in enumerate(MODELS)),
    "t_test": "select t_scored.* from t_scored semi join (select customer_id from t_split where split='test') s using (customer_id)",
    "t_reg": "",
    "t_runs": """select row_number() over (order by d) id, 'daily_pipeline' pipeline_name, case when errors>avg(errors) over () then 'failed' else 'success' end status, n rows_processed,
      n/1000.0::double duration_seconds, concat(errors, ' error events') details, d::timestamp run_at from (select ts::date d, count(*) n, count(*) filter (where event_type='error') errors from events group by 1) e""",
    "t_alerts": """select event_id id, 'event_value' alert_type, case when value>200 then 'critical' else 'warning' end severity, concat('event ', event_id, ' of user ', user_id) message, ts created_at
      from events where event_type='error' and value>100""",
    "t_snaps": f"select {rnd('avg(churn_probability)', 6)} mean_score, archived_at::date::timestamp snapshot_at from t_h group by 2",
    "t_latest": """select customer_id, churn_probability prev_probability, risk_segment prev_segment, archived_at from (
      select *, row_number() over (partition by customer_id order by archived_at desc, id desc) rn from t_h) x where rn=1""",
}


def metrics_sql(source: str, by: str = "") -> str:
    """accuracy, auc, f1, precision, recall per group; AUC from the mid-ranks of all rows."""
    part, group, sel = (f"partition by {by}", f"group by {by}", f"{by},") if by else ("", "", "")
    return f"""select {sel} {rnd('(tp+tn)/(1.0::double*(tp+tn+fp+fn))', 6)} as accuracy, {rnd('(rank_sum-pos*(pos+1)/2.0::double)/(1.0::double*pos*neg)', 6)} as auc, {rnd('coalesce(2.0::double*tp/nullif(2*tp+fp+fn,0),0)', 6)} as f1,
      {rnd('coalesce(1.0::double*tp/nullif(tp+fp,0),0)', 6)} as precision, {rnd('coalesce(1.0::double*tp/nullif(tp+fn,0),0)', 6)} as recall from (
      select {sel} sum(churn_label) pos, sum(1-churn_label) neg, sum(churn_label*mid) rank_sum, count(*) filter (where churn_probability>=0.5 and churn_label=1) tp, count(*) filter (where churn_probability>=0.5 and churn_label=0) fp,
      count(*) filter (where churn_probability<0.5 and churn_label=1) fn, count(*) filter (where churn_probability<0.5 and churn_label=0) tn from (
      select *, rank() over ({part} order by churn_probability) + (count(*) over (partition by {sel} churn_probability)-1)/2.0::double mid from {source}) r {group}) c"""


_TRAINED = "case model_id " + " ".join(f"when {i + 1} then timestamp '{m[4]}'" for i, m in enumerate(MODELS)) + " end"
CTES["t_reg"] = f"""select id, model_name, model_version, accuracy, auc_score, f1_score, trained_at, row_number() over (order by auc_score desc, id)=1 is_active from (
  select model_id::bigint id, model_name, model_version, accuracy, auc auc_score, f1 f1_score, {_TRAINED} trained_at from ({metrics_sql('t_test', 'model_id, model_name, model_version')}) m) g"""


def psi_sql(source: str) -> str:
    """(feature, psi, e_mean, a_mean) of a long source (split, feature, value)."""
    return f"""select feature, {rnd('sum((ap-ep)*ln(ap/ep))', 4)} psi, sum(es)/sum(e) e_mean, sum(as_)/sum(a) a_mean from (
      select *, case when e=0 then 0.0001 else e/sum(e) over (partition by feature) end::double ep, case when a=0 then 0.0001 else a/sum(a) over (partition by feature) end::double ap from (
      select feature, bucket, count(*) filter (where split='train') e, count(*) filter (where split='test') a, sum(case when split='train' then value else 0 end) es, sum(case when split='test' then value else 0 end) as_ from (
      select s.*, len(list_filter(edges, lambda x: x<=round(value,9))) bucket from {source} s join (
      select feature, list_distinct(list_transform(quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]), lambda x: round(x,9))) edges from {source} t where split='train' group by 1) q using (feature)) b group by 1,2) c) d group by 1"""


def with_ctes(sql: str) -> str:
    """Prefix the query with the common table expressions it needs, dependencies first."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bt_[a-z_0-9]+\b", text):
            if name in CTES and name not in order:
                need(CTES[name])
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql
    return "with " + ",\n".join(f"{n} as ({CTES[n]})" for n in order) + "\n" + sql
