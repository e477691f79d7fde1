from pyspark.sql import functions as F

from checks.registry import query
from checks.sqltext import FEATURES, MODELS, feature_sql, probability, rnd, segment_of
from holdfast import constants as K
from holdfast.operators import explain as X

_I = 4  # the full scorecard
_COEF = MODELS[_I][3]


def _phi(f: str) -> str:
    return rnd(f'({_COEF[f]}::double)*("{f}"-avg("{f}") over ())', 6)


_BASE = rnd(f"{MODELS[_I][2]}::double" + "".join(f' + ({_COEF[f]}::double)*avg("{f}") over ()' for f in FEATURES), 6)
_LONG = " union all ".join(f"""select customer_id, {_BASE} as base_value, {i} as i, '{f}' as feature, {rnd(f'"{f}"', 6)} as feature_value, {_phi(f)} as shap_value from t_feat""" for i, f in enumerate(FEATURES))
EXPL = f"""select customer_id, base_value, (row_number() over (partition by customer_id order by abs(shap_value) desc, i))::int as rank, feature, feature_value, shap_value,
 case when shap_value>0 then 'increases risk' else 'decreases risk' end as direction from ({_LONG}) l"""


@query("X01_explain", EXPL)
def _(t):
    return X.explain(t.rc, t.card)


_DRIVERS = f"select feature, {rnd('avg(abs(shap_value))', 6)} as mean_abs_shap from ({EXPL}) e group by 1 order by mean_abs_shap desc, feature limit 10"


@query("X02_top_drivers", _DRIVERS)
def _(t):
    return X.top_drivers(t.rc, t.card)


@query("X03_drivers_by_segment", f"""select risk_segment, feature, mean_abs_shap, rank::int as rank from (select *, row_number() over (partition by risk_segment order by mean_abs_shap desc, feature) rank from (
 select risk_segment, feature, {rnd('avg(abs(shap_value))', 6)} as mean_abs_shap from ({EXPL}) e join (select customer_id, risk_segment from t_cp) c using (customer_id) group by 1,2) g) r where rank<=5""")
def _(t):
    return X.drivers_by_segment(t.rc, t.cp, t.card)


_TEXT = "case feature " + " ".join(f"when '{f}' then '{text}'" for f, text in K.DRIVER_INSIGHTS.items()) + f" else '{K.DEFAULT_INSIGHT}' end"


@query("X04_actionable_insights", f"select feature, mean_abs_shap, {_TEXT} as insight from ({_DRIVERS}) d")
def _(t):
    return X.actionable_insights(X.top_drivers(t.rc, t.card))


@query("X05_explanation_text", f"""select customer_id, concat('The top factors influencing this prediction are ', string_agg(case when rank=5 then concat('and ', s) else s end, ', ' order by rank), '.') as explanation
 from (select customer_id, rank, concat(replace(feature,'_',' '), ' (', direction, ')') s from ({EXPL}) e where rank<=5) x group by 1""")
def _(t):
    return X.explanation_text(t.rc, t.card)


@query("X05_template_explanation", f"""select customer_id, concat('This customer has a ', lower({segment_of('p')}), ' churn risk (', cast({rnd('p*100', 0)} as int), '% probability), driven mainly by ', n, '.') as explanation from (
 select customer_id, string_agg(case when rank=3 then concat('and ', replace(feature,'_',' ')) else replace(feature,'_',' ') end, ', ' order by rank) n from ({EXPL}) e where rank<=3 group by 1) a
 join (select customer_id, churn_probability p from t_scored where model_id=5) b using (customer_id)""")
def _(t):
    return X.template_explanation(t.rc, t.card)


def _scenario(name: str, replaced: str) -> str:
    source = f"(select * replace ({replaced}) from t_rc)"
    feats = feature_sql(source)
    return f"select customer_id, '{name}' as scenario, p0, {probability(_I)} p1 from ({feats}) f join (select customer_id, {probability(_I)} p0 from t_feat) b using (customer_id)"


_WHATIF = f"""select customer_id, scenario, {rnd('p0', 4)} as original_probability, {rnd('p1', 4)} as new_probability, {rnd('p1-p0', 4)} as probability_change, {segment_of('p0')} as original_segment, {segment_of('p1')} as new_segment from (
 {_scenario('Switch to One year contract', "'One year' as contract")} union all {_scenario('Add online security', "'Yes' as online_security")}
 union all {_scenario('Reduce charges by 10%', "total_charges*0.9::double as total_charges, monthly_charges*0.9::double as monthly_charges")}) w"""


@query("X06_what_if", _WHATIF)
def _(t):
    return X.what_if(t.rc, t.card)


@query("X06_what_if_other_scenarios", f"""select customer_id, scenario, {rnd('p0', 4)} as original_probability, {rnd('p1', 4)} as new_probability, {rnd('p1-p0', 4)} as probability_change, {segment_of('p0')} as original_segment, {segment_of('p1')} as new_segment from (
 {_scenario('Switch to Two year contract', "'Two year' as contract")} union all {_scenario('Reduce charges by 20%', "total_charges*0.8::double as total_charges, monthly_charges*0.8::double as monthly_charges")}) w""")
def _(t):
    return X.what_if(t.rc, t.card, [X.contract_change("Two year"), X.reduce_charges(20.0)])


@query("X07_scenario_advice", f"""select *, case when new_segment<>original_segment then concat('Strong lever — this alone would move the customer from ', original_segment, ' to ', new_segment, ' risk.')
 when probability_change<=-0.05 then 'Meaningful risk reduction — worth pursuing alongside other retention actions.' when probability_change<0 then 'Modest effect on its own — likely needs to be combined with other actions.'
 else 'Minimal or no effect for this customer — consider a different lever.' end as advice from ({_WHATIF}) w""")
def _(t):
    return X.scenario_advice(X.what_if(t.rc, t.card))


_ACTS = "case risk_segment " + " ".join(f"when '{s}' then '{' | '.join(a)}'" for s, a in K.RETENTION_ACTIONS.items()) + " end"


@query("X08_predict_records", f"""select customer_id, churn_probability, risk_segment, factors, {_ACTS} as actions, 'full_card_v1' as model_version, timestamp '2024-01-31' as predicted_at from (
 select customer_id, churn_probability, {segment_of('churn_probability')} as risk_segment from t_scored where model_id=5) s join (
 select customer_id, string_agg(concat(feature, '=', direction), ';' order by rank) factors from ({EXPL}) e where rank<=5 group by 1) f using (customer_id)""")
def _(t):
    df = X.predict_records(t.rc, t.card, t.now)
    factors = F.array_join(F.transform("top_risk_factors", lambda f: F.concat(f["feature"], F.lit("="), f["direction"])), ";")
    return df.withColumn("factors", factors).withColumn("actions", F.array_join("recommended_actions", " | ")).drop("top_risk_factors", "recommended_actions")
