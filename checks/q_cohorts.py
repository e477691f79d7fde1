from pyspark.sql import functions as F

from checks.q_features import JOINED
from checks.registry import query
from checks.sqltext import CHURNED, pct, rnd
from holdfast import constants as K
from holdfast.functions.rounding import half_up
from holdfast.operators import cohorts as C
from holdfast.operators import stats as S

COHORTS = f"""select *, {rnd('100.0-churn_rate_pct', 2)} as retention_rate_pct from (select date_trunc('week', {JOINED})::date as cohort_week, count(*) as cohort_size, {CHURNED}::bigint as churned,
 {pct(CHURNED, 'count(*)')} as churn_rate_pct from t_rc group by 1) c"""


@query("A31_cohort_table", COHORTS)
def _(t):
    return C.cohort_table(t.rc, t.now)


def _kept(contract: str) -> str:
    n = f"count(*) filter (where contract='{contract}')"
    y = f"count(*) filter (where contract='{contract}' and churn='Yes')"
    return f"case when {n}>0 then {rnd(f'100.0-100.0*{y}/nullif({n},0)', 2)} end"


_PIVOT = f"select date_trunc('week', {JOINED})::date as cohort_week, {_kept('Month-to-month')} as month_to_month, {_kept('One year')} as one_year, {_kept('Two year')} as two_year from t_rc group by 1"


@query("A32_retention_pivot", f"{_PIVOT} order by 1 desc limit 20")
def _(t):
    return C.retention_pivot(t.rc, t.now)


@query("A32_retention_pivot_all", _PIVOT)
def _(t):
    return C.retention_pivot(t.rc, t.now, None)


@query("A32_retention_by_contract", f"select * from (unpivot (select cohort_week, month_to_month as \"Month-to-month\", one_year as \"One year\", two_year as \"Two year\" from ({_PIVOT}) p) on \"Month-to-month\", \"One year\", \"Two year\" into name contract value retention_rate_pct) u")
def _(t):
    return C.retention_by_contract(t.rc, t.now)


@query("A33_best_cohort", f"select * from ({COHORTS}) b where cohort_size>=5 order by retention_rate_pct desc, cohort_week limit 1")
def _(t):
    return C.best_cohort(C.cohort_table(t.rc, t.now))


@query("A33_worst_cohort", f"select * from ({COHORTS}) b where cohort_size>=5 order by retention_rate_pct, cohort_week limit 1")
def _(t):
    return C.worst_cohort(C.cohort_table(t.rc, t.now))


TREND = f"select date_trunc('month', {JOINED})::date as join_month, count(*) as customers, {CHURNED}::bigint as churned, {pct(CHURNED, 'count(*)')} as churn_rate from t_rc group by 1 order by 1 desc limit 6"


@query("A34_churn_trend", TREND)
def _(t):
    return C.churn_trend(t.rc, t.now)


_MONTHS = f"select month({JOINED})::int as calendar_month_num, monthname({JOINED}) as calendar_month, {pct(CHURNED, 'count(*)')} as churn_rate, count(*) as customers from t_rc group by 1,2"


@query("A35_calendar_months", _MONTHS)
def _(t):
    return C.calendar_months(t.rc, t.now)


_SEASON = f"""select *, spread_pct_points>5 as is_seasonal from (select (array_agg(calendar_month order by churn_rate desc, calendar_month_num))[1] as highest_month, max(churn_rate) as highest_churn_rate,
 (array_agg(calendar_month order by churn_rate, calendar_month_num))[1] as lowest_month, min(churn_rate) as lowest_churn_rate, {rnd('max(churn_rate)-min(churn_rate)', 2)} as spread_pct_points from ({_MONTHS}) m) s"""


@query("A35_seasonal_patterns", _SEASON)
def _(t):
    return C.seasonal_patterns(t.rc, t.now)


_FORECAST = f"""select (last + to_months(i::int))::date as join_month, {rnd('least(greatest(slope*(n-1+i)+icpt,0),100)', 2)} as churn_rate, true as is_forecast from
 (select regr_slope(churn_rate, x) slope, regr_intercept(churn_rate, x) icpt, count(*) n, max(join_month) last from (select *, row_number() over (order by join_month)-1 x from ({TREND}) t) p) f, range(1,4) r(i)"""


@query("A36_forecast_churn", _FORECAST)
def _(t):
    return C.forecast_churn(C.churn_trend(t.rc, t.now))


def _f1(e: str) -> str:
    return f"printf('%.1f', {rnd(e, 1)})"


@query("A37_trend_insight", f"""select concat('Over the last ', n, ' month(s), the churn rate ', case when abs(delta)<1 then 'has stayed roughly flat' when delta>0 then concat('has risen by ', printf('%+.2f',delta), ' percentage points')
 else concat('has fallen by ', printf('%+.2f',delta), ' percentage points') end, ' (', {_f1('fst')}, '% -> ', {_f1('lst')}, '%). The next 3 month(s) are forecast to be ', rates, '. ',
 'Calendar-month churn rates vary by ', {_f1('spread_pct_points')}, ' points between the highest (', highest_month, ', ', {_f1('highest_churn_rate')}, '%) and lowest (', lowest_month, ', ', {_f1('lowest_churn_rate')}, '%) months',
 case when is_seasonal then ' — a meaningful seasonal pattern.' else ', not a strong seasonal signal.' end) as insight
 from (select count(*) n, arg_min(churn_rate, join_month) fst, arg_max(churn_rate, join_month) lst, {rnd('arg_max(churn_rate, join_month)-arg_min(churn_rate, join_month)', 2)} delta from ({TREND}) t) a,
 (select string_agg({_f1('churn_rate')}||'%', ', ' order by join_month) rates from ({_FORECAST}) f) b, ({_SEASON}) c""")
def _(t):
    return C.trend_insight(t.rc, t.now)


_Y = "case when churn='Yes' then 1.0 else 0.0 end"
_CORR = " union all ".join([f"select '{c}' as feature, corr({c}, {_Y}) r from t_rc" for c in S.EDA_NUMERICS] + [
    f"select concat('{c}_', v), corr(case when {c}=v then 1.0 else 0.0 end, {_Y}) from t_rc cross join (select distinct {c} v from t_rc) l group by v" for c in K.CATEGORICAL_COLUMNS])


@query("A38_top_correlations", f"select feature, {rnd('r', 6)} as correlation from ({_CORR}) c where r is not null and not isnan(r) order by abs(correlation) desc, feature limit 10")
def _(t):
    return S.top_correlations(t.rc, 10)


@query("A39_corr_matrix", " union all ".join(f"select '{a}' as x, '{b}' as y, {rnd(f'corr({a},{b})', 6)} as r from t_rc" for a in K.NUMERIC_COLUMNS for b in K.NUMERIC_COLUMNS))
def _(t):
    return S.corr_matrix(t.rc, K.NUMERIC_COLUMNS)


@query("A39_point_biserial", " union all ".join(f"select '{c}' as feature, {rnd('r', 4)} as point_biserial_r, n, {rnd('r*sqrt((n-2)/(1-r*r))', 4)} as t_statistic from (select corr({c}, {_Y}) r, count(*) n from t_rc) s" for c in K.NUMERIC_COLUMNS))
def _(t):
    return S.point_biserial(t.rc)


def _integral(end: str) -> str:
    """Simpson's rule for cos(x)**(n-3) from 0 to `end`: the tail of t follows without a gamma function."""
    weight = "case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end"
    return f"list_sum(list_transform(range(0, 4001), lambda i: ({weight}) * pow(cos(i * ({end}) / 4000), n - 3))) * ({end})"


@query("A39_p_values", " union all ".join(f"select '{c}' as feature, n, {rnd('1 - ' + _integral('atan(abs(r) / sqrt(1 - r * r))') + ' / (' + _integral('pi() / 2') + ')', 9)} as p_value from (select corr({c}, {_Y}) r, count(*) n from t_rc) s" for c in K.NUMERIC_COLUMNS))
def _(t):
    return S.significance(t.rc).select("feature", "n", half_up(F.col("p_value"), 9).alias("p_value"))


def _hist(col: str, source: str, bins: int, by: str = "") -> str:
    return f"""select {by} bin, {rnd(f'lo+bin*((hi-lo)/{bins})', 6)} as bin_start, {rnd(f'lo+(bin+1)*((hi-lo)/{bins})', 6)} as bin_end, count(*) as n from
 (select s.*, lo, hi, least(floor(({col}-lo)*{bins}/(hi-lo)),{bins - 1})::int bin from {source} s, (select min({col})::double lo, max({col})::double hi from {source}) e) b group by {by} bin, lo, hi"""


@query("A43_histogram_probability", _hist("churn_probability", "t_cp", 30))
def _(t):
    return S.histogram(t.cp, "churn_probability")


@query("A43_histogram_by_churn", _hist("monthly_charges", "t_rc", 30, "churn,"))
def _(t):
    return S.histogram(t.rc, "monthly_charges", 30, ["churn"])


_Q = ", ".join(f"quantile_cont({{0}},{p}) {n}" for p, n in ((0.25, "a"), (0.5, "b"), (0.75, "c")))


@query("A44_box_stats_contract", f"""select contract, count(*) as n, {rnd('min(x)', 6)} as min, {rnd('a', 6)} as q1, {rnd('b', 6)} as median, {rnd('c', 6)} as q3, {rnd('max(x)', 6)} as max, {rnd('a-1.5::double*(c-a)', 6)} as lower_fence, {rnd('c+1.5::double*(c-a)', 6)} as upper_fence,
 count(*) filter (where x<a-1.5::double*(c-a) or x>c+1.5::double*(c-a)) as outliers from (select contract, churn_probability x from t_cp join (select customer_id, contract from t_rc) r using (customer_id)) j
 join (select contract, {_Q.format('churn_probability')} from t_cp join (select customer_id, contract from t_rc) r using (customer_id) group by 1) q using (contract) group by contract, a, b, c""")
def _(t):
    return S.box_stats(t.cp.select("customer_id", "churn_probability").join(t.rc.select("customer_id", "contract"), "customer_id"), "churn_probability", "contract")


@query("A44_box_stats_churn", f"""select churn, count(*) as n, {rnd('min(x)', 6)} as min, {rnd('a', 6)} as q1, {rnd('b', 6)} as median, {rnd('c', 6)} as q3, {rnd('max(x)', 6)} as max, {rnd('a-1.5::double*(c-a)', 6)} as lower_fence, {rnd('c+1.5::double*(c-a)', 6)} as upper_fence,
 count(*) filter (where x<a-1.5::double*(c-a) or x>c+1.5::double*(c-a)) as outliers from (select churn, total_charges x from t_rc) j
 join (select churn, {_Q.format('total_charges')} from t_rc group by 1) q using (churn) group by churn, a, b, c""")
def _(t):
    return S.box_stats(t.rc, "total_charges", "churn")
