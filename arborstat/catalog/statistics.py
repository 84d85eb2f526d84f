"""Correlation and model evaluation (H1-H17, F17) on case metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborstat.catalog import query, r6
from arborstat.catalog.ordered import DECLINE, cascade
from arborstat.operators import longitudinal as L, statistics as S
from arborstat.session import cut_lineage

FEATURES, TARGETS = ["m1", "m2", "m6"], ["m3", "m4"]
PAIRS = [(f, t) for f in FEATURES for t in TARGETS]

LONG = ", l as (" + " union all ".join(
    f"select case_id, '{f}' as feature, '{t}' as target, {f}::double as x, {t}::double/1000 as y from cases where {f} is not null and {t} is not null" for f, t in PAIRS
) + ")"
R = "regr_sxy({y},{x})/sqrt(nullif(regr_sxx({y},{x})*regr_syy({y},{x}),0))"


def cases(t):
    """Cases with targets in thousands."""
    return t.cases.withColumns({c: F.col(c) / 1000 for c in TARGETS})


def r_sql(y, x):
    return R.format(y=y, x=x)


def rounded(df, keys, cols):
    return df.select(*keys, *[r6(c).alias(c) for c in cols])


@query("h01_pearson_pairs", "cases", LONG + f"select feature, target, count(*) as n, round({r_sql('y', 'x')},6) as pearson_r from l group by 1,2")
def _(t):
    return S.pair_correlations(cases(t), FEATURES, TARGETS).select("feature", "target", "n", r6("pearson_r").alias("pearson_r"))


RANKS = LONG + """, k as (select feature, target, case_id, x, y, rank() over (partition by feature,target order by x)+(count(*) over (partition by feature,target,x)-1)/2.0::double as rx,
 rank() over (partition by feature,target order by y)+(count(*) over (partition by feature,target,y)-1)/2.0::double as ry from l)"""


@query("h02_spearman_pairs", "cases", RANKS + f"select feature, target, count(*) as n, round({r_sql('ry', 'rx')},6) as spearman_rho from k group by 1,2")
def _(t):
    return S.spearman(cases(t), "case_id", FEATURES, TARGETS).withColumn("spearman_rho", r6("spearman_rho"))


def p_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation: Simpson's rule over the null density of r, (1-u^2)^((n-4)/2)."""
    density = f"case when i in (0,20000) then 1 when i%2=1 then 4 else 2 end*pow(1-pow({{u}},2),({n}-4)/2.0::double)"
    tail, whole = (f"list_sum(list_transform(range(0,20001), lambda i: {density.format(u=u)}))" for u in (f"least(1,abs({r})+(1-abs({r}))*i/20000.0::double)", "i/20000.0::double"))
    return f"({tail}*(1-abs({r}))/{whole})"


def p_near_sql(r: str, n: str) -> str:
    """:func:`p_sql` for any n: the density is narrow for many rows, so the rule's steps cover 40 of its standard deviations, 1/sqrt(n), and not all up to 1."""
    density = f"case when i in (0,20000) then 1 when i%2=1 then 4 else 2 end*pow(1-pow({{u}},2),({n}-4)/2.0::double)"
    wide, end = f"least(1::double,40/sqrt({n}))", f"least(1::double,abs({r})+40/sqrt({n}))"
    tail, whole = (f"list_sum(list_transform(range(0,20001), lambda i: {density.format(u=u)}))" for u in (f"least(1,abs({r})+({end}-abs({r}))*i/20000.0::double)", f"{wide}*i/20000.0::double"))
    return f"({tail}*({end}-abs({r}))/({whole}*{wide}))"


# Simpson's rule over the null density of r, (1-u^2)^((n-4)/2), as far as 40 of its standard deviations.
P_SQL = LONG + f""", c as (select *, least(1::double,40/sqrt(n)) as b, least(1::double,a+40/sqrt(n)) as e from (select feature, target, count(*) as n, abs({r_sql('y', 'x')}) as a, {r_sql('y', 'x')} as r from l group by 1,2)),
 g as (select i, case when i in (0,20000) then 1 when i%2=1 then 4 else 2 end as w from range(0,20001) t(i)),
 q as (select feature, target, any_value(n) as n, any_value(r) as r, sum(w*pow(1-pow(least(1,a+(e-a)*i/20000.0::double),2),(n-4)/2.0::double))*any_value(e-a) as tail, sum(w*pow(1-pow(b*i/20000.0::double,2),(n-4)/2.0::double))*any_value(b) as whole from c, g group by 1,2)"""


@query("h03_p_values", "cases", P_SQL + RANKS.removeprefix(LONG) + f""", rho as (select feature, target, count(*) as nn, {r_sql('ry', 'rx')} as rho from k group by 1,2)
select feature, target, n, round(r,6) as pearson_r, round(tail/whole,6) as p_value, round(rho,6) as spearman_rho, round({p_near_sql('rho', 'nn')},6) as spearman_p from q join rho using (feature,target)""")
def _(t):
    c = S.with_p_values(S.pair_correlations(cases(t), FEATURES, TARGETS), "pearson_r", "n")
    s = S.with_p_values(S.spearman(cases(t), "case_id", FEATURES, TARGETS), "spearman_rho", "n", "spearman_p").drop("n")
    return rounded(c.join(s, ["feature", "target"]), ["feature", "target", "n"], ["pearson_r", "p_value", "spearman_rho", "spearman_p"])


@query("h04_regression_lines", "cases", LONG + "select feature, target, round(regr_sxy(y,x)/nullif(regr_sxx(y,x),0),6) as slope, round(avg(y)-regr_sxy(y,x)/nullif(regr_sxx(y,x),0)*avg(x),6) as intercept from l group by 1,2")
def _(t):
    return rounded(S.pair_correlations(cases(t), FEATURES, TARGETS), ["feature", "target"], ["slope", "intercept"])


SENS = """, u as (select 'm1' as metric, case_id%4=0 as s, m1 as x, m3 as y from cases where m1 is not null and m3 is not null union all select 'm6', case_id%4=0, m6, m3 from cases where m6 is not null and m3 is not null),
 g as (select metric, count(*) as n_all, count(*) filter (where not s) as n_original, count(*) filter (where s) as n_smoothed, """ + r_sql("y", "x") + " as ra, " + \
    r_sql("case when not s then y end", "case when not s then x end") + " as ro, " + r_sql("case when s then y end", "case when s then x end") + " as rs from u group by 1)"


def sensitivity(t):
    return S.sensitivity(t.cases.withColumn("is_smoothed", F.col("case_id") % 4 == 0), "is_smoothed", ["m1", "m6"], "m3")


@query("h05_sensitivity_split", "cases", SENS + "select metric, n_all, n_original, n_smoothed, round(ra,6) as r_all, round(ro,6) as r_original, round(rs,6) as r_smoothed, round(abs(ra-ro),6) as delta_r from g")
def _(t):
    return rounded(sensitivity(t), ["metric", "n_all", "n_original", "n_smoothed"], ["r_all", "r_original", "r_smoothed", "delta_r"])


@query("h05_sensitivity_class", "cases", SENS + "select round(max(abs(ra-ro)),6) as max_delta, round(avg(abs(ra-ro)),6) as mean_delta, case when max(abs(ra-ro))<0.1 then 'minimal' when max(abs(ra-ro))<0.2 then 'moderate' else 'strong' end as impact from g")
def _(t):
    return rounded(S.sensitivity_class(sensitivity(t)), ["impact"], ["max_delta", "mean_delta"])


@query("h06_metric_type_comparison", "cases", LONG + f""", c as (select feature, target, {r_sql('y', 'x')} as r, count(*) as n from l group by 1,2), d as (select case feature when 'm1' then 'core' when 'm6' then 'core' else 'other' end as type, feature, abs(r) as a, {p_sql('r', 'n')} as p from c),
 g as (select type, count(*) as n_metrics, count(*) filter (where p<0.05) as n_significant, avg(a) as ma, max(a) as xa, arg_max(feature,(a,feature)) as best_metric from d group by 1)
select type, n_metrics, n_significant, round(ma,6) as mean_abs_r, round(xa,6) as max_abs_r, best_metric, row_number() over (order by ma desc, type)::int as rank from g""")
def _(t):
    c = S.with_p_values(S.pair_correlations(cases(t), FEATURES, TARGETS), "pearson_r", "n")
    g = S.compare_metric_types(c, {"m1": "core", "m6": "core", "m2": "other"})
    return rounded(g, ["type", "n_metrics", "n_significant", "best_metric", "rank"], ["mean_abs_r", "max_abs_r"])


@query("h07_quartile_correlation", "visits", DECLINE + f", qr as (select count(*) as n, {r_sql('mean_decline', 'baseline_mean')} as r from dd having count(*)>=4) select n, round(r,6) as r, round({p_sql('r', 'n')},6) as p_value from qr")
def _(t):
    return rounded(S.quartile_correlation(L.decline_summary(L.with_quartiles(t.visits))), ["n"], ["r", "p_value"])


LOO = LONG + """, m as (select feature, target, count(*) as n, avg(x) as mx, avg(y) as my, regr_sxx(y,x) as sxx, regr_sxy(y,x) as sxy from l group by 1,2 having count(*)>=10),
 p as (select case_id, feature, target, 'linear' as model, n, x, y as actual, y-(y-my-sxy/sxx*(x-mx))/(1-(1.0::double/n+(x-mx)*(x-mx)/sxx)) as predicted from l join m using (feature,target))"""


def pairs(t):
    return S.long_pairs(cases(t), "case_id", FEATURES, TARGETS)


@query("h08_leave_one_out_linear", "cases", LOO + "select case_id, feature, target, model, n, round(x,6) as x, round(actual,6) as actual, round(predicted,6) as predicted from p")
def _(t):
    return rounded(S.leave_one_out_linear(pairs(t)), ["case_id", "feature", "target", "model", "n"], ["x", "actual", "predicted"])


# Gram-Schmidt on the rows themselves, one power at a time.
POLY = LONG + """, s0 as (select feature, target, avg(x) as mx, stddev_pop(x) as sx, count(*) as n from l group by 1,2), z as (select case_id, feature, target, n, x, y, (x-mx)/sx as z from l join s0 using (feature,target)),
 g1 as (select feature, target, avg(z*z*z) as c1, avg(z*z) as c0 from z group by 1,2), z2 as (select z.*, z*z-c1*z-c0 as u from z join g1 using (feature,target)),
 g2 as (select feature, target, sum(z*z*z*u)/sum(u*u) as d2, avg(z*z*z*z) as d1, avg(z*z*z) as d0 from z2 group by 1,2), z3 as (select z2.*, z*z*z-d2*u-d1*z-d0 as v from z2 join g2 using (feature,target)),
 c as (select feature, target, avg(y) as b0, sum(y*z)/sum(z*z) as b1, sum(y*u)/sum(u*u) as b2, sum(y*v)/sum(v*v) as b3, sum(z*z) as n1, sum(u*u) as n2, sum(v*v) as n3 from z3 group by 1,2),
 f as (select z3.*, b0+b1*z as f1, 1.0::double/n+z*z/n1 as h1, b2*u as e2, u*u/n2 as k2, b3*v as e3, v*v/n3 as k3 from z3 join c using (feature,target)),
 pp as (select case_id, feature, target, n, x, y as actual, 'linear' as model, y-(y-f1)/(1-h1) as predicted from f union all select case_id, feature, target, n, x, y, 'poly2', y-(y-f1-e2)/(1-h1-k2) from f
  union all select case_id, feature, target, n, x, y, 'poly3', y-(y-f1-e2-e3)/(1-h1-k2-k3) from f)"""


@query("h09_leave_one_out_polynomial", "cases", POLY + "select case_id, feature, target, model, n, round(x,6) as x, round(actual,6) as actual, round(predicted,6) as predicted from pp where model<>'linear'")
def _(t):
    return rounded(S.leave_one_out(pairs(t), ["poly2", "poly3"]), ["case_id", "feature", "target", "model", "n"], ["x", "actual", "predicted"])


ERR = LOO + """, e as (select feature, target, model, count(*) as n, avg((predicted-actual)*(predicted-actual)) as mse, avg(abs(predicted-actual)) as mae, 1-sum((predicted-actual)*(predicted-actual))/nullif(regr_syy(actual,predicted),0) as r2,
 avg(case when target='m3' then abs(predicted-actual)/nullif(actual,0)*100 else abs(predicted-actual) end) as mape, """ + r_sql("predicted", "actual") + " as r from p group by 1,2,3)"


ERR_RANKS = """, kp as (select feature, target, model, rank() over (partition by feature,target,model order by predicted)+(count(*) over (partition by feature,target,model,predicted)-1)/2.0::double as rx,
 rank() over (partition by feature,target,model order by actual)+(count(*) over (partition by feature,target,model,actual)-1)/2.0::double as ry from p), er as (select feature, target, model, """ + r_sql("ry", "rx") + " as rho from kp group by 1,2,3)"


@query("h10_error_metrics", "cases", ERR + ERR_RANKS + f"""select feature, target, model, n, round(mse,6) as mse, round(mae,6) as mae, round(sqrt(mse),6) as rmse, round(r2,6) as r2, round(mape,6) as mape, round(r,6) as pearson_r,
 round({p_sql('r', 'n')},6) as pearson_p, round(rho,6) as spearman_rho, round({p_sql('rho', 'n')},6) as spearman_p from e join er using (feature,target,model)""")
def _(t):
    by = ["feature", "target", "model"]
    predicted = cut_lineage(S.leave_one_out_linear(pairs(t)).select(*by, "predicted", "actual"))
    m = S.with_rank_correlation(S.error_metrics(predicted, by, ["m3"]), predicted, by)
    return rounded(m, ["feature", "target", "model", "n"], ["mse", "mae", "rmse", "r2", "mape", "pearson_r", "pearson_p", "spearman_rho", "spearman_p"])


def grid(t):
    return S.error_metrics(S.leave_one_out(pairs(t)), ["feature", "target", "model"], ["m3"])


GRID = POLY + """, e as (select feature, target, model, count(*) as n, avg(abs(predicted-actual)) as mae, sqrt(avg((predicted-actual)*(predicted-actual))) as rmse, 1-sum((predicted-actual)*(predicted-actual))/nullif(regr_syy(actual,predicted),0) as r2, """ + r_sql("predicted", "actual") + " as r from pp group by 1,2,3)"
GRID_COLS = "feature, target, model, n, round(mae,6) as mae, round(rmse,6) as rmse, round(r2,6) as r2, round(r,6) as pearson_r"


@query("h11_model_grid", "cases", GRID + f"select {GRID_COLS} from e")
def _(t):
    return rounded(grid(t), ["feature", "target", "model", "n"], ["mae", "rmse", "r2", "pearson_r"])


@query("h12_summary_table", "cases", GRID + f", k as (select *, row_number() over (partition by feature,target order by r2 desc, model) as rn from e) select 'all' as kind, {GRID_COLS} from e union all select 'best', {GRID_COLS} from k where rn=1")
def _(t):
    return rounded(S.summary_table(grid(t)), ["kind", "feature", "target", "model", "n"], ["mae", "rmse", "r2", "pearson_r"])


@query("f17_best_model", "cases", GRID + f", k as (select *, row_number() over (partition by feature,target order by r2 desc, model) as rn from e) select {GRID_COLS} from k where rn=1")
def _(t):
    return rounded(S.best_models(grid(t)), ["feature", "target", "model", "n"], ["mae", "rmse", "r2", "pearson_r"])


@query("h13_bland_altman", "cases", LOO + """, d as (select feature, target, count(*) as n, avg(actual-predicted) as b, stddev_pop(actual-predicted) as s from p group by 1,2)
select feature, target, n, round(b,6) as bias, round(s,6) as sd, round(b-1.96*s,6) as lower, round(b+1.96*s,6) as upper from d""")
def _(t):
    return rounded(S.bland_altman(S.leave_one_out_linear(pairs(t)), "actual", "predicted", ["feature", "target"]), ["feature", "target", "n"], ["bias", "sd", "lower", "upper"])


@query("h13_agreement_points", "cases", LOO + "select case_id, feature, target, round((actual+predicted)/2,6) as mean, round(actual-predicted,6) as difference from p")
def _(t):
    return rounded(S.agreement_points(S.leave_one_out_linear(pairs(t)), "actual", "predicted"), ["case_id", "feature", "target"], ["mean", "difference"])


QUAL = cascade("a", 0, 10, 8) + cascade("b", 52, 15, 10)


@query("h14_quality_filter", "visits", QUAL + "select a.entity, a.quality as week0_quality, b.quality as week52_quality from a join b using (entity) where a.quality in ('high','medium') and b.quality in ('high','medium')")
def _(t):
    return S.quality_filter(L.interpolated_targets(t.visits), ["week0_quality", "week52_quality"]).select("entity", "week0_quality", "week52_quality")


@query("h15_feature_ranking", "cases", ERR + "select feature, round(avg(r2),6) as mean_r2 from e group by 1 order by avg(r2) desc, feature limit 5")
def _(t):
    return rounded(S.feature_ranking(S.error_metrics(S.leave_one_out_linear(pairs(t)), ["feature", "target", "model"])), ["feature"], ["mean_r2"])


@query("h16_cohort_statistics", "visits", QUAL + """, d as (select a.value as v0, b.value as v1, a.value-b.value as dr from a join b using (entity))
select count(*) as n, round(avg(v0),6) as week0_value_mean, round(stddev_samp(v0),6) as week0_value_std, round(avg(v1),6) as week52_value_mean, round(stddev_samp(v1),6) as week52_value_std,
 count(*) filter (where dr>5) as n_progressed, round(avg(dr) filter (where dr>5),6) as progressed_mean_drop, round(100*(count(*) filter (where dr>5))::double/count(*),6) as progressed_share from d""")
def _(t):
    s = S.cohort_statistics(L.interpolated_targets(t.visits), ["week0_value", "week52_value"], "drop_absolute")
    return rounded(s, ["n", "n_progressed"], [c for c in s.columns if c not in ("n", "n_progressed")])


@query("h17_error_histogram", "cases", LOO + """, e as (select feature, target, predicted-actual as e from p), s as (select feature, target, min(e) as lo, max(e) as hi from e group by 1,2)
select feature, target, least(floor((e-lo)/(hi-lo)*20),19)::int as bin, count(*) as n from e join s using (feature,target) group by 1,2,3""")
def _(t):
    e = S.leave_one_out_linear(pairs(t)).withColumn("error", F.col("predicted") - F.col("actual"))
    return S.error_histogram(e, "error", ["feature", "target"])
