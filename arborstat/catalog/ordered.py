"""Longitudinal and ordered operators (F1-F15, E1 aside) and nearest-visit joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborstat.catalog import query, r6
from arborstat.operators import branches as B, longitudinal as L, profiling as P

NEAR = "arg_min(struct_pack(v:=value,w:=week),(abs(week-{t}),week,row_id))"


@query("j07_nearest_visit", "visits", f", n as (select entity, {NEAR.format(t=0)} as s from visits group by 1) select entity, round(s.v,6) as value, s.w as week from n")
def _(t):
    return L.nearest_visit(t.visits, 0).select("entity", r6("value").alias("value"), "week")


@query("j08_nearest_visit_windowed", "visits", ", n as (select entity, arg_min(struct_pack(v:=value,w:=week),(not (week between 44 and 60),abs(week-52),week,row_id)) as s from visits group by 1) select entity, round(s.v,6) as value, s.w as week, s.w between 44 and 60 as in_window from n")
def _(t):
    return L.nearest_visit_windowed(t.visits, 52, 44, 60).select("entity", r6("value").alias("value"), "week", "in_window")


QUART = """, b as (select entity, arg_min(value,row_id) as baseline from visits where week between -5 and 10 group by 1),
v as (select visits.*, baseline from visits join b using (entity)),
q as (select *, greatest(1, ceil(4.0*(row_number() over (order by baseline,row_id)-1)/(count(*) over ()-1)))::int as quartile from v)"""


@query("f01_baseline_metric", "visits", """, b as (select entity, arg_min(value,row_id) as b from visits where week between -5 and 10 group by 1), a as (select entity, arg_min(value,row_id) as a from visits group by 1)
select entity, round(b,6) as baseline, round(a,6) as first_any from a left join b using (entity)""")
def _(t):
    b = L.baseline_metric(t.visits, "value")
    a = L.baseline_metric(t.visits, "value", None, "first_any")
    return a.join(b, "entity", "left").select("entity", r6("baseline").alias("baseline"), r6("first_any").alias("first_any"))


@query("f02_rank_quartile", "visits", QUART + "select entity, row_id, week, round(baseline,6) as baseline, quartile from q")
def _(t):
    return L.with_quartiles(t.visits).select("entity", "row_id", "week", r6("baseline").alias("baseline"), "quartile")


@query("f03_trajectories", "visits", QUART + "select quartile, week, round(avg(value),6) as mean, round(stddev_samp(value),6) as std, count(*) as n from q group by 1,2 having count(*)>=3")
def _(t):
    return L.trajectories(L.with_quartiles(t.visits)).select("quartile", "week", r6("mean").alias("mean"), r6("std").alias("std"), "n")


@query("f04_entity_slopes", "visits", """select entity, count(*) as n, round(regr_sxy(value,week)/nullif(regr_sxx(value,week),0),6) as slope,
 round(case when regr_syy(value,week)>0 then regr_sxy(value,week)*regr_sxy(value,week)/nullif(regr_sxx(value,week)*regr_syy(value,week),0) else 0 end,6) as r2 from visits group by 1 having count(*)>=2""")
def _(t):
    return L.entity_slopes(t.visits, ["entity"]).select("entity", "n", r6("slope").alias("slope"), r6("r2").alias("r2"))


DECLINE = QUART + """, s as (select quartile, entity, regr_sxy(value,week)/nullif(regr_sxx(value,week),0) as slope from q group by 1,2 having count(*)>=2),
d as (select quartile, avg(slope) as mean_decline, stddev_pop(slope) as std_decline, median(slope) as median_decline, count(*) as n_entities, count(*) filter (where slope<-0.5) as declining,
 count(*) filter (where slope between -0.5 and 0.5) as stable, count(*) filter (where slope>0.5) as improving from s where slope is not null group by 1),
dd as (select d.*, bm as baseline_mean from d join (select quartile, avg(baseline) as bm from q group by 1) using (quartile))"""


@query("f05_decline_summary", "visits", DECLINE + "select quartile, round(baseline_mean,6) as baseline_mean, round(mean_decline,6) as mean_decline, round(std_decline,6) as std_decline, round(median_decline,6) as median_decline, n_entities, declining, stable, improving from dd")
def _(t):
    d = L.decline_summary(L.with_quartiles(t.visits))
    return d.select("quartile", *[r6(c).alias(c) for c in ("baseline_mean", "mean_decline", "std_decline", "median_decline")], "n_entities", "declining", "stable", "improving")


@query("f06_progression_direction", "visits", DECLINE + """, m as (select max(mean_decline) filter (where quartile=1) as q1, max(mean_decline) filter (where quartile=4) as q4 from dd)
select round(q1,6) as q1, round(q4,6) as q4, case when q4<q1-0.3 then 'predictive' when q1<q4-0.3 then 'protective' else 'none' end as direction from m""")
def _(t):
    return L.direction_of_progression(L.decline_summary(L.with_quartiles(t.visits))).select(r6("q1").alias("q1"), r6("q4").alias("q4"), "direction")


def cascade(name: str, target: int, window: int, far: int) -> str:
    return f""", {name}a as (select entity, arg_min(struct_pack(v:=value,w:=week),(abs(week-{target}),week,row_id)) as s, min(abs(week-{target})) as d, count(*) filter (where abs(week-{target})<={window}) as nw, count(*) as n,
 min(week) as lo, max(week) as hi, avg(value) as m, regr_sxy(value,week)/nullif(regr_sxx(value,week),0) as sl, avg(value)-regr_sxy(value,week)/nullif(regr_sxx(value,week),0)*avg(week) as ic,
 abs(regr_sxy(value,week)/sqrt(nullif(regr_sxx(value,week)*regr_syy(value,week),0))) as r from visits group by 1),
{name}b as (select *, case when d<1 then 'exact' when d<={window} and d<={far} then 'nearest' when n>=2 and lo=hi then 'regression_simple' when n>=2 then case when {target}<lo or {target}>hi then 'extrapolation' else 'regression' end else 'failed' end as method,
 case when {target}<lo then lo-{target} when {target}>hi then {target}-hi else 0 end as gap from {name}a),
{name} as (select entity, method, case when method in ('exact','nearest') then s.v when method='regression_simple' then m when method='failed' then null else sl*{target}+ic end as value,
 case method when 'failed' then null when 'regression_simple' then lo else s.w end as actual_week,
 case method when 'exact' then 'high' when 'nearest' then case when d<=3 then 'high' when d<=8 then 'medium' else 'low' end when 'regression_simple' then case when d>20 then 'low' else 'medium' end
  when 'regression' then case when r>0.85 and n>=3 then 'high' when r>0.7 then 'medium' else 'low' end
  when 'extrapolation' then case when gap>15 then 'low' when gap>8 then 'medium' when r>0.8 and n>=3 then 'medium' else 'low' end else 'failed' end as quality,
 case method when 'exact' then 1 when 'nearest' then nw else n end as n_points, case method when 'failed' then null when 'regression' then gap when 'extrapolation' then gap else d end as distance from {name}b)"""


@query("f07_value_at_target", "visits", cascade("c", 52, 15, 10) + "select entity, method, quality, round(value,6) as value, actual_week, n_points, distance from c")
def _(t):
    return L.value_at_target(t.visits, 52, 15, 10).withColumn("value", r6("value"))


@query("f08_interpolated_targets", "visits cases", cascade("a", 0, 10, 8) + cascade("b", 52, 15, 10) + """, n as (select entity, count(*) as n from visits group by 1)
select a.entity, grp, round(a.value,6) as week0_value, a.actual_week as week0_actual_week, a.method as week0_method, a.quality as week0_quality, a.distance as week0_distance,
 round(b.value,6) as week52_value, b.actual_week as week52_actual_week, b.method as week52_method, b.quality as week52_quality, b.distance as week52_distance,
 round(a.value-b.value,6) as drop_absolute, round(case when a.value>0 then (a.value-b.value)/a.value*100 end,6) as drop_relative, n as n_measurements
 from a join b using (entity) join n using (entity) left join cases on case_id=entity""")
def _(t):
    demo = t.cases.select(F.col("case_id").alias("entity"), F.lit(0).alias("row_id"), "grp")
    f = L.interpolated_targets(t.visits, demo)
    return f.withColumns({c: r6(c) for c in ("week0_value", "week52_value", "drop_absolute", "drop_relative")})


DECAY = f""", n as (select entity, {NEAR.format(t=0)} as a, {NEAR.format(t=42)} as m, arg_min(struct_pack(v:=value,w:=week),(not (week between 44 and 60),abs(week-52),week,row_id)) as b from visits group by 1),
d as (select entity, a.v as av, a.w as aw, m.v as mv, m.w as mw, b.v as bv, b.w as bw from n where a.w between -5 and 10 and b.w between 42 and 62)"""


@query("f09_decay_table", "visits", DECAY + """select entity, round(av,6) as baseline_value, aw as baseline_week, round(mv,6) as week42_value, mw as week42_week, round(bv,6) as week52_value, bw as week52_week,
 round(av-bv,6) as drop_absolute, round(case when av>0 then (av-bv)/av*100 end,6) as drop_relative, round((bv-av)/nullif(av,0)*100,6) as change_percent,
 av-bv>5 as progressed_absolute, coalesce((av-bv)/nullif(av,0)*100>10,false) as progressed_relative, av-bv>5 and coalesce((av-bv)/nullif(av,0)*100>10,false) as progressed_combined from d""")
def _(t):
    d = L.decay_table(t.visits)
    return d.withColumns({c: r6(c) for c in ("baseline_value", "week42_value", "week52_value", "drop_absolute", "drop_relative", "change_percent")})


@query("f09_decay_summary", "visits", DECAY + "select entity, round(av,6) as baseline_value, round(mv,6) as week42_value, round(av-bv,6) as drop_1_year from d")
def _(t):
    return L.decay_summary(L.decay_table(t.visits)).withColumns({c: r6(c) for c in ("baseline_value", "week42_value", "drop_1_year")})


@query("f10_slice_uniformity", "slices", """, g as (select scan_id, abs(z-lag(z) over (partition by scan_id order by z)) as gap from slices),
a as (select scan_id, avg(gap) as m, coalesce(stddev_pop(gap),0) as s, coalesce(max(gap),0) as x from g group by 1)
select scan_id, not coalesce((m>0 and (s/m>0.10 or x>m*2)) or s>1,false) as is_uniform, round(s,6) as spacing_std, x::int as max_gap from a""")
def _(t):
    return P.slice_uniformity(t.slices).withColumn("spacing_std", r6("spacing_std"))


@query("f12_tapering_ratios", "branches", """, g as (select scan_id, generation, avg(diameter_mean_mm) as d from branches where generation is not null group by 1,2),
r as (select scan_id, generation as from_generation, lead(generation) over w as to_generation, lead(d) over w/d as ratio from g window w as (partition by scan_id order by generation))
select scan_id, from_generation, to_generation, round(ratio,6) as diameter_ratio from r where ratio is not null""")
def _(t):
    return B.tapering(t.branches).withColumn("diameter_ratio", r6("diameter_ratio"))


@query("f13_polyline_lengths", "points", """, s as (select scan_id, branch_id, sqrt(pow((x-lag(x) over w)*0.7,2)+pow((y-lag(y) over w)*0.7,2)+pow((z-lag(z) over w)*1.25,2)) as d from points window w as (partition by scan_id, branch_id order by seq))
select scan_id, branch_id, round(coalesce(sum(d),0),6) as length_mm, count(*) as num_points from s group by 1,2""")
def _(t):
    return B.polyline_lengths(t.points, (0.7, 0.7, 1.25)).withColumn("length_mm", r6("length_mm"))


@query("f14_trimmed_profile", "points", """, p as (select *, radius*2 as d, row_number() over (partition by scan_id,branch_id order by seq) as rn, count(*) over (partition by scan_id,branch_id) as n from points),
k as (select * from p where n<=10 or (rn>greatest(1,n*10//100) and rn<=n-greatest(1,n*10//100)))
select scan_id, branch_id, max(n) as num_points, round(case when max(n)>10 then quantile_cont(d,0.75) else avg(d) end,6) as diameter_mean_mm, round(stddev_pop(d),6) as diameter_std_mm, round(min(d),6) as diameter_min_mm,
 round(case when max(n)>10 then quantile_cont(d,0.95) else max(d) end,6) as diameter_max_mm from k group by 1,2""")
def _(t):
    p = B.trimmed_profile(t.points)
    return p.withColumns({c: r6(c) for c in p.columns if c.startswith("diameter")})


@query("f15_moving_average_spike", "", """, s as (select event_type, cast(ts as date) as day, count(*) as n from events group by 1,2),
i as (select *, row_number() over w-1 as idx, avg(n) over (partition by event_type order by day rows between current row and 4 following) as a, count(*) over (partition by event_type order by day rows between current row and 4 following)=5 as f from s window w as (partition by event_type order by day)),
d as (select event_type, idx, case when lead(f) over w then lead(a) over w-a end as st from i window w as (partition by event_type order by day)),
l as (select event_type, count(*) as n, avg(abs(st))+2*stddev_pop(st) as lim from d group by 1),
m as (select event_type, max(n) as n, min(idx) filter (where st>lim) as sp from d join l using (event_type) group by 1)
select event_type, sp is not null as found, cast(case when sp is not null then least(sp+5,n-1) else n//2 end as bigint) as index from m""")
def _(t):
    daily = t.raw("events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return L.moving_average_spike(daily, "event_type", "day", "n")
