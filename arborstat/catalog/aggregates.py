"""Branch, generation and dataset aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborstat.catalog import query, r2, r6
from arborstat.catalog.rules import ISSUE_SQL, REASON_SQL, with_issues
from arborstat.functions.numeric import dbl
from arborstat.operators import branches as B, longitudinal, profiling as P

GEO = ", g as (select *, pi()*diameter_mean_mm*diameter_mean_mm/4*length_mm as vol, pi()*diameter_mean_mm*length_mm as area from branches)"
REGION = GEO + """, r as (select scan_id, coalesce(sum(vol) filter (where generation<=7),0) as cv, count(*) filter (where generation<=7) as cn,
 coalesce(sum(vol) filter (where generation>7 and generation<=10),0) as iv, count(*) filter (where generation>7 and generation<=10) as inn,
 coalesce(sum(vol) filter (where generation>10),0) as pv, count(*) filter (where generation>10) as pn from g group by 1)"""
PERI = GEO + """, p as (select scan_id, count(*) filter (where generation>10) as n, coalesce(sum(vol) filter (where generation>10),0) as v, sum(vol) filter (where generation is not null) as tot,
 avg(diameter_mean_mm) filter (where generation>10) as pd, median(diameter_mean_mm) filter (where generation>10) as pmd, stddev_samp(diameter_mean_mm) filter (where generation>10) as psd,
 avg(vol) filter (where generation>10) as pbv, median(vol) filter (where generation>10) as pmbv, avg(diameter_mean_mm) filter (where generation<=7) as cd from g group by 1)"""


def rounded(df, keys, cols):
    return df.select(*keys, *[r6(c).alias(c) for c in cols])


@query("e01_visit_ranges", "visits", "select count(*) as n_rows, count(distinct entity) as n_entities, min(week) as min_week, max(week) as max_week, median(week)::double as median_week from visits")
def _(t):
    return P.visit_ranges(t.visits)


@query("e05_generation_stats", "branches", GEO + """select scan_id, generation, count(*) as n_branches, round(avg(diameter_mean_mm),6) as diameter_mean_mm, round(stddev_samp(diameter_mean_mm),6) as diameter_std_mm,
 round(median(diameter_mean_mm),6) as diameter_median_mm, round(min(diameter_mean_mm),6) as diameter_min_mm, round(max(diameter_mean_mm),6) as diameter_max_mm, round(avg(length_mm),6) as length_mean_mm,
 round(stddev_samp(length_mm),6) as length_std_mm, round(median(length_mm),6) as length_median_mm, round(sum(vol),6) as total_volume_mm3, round(sum(area),6) as total_surface_area_mm2
 from g where generation is not null group by 1,2""")
def _(t):
    s = B.generation_stats(t.branches)
    return rounded(s, ["scan_id", "generation", "n_branches"], [c for c in s.columns if c.endswith(("mm", "mm2", "mm3"))])


@query("e06_volume_by_generation", "branches", GEO + """, v as (select scan_id, generation, sum(vol) as volume_mm3 from g where generation is not null group by 1,2)
select scan_id, generation, round(volume_mm3,6) as volume_mm3, round(sum(volume_mm3) over (partition by scan_id),6) as total_volume_mm3 from v""")
def _(t):
    return rounded(B.volume_by_generation(t.branches), ["scan_id", "generation"], ["volume_mm3", "total_volume_mm3"])


@query("e07_generation_coverage", "branches", """, b as (select scan_id, generation from branches where generation is not null),
s as (select scan_id, min(generation) as lo, max(generation) as hi, count(distinct generation) as n, list(distinct generation) as have from b group by 1)
select scan_id, n as n_present, round(n::double/(hi-lo+1),6) as generation_coverage, coalesce(array_to_string(list_sort(list_filter(range(lo,hi+1), lambda x: not list_contains(have,x::int))),','),'') as missing from s""")
def _(t):
    c = B.generation_coverage(t.branches.where("generation is not null"))
    return c.select("scan_id", "n_present", r6("generation_coverage").alias("generation_coverage"), F.concat_ws(",", F.transform("missing_generations", lambda x: x.cast("string"))).alias("missing"))


REGION_COLS = "round(cv,6) as central_volume_mm3, cn as central_branch_count, round(iv,6) as intermediate_volume_mm3, inn as intermediate_branch_count, round(pv,6) as peripheral_volume_mm3, pn as peripheral_branch_count, round(case when cv>0 then pv/cv else 0 end,6) as peripheral_to_central_ratio, round(case when cn>0 then pn/cn else 0 end,6) as peripheral_to_central_branch_ratio"


@query("e08_region_rollup", "branches", REGION + f"select scan_id, {REGION_COLS} from r")
def _(t):
    s = B.region_rollup(t.branches)
    return rounded(s, ["scan_id", *[c for c in s.columns if c.endswith("count")]], [c for c in s.columns if c.endswith(("mm3", "ratio"))])


PERI_COLS = """round(case when tot>0 then v/tot*100 else 0 end,6) as peripheral_volume_percent, round(pd,6) as mean_peripheral_diameter_mm, round(pmd,6) as median_peripheral_diameter_mm, round(psd,6) as std_peripheral_diameter_mm,
 round(pbv,6) as mean_peripheral_branch_volume_mm3, round(pmbv,6) as median_peripheral_branch_volume_mm3, round(case when v>0 then n/v else 0 end,6) as peripheral_branch_density,
 round(case when pd is not null then cd end,6) as mean_central_diameter_mm, round(case when pd>0 then cd/pd end,6) as central_to_peripheral_diameter_ratio"""


@query("e09_peripheral_stats", "branches", PERI + f"select scan_id, {PERI_COLS} from p")
def _(t):
    s = B.peripheral_stats(t.branches)
    return rounded(s, ["scan_id"], [c for c in s.columns if c != "scan_id"])


@query("e10_diameter_variation", "branches", "select scan_id, round(avg(diameter_mean_mm),6) as diameter_mean_all, round(stddev_samp(diameter_mean_mm),6) as diameter_std_all, round(stddev_samp(diameter_mean_mm)/avg(diameter_mean_mm),6) as diameter_cv from branches group by 1")
def _(t):
    return rounded(B.diameter_variation(t.branches), ["scan_id"], ["diameter_mean_all", "diameter_std_all", "diameter_cv"])


@query("e11_tortuosity_summary", "edges nodes", """, j as (select e.branch_id%10 as grp, e.length/20 as length, sqrt((a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) as d from edges e join nodes a on a.node=e.src join nodes b on b.node=e.dst),
 q as (select grp, length*20/d as t from j where d>0.5 and length*20/d>0.8 and length*20/d<5)
select count(*) as n_tortuosity, round(avg(t),6) as mean_tortuosity, round(median(t),6) as median_tortuosity, round(stddev_pop(t),6) as std_tortuosity from q""")
def _(t):
    one = F.lit(1).alias("scan_id")
    s = B.tortuosity_summary(t.edges.select("*", one), t.nodes.select("*", one), ["scan_id"])
    return rounded(s, ["n_tortuosity"], ["mean_tortuosity", "median_tortuosity", "std_tortuosity"])


@query("e12_metric_vector", "branches", REGION.replace(", r as", ", r0 as") .replace("r0 as", "r as") + PERI.replace(GEO, "") + """, t as (select scan_id, sum(vol) filter (where generation is not null) as tv, avg(diameter_mean_mm/nullif(length_mm,0)) as dl,
 stddev_samp(diameter_mean_mm)/avg(diameter_mean_mm) as cv_all, count(distinct generation)::double/(max(generation)-min(generation)+1) as cov, avg(diameter_mean_mm) as dma, stddev_samp(diameter_mean_mm) as dsa,
 min(generation) as lo, max(generation) as hi, list(distinct generation) filter (where generation is not null) as have from g group by 1)
select scan_id, round(dma,6) as diameter_mean_all, round(dsa,6) as diameter_std_all, coalesce(array_to_string(list_sort(list_filter(range(lo,hi+1), lambda x: not list_contains(have,x::int))),','),'') as missing_generations, round(tv,6) as total_volume_mm3, round(dl,6) as mean_diameter_to_length_ratio, round(cov,6) as generation_coverage, round(cv_all,6) as diameter_cv, """ + REGION_COLS + ", " + PERI_COLS + " from t join r using (scan_id) join p using (scan_id)")
def _(t):
    v = B.metric_vector(t.branches)
    ints = [c for c in v.columns if c.endswith("count")]
    v = v.withColumn("missing_generations", F.concat_ws(",", F.transform("missing_generations", lambda x: x.cast("string"))))
    keys = ["scan_id", "missing_generations", *ints]
    return rounded(v, keys, [c for c in v.columns if c not in keys])


@query("e13_region_breakdown", "branches", REGION + """select scan_id, 'central' as region, round(cv,6) as volume_mm3, cn as branch_count from r union all select scan_id, 'intermediate', round(iv,6), inn from r union all select scan_id, 'peripheral', round(pv,6), pn from r""")
def _(t):
    return rounded(B.region_breakdown(B.region_rollup(t.branches)), ["scan_id", "region", "branch_count"], ["volume_mm3"])


@query("e23_best_method", "runs", """, u as (select run, 'total_branches' as metric, total_branches::double as v from runs union all select run, 'volume', volume from runs union all select run, 'pc_ratio', pc_ratio from runs),
m as (select metric, run, avg(v) as mean from u group by 1,2), k as (select *, row_number() over (partition by metric order by case when metric='volume' then mean else -mean end, run) as rn from m)
select metric, run as best_method, round(mean,6) as best_mean from k where rn=1""")
def _(t):
    _, best = P.best_method(t.runs, "run", {"total_branches": False, "volume": True, "pc_ratio": False})
    return best.select("metric", "best_method", r6("best_mean").alias("best_mean"))


@query("e24_dataset_statistics", "scans", "select count(*) as n_scans, " + ", ".join(
    f"round(avg({c}),6) as {c}_mean, round(stddev_pop({c}),6) as {c}_std, round(min({c}),6) as {c}_min, round(max({c}),6) as {c}_max, "
    f"printf('%.0f-%.0f',min({c})::double,max({c})::double) as {c}_range" for c in ("num_slices", "slice_thickness", "xy_resolution", "num_slices_mm")
) + " from (select *, num_slices*slice_thickness as num_slices_mm from scans)")
def _(t):
    cols = ["num_slices", "slice_thickness", "xy_resolution", "num_slices_mm"]
    s = P.dataset_statistics(P.physical_size(t.scans, ["num_slices"], ["slice_thickness"]), cols)
    return s.select("n_scans", *[r6(f"{c}_{k}").alias(f"{c}_{k}") for c in cols for k in ("mean", "std", "min", "max")], *[f"{c}_range" for c in cols])


@query("e25_consistency", "scans", """, u as (select 'pixel_type' as c, pixel_type as v from scans union all select 'kernel', kernel from scans union all select 'xy', cast(num_slices as varchar) from scans union all select 'unit', 'mm' from scans),
n as (select c, v, count(*) as n from u group by 1,2), k as (select *, row_number() over (partition by c order by n desc, v) as rn, count(*) over (partition by c) as nv from n)
select c as "column", v as mode, nv as n_variants, nv=1 as consistent from k where rn=1""")
def _(t):
    s = t.scans.select("pixel_type", "kernel", F.col("num_slices").alias("xy"), F.lit("mm").alias("unit"))
    return P.consistency(s, ["pixel_type", "kernel", "xy", "unit"])


COHORT_SQL = """, c as (select *, num_slices<700 as good, num_slices*slice_thickness as extent from scans),
 u as (select good, 'slice_thickness' as metric, true as prob, slice_thickness as v from c union all select good, 'xy_resolution', true, xy_resolution from c union all select good, 'extent', false, extent from c),
 m as (select metric, prob, avg(v) filter (where good) as g, avg(v) filter (where not good) as b, stddev_samp(v) filter (where good) as gs, stddev_samp(v) filter (where not good) as bs from u group by 1,2),
 d as (select *, case when g=0 then 0 else abs(b-g)/g*100 end as diff from m)"""


@query("e26_cohort_comparison", "scans", COHORT_SQL + """select metric, prob as is_problem, round(g,6) as good_mean, round(gs,6) as good_std, round(b,6) as bad_mean, round(bs,6) as bad_std, round(diff,6) as diff_pct,
 case when prob and b>g*1.5 then 'CRITICAL' when diff>30 then 'WARNING' else 'OK' end as flag from d""")
def _(t):
    s = t.scans.withColumn("extent", F.col("num_slices") * F.col("slice_thickness"))
    c = P.compare_cohorts(s, F.col("num_slices") < 700, {"slice_thickness": True, "xy_resolution": True, "extent": False})
    return rounded(c, ["metric", "is_problem", "flag"], ["good_mean", "good_std", "bad_mean", "bad_std", "diff_pct"])


@query("b20_recommendations", "scans", """, m as (select avg(num_slices) filter (where good) as gt, avg(num_slices) filter (where not good) as bt, avg(slice_thickness) filter (where good) as gc, avg(slice_thickness) filter (where not good) as bc,
 avg(xy_resolution) filter (where good) as gb, avg(xy_resolution) filter (where not good) as bb, avg(scan_id%5) filter (where not good) as bg from (select *, num_slices<700 as good from scans))
select concat_ws(';', case when bt>gt*1.3 then 'SLICE THICKNESS' end, case when bc>gc+2 then 'FRAGMENTATION' end, case when bb>gb*2 then 'HU THRESHOLD' end, case when bg>1 then 'TRACHEA GAPS' end) as recommendations from m""")
def _(t):
    s = t.scans.withColumn("gaps", F.col("scan_id") % 5)
    r = P.recommendations(s, F.col("num_slices") < 700, "num_slices", "slice_thickness", "xy_resolution", "gaps")
    return r.select(F.concat_ws(";", "recommendations").alias("recommendations"))


TAG_SQL = """, n as (select count(distinct patient_id) as n from tags), p as (select tag, count(distinct patient_id) as np, count(distinct value) as nv, min(value) as fv from tags group by 1),
 tp as (select tag, np as n_patients, nv as n_values, case when np=n then 'common' when np>=n*0.5 then 'partial' else 'rare' end as presence, nv=1 as is_constant, case when nv=1 then fv end as constant_value from p, n)"""


@query("e27_tag_profile", "tags", TAG_SQL + "select * from tp")
def _(t):
    return P.tag_profile(t.tags)


@query("e27_tag_values", "tags", "select tag, value, count(distinct patient_id) as n_patients from tags group by 1,2")
def _(t):
    return P.tag_values(t.tags)


@query("e28_funnel", "scans", ISSUE_SQL + """, f as (select n_issues=0 as c, scan_id%7<>0 as v, scan_id%5<>0 as k from b)
select count(*) as total, count(*) filter (where c) as compatible, count(*) filter (where c and k) as converted, count(*) filter (where c and k and v) as validated,
 round(count(*) filter (where c and k and v)::double/greatest(count(*),1)*100,6) as success_rate from f""")
def _(t):
    f = P.funnel(with_issues(t), F.size("issues") == 0, F.col("scan_id") % 5 != 0, F.col("scan_id") % 7 != 0)
    return f.withColumn("success_rate", r6("success_rate"))


@query("e29_reason_histogram", "scans", REASON_SQL + "select reason, count(*) as n from r group by 1")
def _(t):
    return P.reason_histogram(with_issues(t))


@query("e30_distribution_by_flag", "scans", ISSUE_SQL + """, u as (select n_issues=0 as c, 'num_slices' as metric, num_slices::double as v from b union all select n_issues=0, 'slice_thickness', slice_thickness from b union all select n_issues=0, 'xy_resolution', xy_resolution from b),
 w as (select metric, v, case when c then 'Compatible' else 'Incompatible' end as cohort from u union all select metric, v, 'All' from u)
select metric, cohort, count(*) as n, round(avg(v),6) as mean, round(median(v),6) as median, round(stddev_samp(v),6) as std from w group by 1,2""")
def _(t):
    s = with_issues(t).withColumn("compatible", F.size("issues") == 0)
    return rounded(P.distribution_by_flag(s, "compatible", ["num_slices", "slice_thickness", "xy_resolution"]), ["metric", "cohort", "n"], ["mean", "median", "std"])


@query("e32_visit_union", "visits", "select entity, row_id, week from visits where row_id%2=0 union all select entity, row_id, week from visits")
def _(t):
    v = t.visits.select("entity", "row_id", "week")
    return v.where("row_id % 2 = 0").unionByName(v)


@query("e33_fixed_width_histogram", "scans", ISSUE_SQL + "select floor(num_slices/50.0::double)::bigint as bin, n_issues=0 as compatible, count(*) as n from b group by 1,2")
def _(t):
    return P.fixed_width_histogram(with_issues(t).withColumn("compatible", F.size("issues") == 0), "num_slices", 50.0, "compatible")


@query("e34_scan_summary", "branches", GEO + """, s as (select scan_id, count(*) as n_branches, avg(diameter_mean_mm) as a, min(diameter_mean_mm) as mi, max(diameter_mean_mm) as ma, avg(length_mm) as l, sum(length_mm) as sl, sum(vol) as v, max(generation) as max_generation, count(distinct generation) as n_generations from g group by 1),
 d as (select scan_id, generation, avg(diameter_mean_mm) as d from g where generation is not null group by 1,2), w as (select scan_id, lead(d) over (partition by scan_id order by generation)/d as r from d), k as (select scan_id, avg(r) as r from w group by 1)
select scan_id, n_branches, round(a,6) as mean_diameter_mm, round(mi,6) as min_diameter_mm, round(ma,6) as max_diameter_mm, round(l,6) as mean_length_mm, round(sl,6) as total_length_mm, round(v,6) as total_volume_mm3, max_generation, n_generations, round(r,6) as mean_tapering from s join k using (scan_id)""")
def _(t):
    s = B.scan_summary(t.branches)
    ints = ["scan_id", "n_branches", "max_generation", "n_generations"]
    return rounded(s, ints, [c for c in s.columns if c not in ints])


@query("f16_top_rare_tags", "tags", TAG_SQL + ", k as (select *, row_number() over (partition by presence order by n_patients desc, tag) as rank from tp) select presence, tag, n_patients, rank::int as rank from k where rank<=10")
def _(t):
    p = P.tag_profile(t.tags)
    return P.top_k(p, "presence", [F.desc("n_patients"), F.asc("tag")], 10).select("presence", "tag", "n_patients", "rank")


@query("b19_recalibration", "voxels", """, s as (select scan_id, avg(hu) as m, (min(hu)-(scan_id%4)*60)::double as air, 100.0*count(*) filter (where hu between -900 and -300)/count(*) as lung, (max(hu)-min(hu))::double as rg, quantile_cont(hu,0.01) as p01 from voxels group by 1),
 o as (select *, least(greatest(-650-m,-500::double),500::double) as off, least(greatest(case when abs(air+950)>100 then coalesce(-950/nullif(air,0),1) else 1 end,0.8::double),1.25::double) as sc from s),
 n as (select *, m*sc+off as nm, air*sc+off as na from o),
 d as (select *, case when not (air<=-500 and lung>=0.1 and rg between 500 and 6000 and p01<=-500) then 'invalid_structure' when not (abs(m+650)>2.5*30 or abs(air+950)>200) then 'acceptable'
  when not (nm between -900 and -200 and na between -1100 and -850) then 'correction_too_extreme'
  when not ((abs(nm+650)<abs(m+650)*0.8 or abs(na+950)<abs(air+950)*0.8) and not (abs(nm+650)>abs(m+650)*1.2 or abs(na+950)>abs(air+950)*1.2)) then 'no_improvement' else 'applied' end as reason from n)
select scan_id, reason, reason='applied' as applied, round(case when reason not in ('invalid_structure','acceptable') then off end,6) as "offset", round(case when reason not in ('invalid_structure','acceptable') then sc end,6) as scale from d""")
def _(t):
    from arborstat.plans.selection import counted_percentile

    base = t.voxels.groupBy("scan_id").agg(
        F.avg("hu").alias("mean"), (F.min("hu") - (F.col("scan_id") % 4) * 60).alias("air_peak"),
        (F.count_if(F.col("hu").between(-900, -300)) * 100.0 / F.count("*")).alias("lung_percentage"),
        (F.max("hu") - F.min("hu")).alias("range"),
    ).join(counted_percentile(t.voxels, ["scan_id"], "hu", {"p01": 0.01}), "scan_id")
    r = P.recalibration(base, -650.0, 30.0, -950.0)
    return r.select("scan_id", "reason", "applied", r6("offset").alias("offset"), r6("scale").alias("scale"))
