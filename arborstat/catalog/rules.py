"""Scalar rules, checks and the QC batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborstat.catalog import query, r2, r6
from arborstat.catalog.sources import folder
from arborstat.functions import labels as L
from arborstat.functions.numeric import dbl, ratio
from arborstat.operators import branches, longitudinal, rules
from arborstat.operators.comparison import extract_report_metrics, extract_section
from arborstat.sources.readers import read_documents
from arborstat.sources.writers import write_table
from arborstat.streaming.qc_stream import first_sent, start_qc, stream_cases

METRICS = {m: m for m in ("airway_volume_ml", "max_generation", "pc_ratio", "branch_count", "tapering_ratio", "tortuosity")}

Q_SQL = """, q as (select case_id, grp, m3/300.0 as airway_volume_ml, cast(m2 as double) as max_generation, m6/1500.0 as pc_ratio,
  m2*10.0::double as branch_count, m5/nullif(m4,0)*4 as tapering_ratio, m4/nullif(m3,0) as tortuosity from cases)"""

CHECK_SQL = Q_SQL + """, l as (
  select case_id, 'airway_volume_ml' as metric, airway_volume_ml as value, 5.0::double as lo, 600.0::double as hi from q union all
  select case_id, 'max_generation', max_generation, 5, 35 from q union all
  select case_id, 'pc_ratio', pc_ratio, 0, 5 from q union all
  select case_id, 'branch_count', branch_count, 50, 5000 from q union all
  select case_id, 'tapering_ratio', tapering_ratio, 0.5, 1 from q union all
  select case_id, 'tortuosity', tortuosity, 1, 3 from q),
checks as (select case_id, metric, value,
  case when value is null then 'FAIL' when value between lo and hi then 'PASS' else 'FAIL' end as status,
  case when value is null then 'Value missing' when value between lo and hi then 'Technically plausible'
       else 'Outside technical limits ('||case metric when 'airway_volume_ml' then '5-600' when 'max_generation' then '5-35' when 'pc_ratio' then '0-5'
         when 'branch_count' then '50-5000' when 'tapering_ratio' then '0.5-1' else '1-3' end||')' end as message from l)"""

STATUS_SQL = CHECK_SQL + """, s as (select case_id, case when count(*) filter (where status='FAIL')=0 then 'RELIABLE' else 'UNRELIABLE' end as status,
  count(*) as n_checks, count(*) filter (where status='PASS') as n_passed, count(*) filter (where status='FAIL') as n_failed from checks group by 1)"""


def qc_inputs(t):
    return t.cases.select(
        "case_id", "grp", (F.col("m3") / 300.0).alias("airway_volume_ml"), dbl("m2").alias("max_generation"),
        (F.col("m6") / 1500.0).alias("pc_ratio"), (F.col("m2") * F.lit(10.0)).alias("branch_count"),
        (ratio("m5", "m4") * 4).alias("tapering_ratio"), ratio("m4", "m3").alias("tortuosity"),
    )


def checks(t):
    return rules.long_checks(qc_inputs(t), "case_id", METRICS)


def case_status(t):
    c = rules.rollup_checks(checks(t), "case_id")
    return c.withColumn("status", F.when(F.col("reliable"), "RELIABLE").otherwise("UNRELIABLE"))


@query("b01_reliable_cases", "cases", STATUS_SQL + "select case_id, n_checks from s where status='RELIABLE'")
def _(t):
    return case_status(t).where("status = 'RELIABLE'").select("case_id", "n_checks")


@query("b02_base_case_key", "cases", """, k as (select 'case_'||case_id||case when case_id%4=0 then '_gaussian' else '' end as case_name from cases)
select case_name, replace(case_name,'_gaussian','') as base_case, case_name like '%\\_gaussian%' escape '\\' as is_smoothed from k""")
def _(t):
    k = t.cases.select(F.concat(F.lit("case_"), F.col("case_id").cast("string"), F.when(F.col("case_id") % 4 == 0, "_gaussian").otherwise("")).alias("case_name"))
    base, smoothed = L.base_case("case_name")
    return k.select("case_name", base.alias("base_case"), smoothed.alias("is_smoothed"))


@query("b03_drop_missing", "cases", "select case_id, round(m3,2)# as m3, round(m6,2)# as m6 from cases where m3 is not null and m6 is not null")
def _(t):
    return t.cases.na.drop(subset=["m3", "m6"]).select("case_id", r2("m3").alias("m3"), r2("m6").alias("m6"))


@query("b04_branch_geometry", "branches_keyed", """select scan_id, branch_id, round(pi()*(diameter_mean_mm/2)*(diameter_mean_mm/2)*length_mm,6) as volume_mm3,
round(pi()*diameter_mean_mm*length_mm,6) as surface_area_mm2, round(diameter_mean_mm/nullif(length_mm,0),6) as diameter_to_length_ratio from branches_keyed""")
def _(t):
    g = branches.with_geometry(t.branches_keyed)
    return g.select("scan_id", "branch_id", *[r6(c).alias(c) for c in ("volume_mm3", "surface_area_mm2", "diameter_to_length_ratio")])


@query("b05_range_check", "cases", CHECK_SQL + "select case_id, metric, round(value,6) as value, status, message from checks")
def _(t):
    return checks(t).withColumn("value", r6("value"))


@query("b06_reference_check", "cases", Q_SQL + """, l as (
 select case_id, 'airway_volume_ml' as metric, airway_volume_ml as value, 180.0::double as m, 50.0::double as s, 80.0::double as lo, 350.0::double as hi from q union all
 select case_id, 'branch_count', branch_count*10, 1500, 500, 500, 3000 from q union all
 select case_id, 'max_generation', max_generation, 18, 3, 12, 23 from q union all
 select case_id, 'tortuosity', tortuosity, 1.25, 0.15, 1.0, 1.6 from q union all
 select case_id, 'tapering_ratio', tapering_ratio, 0.793, 0.05, 0.70, 0.88 from q)
select case_id, metric, case when value is null then 'FAIL' when value between lo and hi then 'PASS' when abs(value-m)<=2*s then 'WARNING' else 'FAIL' end as status,
 case when value is null then 'Value missing' when value between lo and hi then 'Within literature range' when abs(value-m)<=2*s then 'Outside range but within 2σ' else 'Implausible value' end as message from l""")
def _(t):
    names = ("airway_volume_ml", "branch_count", "max_generation", "tortuosity", "tapering_ratio")
    q = qc_inputs(t).withColumn("branch_count", F.col("branch_count") * 10)
    return rules.long_reference_checks(q, "case_id", {m: m for m in names}, L.REFERENCE_RANGES).drop("value")


@query("b07_severity_stage", "scored", """select case_id, case when s is null then 'Unknown' when s<20 then 'Minimal/No fibrosis' when s<35 then 'Mild fibrosis' when s<50 then 'Moderate fibrosis'
 when s<70 then 'Moderate-severe fibrosis (UIP pattern)' else 'Severe/Advanced fibrosis' end as stage from (select case_id, symmetry*100 as s from scored)""")
def _(t):
    return t.scored.select("case_id", L.stage(F.col("symmetry") * 100, "Unknown").alias("stage"))


@query("b08_correlation_labels", "cases", """, r as (select grp, regr_sxy(m3,m4)/sqrt(nullif(regr_sxx(m3,m4)*regr_syy(m3,m4),0)) as r, regr_sxy(m1,m3)/sqrt(nullif(regr_sxx(m1,m3)*regr_syy(m1,m3),0)) as r2 from cases group by 1),
u as (select grp, 'm3~m4' as pair, r from r union all select grp, 'm1~m3', r2 from r)
select grp, pair, round(r,6) as r, case when abs(r)>=0.5 then 'Strong' when abs(r)>=0.3 then 'Moderate' when r is not null then 'Weak' end as strength,
 case when r>0 then 'positive' when r is not null then 'negative' end as direction,
 case when 1-abs(r)<0.001 then '***' when 1-abs(r)<0.01 then '**' when 1-abs(r)<0.05 then '*' when r is not null then 'ns' end as stars from u""")
def _(t):
    from arborstat.functions.numeric import pearson

    w = t.cases.groupBy("grp").agg(pearson("m3", "m4").alias("a"), pearson("m1", "m3").alias("b"))
    u = w.select("grp", F.inline(F.array(F.struct(F.lit("m3~m4").alias("pair"), F.col("a").alias("r")), F.struct(F.lit("m1~m3").alias("pair"), F.col("b").alias("r")))))
    return u.select("grp", "pair", r6("r").alias("r"), L.strength("r").alias("strength"), L.direction("r").alias("direction"), L.stars(1 - F.abs("r")).alias("stars"))


PAIR_SQL = """, p as (select entity, arg_min(value, (abs(week), week, row_id)) as v0, arg_min(value, (abs(week-52), week, row_id)) as v1 from visits group by 1),
d as (select entity, v0, v1, v0-v1 as a, case when v0>0 then (v0-v1)/v0*100 end as r from p)"""


@query("b09_progression_labels", "visits", PAIR_SQL + """select entity, coalesce(a>5,false) as progressed_absolute, coalesce(r>10,false) as progressed_relative,
 coalesce(a>5,false) and coalesce(r>10,false) as progressed_combined from d""")
def _(t):
    d = longitudinal.drops(longitudinal.nearest_pair(t.visits, 0, 52))
    return d.select("entity", *[c.alias(n) for n, c in L.progressed("drop_absolute", "drop_relative").items()])


@query("b10_drops", "visits", PAIR_SQL + "select entity, round(a,6) as drop_absolute, round(r,6) as drop_relative from d")
def _(t):
    d = longitudinal.drops(longitudinal.nearest_pair(t.visits, 0, 52))
    return d.select("entity", r6("drop_absolute").alias("drop_absolute"), r6("drop_relative").alias("drop_relative"))


@query("b11_region_class", "branches_keyed", """select scan_id, branch_id, case when generation<=7 then 'central' when generation<=10 then 'intermediate' when generation>10 then 'peripheral' end as region from branches_keyed""")
def _(t):
    return t.branches_keyed.select("scan_id", "branch_id", L.region("generation").alias("region"))


KERNEL_SQL = """, k as (select scan_id, case scan_id%9 when 0 then kernel when 1 then 'FC'||lpad(cast(scan_id%60 as varchar),2,'0') when 2 then 'BONEPLUS' when 3 then 'LUNG' when 4 then 'Standard'
  when 5 then 'soft_'||cast(scan_id%100 as varchar) when 6 then 'YC' when 7 then null else upper(kernel) end as kernel from scans),
n as (select *, upper(kernel) as up, try_cast(nullif(regexp_extract(kernel,'[0-9]+'),'') as int) as num from k),
c as (select scan_id, kernel,
 case when kernel is null or kernel='' then false when kernel in ('B60f','B70f','B80f','B80s','FC51','FC53','FC18','LUNG','BONEPLUS') then true
  when num is not null and up like 'B%' then num>50 when num is not null and up like 'FC%' then num>10
  when regexp_matches(up,'LUNG|BONE|EDGE|SHARP|DETAIL|HIGH') then true else false end as is_sharp,
 case when kernel is null or kernel='' then 0 when kernel in ('B60f','B70f','B80f','B80s','FC51','FC53','FC18','LUNG','BONEPLUS') then 90
  when num is not null and (up like 'B%' or up like 'FC%') then num
  when regexp_matches(up,'LUNG|BONE|EDGE|SHARP|DETAIL|HIGH') then 80 when regexp_matches(up,'SOFT|SMOOTH|STANDARD|STD') then 20 else 50 end as sharpness from n)"""


def kernels(t):
    m, k = F.col("scan_id") % 9, F.col("kernel")
    name = (
        F.when(m == 0, k).when(m == 1, F.concat(F.lit("FC"), F.lpad((F.col("scan_id") % 60).cast("string"), 2, "0")))
        .when(m == 2, "BONEPLUS").when(m == 3, "LUNG").when(m == 4, "Standard")
        .when(m == 5, F.concat(F.lit("soft_"), (F.col("scan_id") % 100).cast("string"))).when(m == 6, "YC")
        .when(m == 7, F.lit(None)).otherwise(F.upper(k))
    )
    return t.scans.withColumn("kernel", name)


@query("b12_kernel_sharpness", "scans", KERNEL_SQL + "select scan_id, kernel, is_sharp, sharpness from c")
def _(t):
    sharp, score = L.kernel_sharpness("kernel")
    return kernels(t).select("scan_id", "kernel", sharp.alias("is_sharp"), score.alias("sharpness"))


ISSUE_SQL = """, i as (
 select scan_id, 1 as k, 'Too few slices: '||num_slices||' < 300' as issue from scans where num_slices<300 union all
 select scan_id, 2, case when slice_thickness<0.5 then 'Slice too thin' else 'Slice too thick' end from scans where slice_thickness<0.5 or slice_thickness>1.5 union all
 select scan_id, 3, case when xy_resolution<0.3 then 'XY resolution too fine' else 'XY resolution too coarse' end from scans where xy_resolution<0.3 or xy_resolution>1.1),
b as (select s.scan_id, s.num_slices, s.slice_thickness, s.xy_resolution, count(i.issue) as n_issues, string_agg(i.issue, '; ' order by k) as issues from scans s left join i using (scan_id) group by 1,2,3,4)"""


def with_issues(t):
    return t.scans.withColumn("issues", L.compatibility_issues("num_slices", "slice_thickness", "xy_resolution"))


@query("b13_compatibility", "scans", ISSUE_SQL + "select scan_id, n_issues=0 as compatible, coalesce(issues,'') as issues from b")
def _(t):
    return with_issues(t).select("scan_id", (F.size("issues") == 0).alias("compatible"), F.concat_ws("; ", "issues").alias("issues"))


REASON_SQL = ISSUE_SQL + """, r as (select scan_id, issue, case when issue like 'Too few slices%' then 'num_slices_out_of_range' when issue like 'Slice too%' then 'slice_thickness_out_of_range' when issue like 'XY%' then 'xy_resolution_out_of_range' else 'other' end as reason from i)"""


@query("b14_issue_reasons", "scans", REASON_SQL + "select scan_id, issue, reason from r")
def _(t):
    return with_issues(t).select("scan_id", F.explode("issues").alias("issue")).withColumn("reason", L.issue_reason("issue"))


@query("b15_label_names", "voxels", "select scan_id, z, y, x, greatest(hu//400+2, 0)::int as label_code, case greatest(hu//400+2,0) when 2 then 'Artery' when 1 then 'Vein' else '' end as label_name from voxels")
def _(t):
    # integer division towards zero, as in the SQL
    code, name = L.label_name(F.expr("cast(hu div 400 + 2 as int)"))
    return t.voxels.select("scan_id", "z", "y", "x", code.alias("label_code"), name.alias("label_name"))


@query("b16_report_metrics", "reports", """select scan_id, run, try_cast(nullif(regexp_extract(body,'Total branches:\\s*(\\d+)',1),'') as double) as total_branches,
 try_cast(nullif(regexp_extract(body,'Central:\\s*([\\d.]+)\\s*mm³\\s*\\((\\d+)\\s*branches\\)',1),'') as double) as central_volume,
 try_cast(nullif(regexp_extract(body,'Central:\\s*([\\d.]+)\\s*mm³\\s*\\((\\d+)\\s*branches\\)',2),'') as bigint) as central_branches,
 try_cast(nullif(regexp_extract(body,'Peripheral:\\s*([\\d.]+)\\s*mm³\\s*\\((\\d+)\\s*branches\\)',1),'') as double) as peripheral_volume,
 nullif(trim(regexp_extract(body,'CLASSIFICATION:\\s*([^\\n]+)',1)),'') as fibrosis_stage from reports""")
def _(t):
    return extract_report_metrics(t.reports, "body").select("scan_id", "run", "total_branches", "central_volume", "central_branches", "peripheral_volume", "fibrosis_stage")


@query("b17_section_extract", "texts", """, p as (select doc_id, body, strpos(body,'<article>') as a from texts),
e as (select doc_id, body, a, case when a>0 then strpos(substr(body,a),'</article>') else 0 end as b from p)
select doc_id, b>0 as extracted, case when b>0 then substr(body,a,b-1) end as section from e""")
def _(t):
    return extract_section(t.texts, "body", "<article>", "</article>").select("doc_id", "extracted", "section")


@query("b18_window_clip", "voxels", "select scan_id, z, y, x, least(greatest(cast(hu as double),-850.0::double),-450.0::double) as windowed from voxels")
def _(t):
    return t.voxels.select("scan_id", "z", "y", "x", L.window_level("hu", -650.0, 400.0).alias("windowed"))


@query("b21_threshold_labels", "scored", """select case_id,
 case when lung_density>-700 then 'ELEVATED' when lung_density<-850 then 'LOW' when lung_density is not null then 'NORMAL' end as density_label,
 case when entropy>4.5 then 'HIGH' when entropy<3.5 then 'LOW' when entropy is not null then 'NORMAL' end as entropy_label,
 case when pc_ratio<0.2 then 'LOW' when pc_ratio>0.6 then 'HIGH' when pc_ratio is not null then 'NORMAL' end as pc_report_label,
 case when pc_ratio<0.15 then 'VERY LOW' when pc_ratio<0.3 then 'LOW' when pc_ratio<0.5 then 'BORDERLINE' when pc_ratio>1 then 'EXCELLENT' when pc_ratio is not null then 'NORMAL' end as pc_console_label,
 case when tortuosity>1.5 then 'HIGH' when tortuosity is not null then 'NORMAL' end as tortuosity_label,
 case when symmetry<0.5 then 'VERY ASYMMETRIC' when symmetry<0.7 then 'ASYMMETRIC' when symmetry<0.85 then 'MILD' when symmetry is not null then 'SYMMETRIC' end as symmetry_label,
 case when peripheral_diameter<tortuosity*0.7 then 'left' when tortuosity<peripheral_diameter*0.7 then 'right' when tortuosity is not null and peripheral_diameter is not null then 'none' end as affected_side from scored""")
def _(t):
    return t.scored.select(
        "case_id", L.density_label("lung_density").alias("density_label"), L.entropy_label("entropy").alias("entropy_label"),
        L.pc_label_report("pc_ratio").alias("pc_report_label"), L.pc_label_console("pc_ratio").alias("pc_console_label"),
        L.tortuosity_label("tortuosity").alias("tortuosity_label"), L.symmetry_label("symmetry").alias("symmetry_label"),
        L.affected_side("peripheral_diameter", "tortuosity").alias("affected_side"),
    )


@query("b22_theoretical_curves", "branches", """, g as (select scan_id, generation, count(*) as n_branches, avg(diameter_mean_mm) as d from branches where generation is not null group by 1,2),
f as (select scan_id, arg_min(d,generation) as d0 from g group by 1)
select g.scan_id, g.generation, round(d,6) as observed_diameter, round(d0*pow(2,-generation/3.0),6) as expected_diameter, round(abs(d-d0*pow(2,-generation/3.0)),6) as diameter_gap,
 pow(2,generation+1)::double as expected_branches, abs(n_branches-pow(2,generation+1))::double as branch_gap from g join f using (scan_id)""")
def _(t):
    return branches.theoretical_curves(t.branches).select(
        "scan_id", "generation", r6("observed_diameter").alias("observed_diameter"), r6("expected_diameter").alias("expected_diameter"),
        r6("diameter_gap").alias("diameter_gap"), "expected_branches", "branch_gap",
    )


@query("e02_status_distribution", "cases", STATUS_SQL + "select status, count(*) as n from s group by 1")
def _(t):
    return rules.status_distribution(case_status(t))


@query("e03_check_rollup", "cases", STATUS_SQL + "select case_id, n_checks, n_passed, n_failed, n_failed=0 as reliable from s")
def _(t):
    return rules.rollup_checks(checks(t), "case_id")


@query("e04_check_pivot", "cases", CHECK_SQL + "select case_id, " + ", ".join(
    f"round(max(value) filter (where metric='{m}'),6) as {m}_value, max(status) filter (where metric='{m}') as {m}_status" for m in METRICS) + " from checks group by 1")
def _(t):
    w = rules.pivot_checks(checks(t), "case_id", list(METRICS))
    return w.select("case_id", *[c for m in METRICS for c in (r6(f"{m}_value").alias(f"{m}_value"), f"{m}_status")])


@query("e31_mean_failures", "cases", STATUS_SQL + "select status, round(avg(n_failed),6) as mean_failed from s group by 1")
def _(t):
    return case_status(t).groupBy("status").agg(r6(F.avg("n_failed")).alias("mean_failed"))


def batch_sql(absent: str, failed: str) -> str:
    """The QC batch over cases, of which some have no inputs (``absent``) and some ``failed`` to load."""
    return Q_SQL + f""", l as (
  select case_id, 'airway_volume_ml' as metric, coalesce(airway_volume_ml,0) as value, 5.0::double as lo, 600.0::double as hi from q union all
  select case_id, 'max_generation', max_generation, 5, 35 from q union all select case_id, 'pc_ratio', pc_ratio, 0, 5 from q union all
  select case_id, 'branch_count', branch_count, 50, 5000 from q union all select case_id, 'tapering_ratio', tapering_ratio, 0.5, 1 from q union all
  select case_id, 'tortuosity', tortuosity, 1, 3 from q),
k as (select case_id, metric, value, case when value between lo and hi then 'PASS' else 'FAIL' end as st from l where value is not null and not ({absent})),
w as (select case_id, count(*) as c, count(*) filter (where st='PASS') as p, """ + ", ".join(
        f"max(value) filter (where metric='{m}') as {m}_value, max(st) filter (where metric='{m}') as {m}_status" for m in METRICS) + f""" from k group by 1)
select q.case_id, case when {absent} then 'SKIPPED' when {failed} then 'ERROR' when c=p then 'RELIABLE' else 'UNRELIABLE' end as status,
 coalesce(c,0)::int as tech_checks, coalesce(p,0)::int as tech_passed, coalesce(c-p,0)::int as tech_failed, """ + ", ".join(
        f"round({m}_value,6) as {m}_value, {m}_status" for m in METRICS) + " from q left join w using (case_id)"


def summary_columns(df):
    return df.select("case_id", "status", "tech_checks", "tech_passed", "tech_failed", *[c for m in METRICS for c in (r6(f"{m}_value").alias(f"{m}_value"), f"{m}_status")])


@query("i06_qc_batch", "cases", batch_sql("case_id%23=0", "case_id%29=0"))
def _(t):
    """Cases meet the documents that were written for them: some have none, and some cannot be read."""
    p = folder(t, "cases")
    number = F.when(F.col("case_id") % 29 == 0, "unreadable").otherwise(F.col("branch_count").cast("string"))
    written = qc_inputs(t).where("case_id % 23 <> 0").select("case_id", F.pmod("case_id", F.lit(8)).alias("part"), number.alias("branch_count"))
    write_table(written, p, "json", ["part"])
    loaded = read_documents(t.spark, p, {"case_id": "long", "branch_count": "double"}, r"part=(\d+)/", key="part", multiline=False)
    found = loaded.select("case_id", F.lit(True).alias("found"), F.col("branch_count").isNull().alias("broken"))
    out = rules.qc_batch(
        qc_inputs(t).join(found, "case_id", "left"), "case_id", METRICS, present=F.col("found").isNotNull(), failed=F.coalesce("broken", F.lit(False)),
        zero_if_missing=("airway_volume_ml",),
    )
    return summary_columns(out)


@query("i06_qc_stream", "cases", batch_sql("false", "false"))
def _(t):
    """Documents come in two deliveries, some of the first again in the second; the stream is stopped between them."""
    p = folder(t, "stream")
    docs = qc_inputs(t).withColumn("sent", F.timestamp_seconds(1_700_000_000 + F.pmod("case_id", F.lit(1200))))
    again = F.col("case_id") % 6 == 0
    for part, mine in enumerate((F.col("case_id") % 2 == 0, (F.col("case_id") % 2 == 1) | again)):
        late = F.expr(f"sent + interval {30 * part} minutes")
        write_table(docs.where(mine).withColumn("sent", late), f"{p}/in", "parquet", mode="append")
        arriving = first_sent(stream_cases(t.spark, f"{p}/in", docs.schema, "parquet"), "case_id", "sent", "2 hours")
        start_qc(arriving, "case_id", METRICS, F.lit(True), f"{p}/out", f"{p}/state", ("airway_volume_ml",)).awaitTermination()
    return summary_columns(t.spark.read.parquet(f"{p}/out"))

