"""Component scores, totals and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborstat.catalog import query, r6
from arborstat.operators import branches, scoring

SCORE = {
    "pc_ratio": "case when pc_ratio is null then 5 when pc_ratio<0.15 then 10 when pc_ratio<0.25 then 7+(0.25-pc_ratio)/0.10*3 when pc_ratio<0.40 then 4+(0.40-pc_ratio)/0.15*3 when pc_ratio<=0.65 then least(3, abs(pc_ratio-0.45)/0.15*1.5) else 2+least(1,(pc_ratio-0.65)/0.20) end",
    "tortuosity": "case when tortuosity is null then 5 when tortuosity<1 then 1+(1-tortuosity)*2 when tortuosity<=1.5 then least(3,abs(tortuosity-1.25)/0.15*1.5) when tortuosity<=2 then 4+(tortuosity-1.5)/0.5*2 when tortuosity<=2.5 then 7+(tortuosity-2)/0.5 else 9+least(1,(tortuosity-2.5)/0.5) end",
    "symmetry": "case when symmetry is null then 5 when symmetry>0.9 then (1-symmetry)*10 when symmetry>=0.8 then 1+(0.9-symmetry)/0.1*2 when symmetry>=0.7 then 4+(0.8-symmetry)/0.1 when symmetry>=0.5 then 6+(0.7-symmetry)/0.2 else 8+least(2,(0.5-symmetry)/0.3*2) end",
    "peripheral_density": "case when peripheral_density is null then 5 when peripheral_density<0.03 then 10 when peripheral_density<0.05 then 7+(0.05-peripheral_density)/0.02*3 when peripheral_density<0.08 then 4+(0.08-peripheral_density)/0.03*3 when peripheral_density<=0.15 then greatest(0,4-(peripheral_density-0.08)/0.07*4) else 0 end",
    "airway_volume": "case when volume_mm3>30000 then 0 when volume_mm3>20000 then 3*(30000-volume_mm3)/10000 when volume_mm3>15000 then 3+3*(20000-volume_mm3)/5000 when volume_mm3>10000 then 6+2*(15000-volume_mm3)/5000 else least(10,greatest(0,8+least(2,(10000-volume_mm3)/5000))) end",
    "generation_coverage": "case when generation_coverage>0.9 then (1-generation_coverage)*10 when generation_coverage>=0.8 then 1+(0.9-generation_coverage)/0.1*2 when generation_coverage>=0.7 then 4+(0.8-generation_coverage)/0.1*2 when generation_coverage>=0.5 then 7+(0.7-generation_coverage)/0.2 else 9+least(1,(0.5-generation_coverage)/0.3) end",
    "parenchymal_entropy": "case when entropy is null then 5 when entropy<4 then 0 when entropy<5 then greatest(0,(5-entropy)*2) when entropy<5.5 then 2+(entropy-5)/0.5*2 when entropy<6 then 4+(entropy-5.5)/0.5*2 when entropy<6.5 then 6+(entropy-6)/0.5*2 else 8+least(2,(entropy-6.5)/0.5*2) end",
    "parenchymal_density": "case when lung_density is null then 5 when lung_density<-900 then 0 when lung_density<-850 then greatest(0,(-850-lung_density)/50) when lung_density<-750 then 1+(-750-lung_density)/100*2 when lung_density<-700 then 3+(-700-lung_density)/50*2 when lung_density<-650 then 5+(-650-lung_density)/50*2 when lung_density<-600 then 7+(-600-lung_density)/50*2 else 9+least(1,(-600-lung_density)/50) end",
}
TEXT = {
    "pc_ratio": "case when pc_ratio is null then 'Unknown' when pc_ratio<0.15 then 'Severe peripheral airway loss' when pc_ratio<0.25 then 'Moderate to severe peripheral loss' when pc_ratio<0.4 then 'Mild peripheral airway loss' when pc_ratio<=0.65 then 'Within normal range' else 'Unusually high (possible compensatory changes)' end",
    "tortuosity": "case when tortuosity is null then 'Unknown' when tortuosity<1 then 'Unusually straight airways' when tortuosity<=1.5 then 'Within normal range' when tortuosity<=2 then 'Mild airway distortion' when tortuosity<=2.5 then 'Moderate airway distortion' else 'Severe airway distortion' end",
    "symmetry": "case when symmetry is null then 'Unknown' when symmetry>0.9 then 'Highly symmetric - bilateral disease pattern' when symmetry>=0.8 then 'Good symmetry with minor differences' when symmetry>=0.7 then 'Fair symmetry' when symmetry>=0.5 then 'Moderate asymmetry - possible focal disease' else 'Severe asymmetry - unilateral predominance' end",
    "peripheral_density": "case when peripheral_density is null then 'Unknown' when peripheral_density<0.03 then 'Severe peripheral airway loss' when peripheral_density<0.05 then 'Moderate to severe peripheral loss' when peripheral_density<0.08 then 'Mild peripheral airway loss' when peripheral_density<=0.15 then 'Within normal range' else 'Excellent peripheral preservation' end",
    "airway_volume": "case when volume_mm3>30000 then 'Excellent airway volume - well preserved' when volume_mm3>20000 then 'Good airway volume' when volume_mm3>15000 then 'Moderate airway volume reduction' when volume_mm3>10000 then 'Significant airway volume loss' else 'Severe airway volume loss' end",
    "generation_coverage": "case when generation_coverage>0.9 then 'Excellent generation coverage' when generation_coverage>=0.8 then 'Good coverage with minor gaps' when generation_coverage>=0.7 then 'Fair coverage with moderate gaps' when generation_coverage>=0.5 then 'Poor coverage with significant gaps' else 'Very poor coverage - severe airway loss' end",
    "parenchymal_entropy": "case when entropy is null then 'Unknown' when entropy<4 then 'Very homogeneous (unusual)' when entropy<5 then 'Normal homogeneity' when entropy<5.5 then 'Mild texture heterogeneity' when entropy<6 then 'Moderate texture heterogeneity' when entropy<6.5 then 'Marked texture heterogeneity' else 'Severe texture heterogeneity' end",
    "parenchymal_density": "case when lung_density is null then 'Unknown' when lung_density<-900 then 'Very low density (emphysematous)' when lung_density<-850 then 'Low density' when lung_density<-750 then 'Normal density' when lung_density<-700 then 'Mildly increased density' when lung_density<-650 then 'Moderately increased density' when lung_density<-600 then 'Markedly increased density' else 'Severe parenchymal density increase' end",
}
RESCORED = {
    "tortuosity": "case when tortuosity is null then 5 when tortuosity<1 then 1+(1-tortuosity)*2 when tortuosity<=1.5 then least(3,abs(tortuosity-1.25)/0.15*1.5) when tortuosity<2 then 3+(tortuosity-1.5)/0.5*3 when tortuosity<2.5 then 6+(tortuosity-2)/0.5*2 else 8+least(2,(tortuosity-2.5)/0.5*2) end",
    "symmetry": "case when symmetry is null then 5 when abs(1-symmetry)<0.15 then 0 when abs(1-symmetry)<0.30 then (abs(1-symmetry)-0.15)/0.15*4 when abs(1-symmetry)<0.5 then 4+(abs(1-symmetry)-0.3)/0.2*3 else 7+least(3,(abs(1-symmetry)-0.5)/0.3*3) end",
}
PV_SQL = """, pv0 as (select case_id,
  case when peripheral_diameter<1.5 then 10 when peripheral_diameter<2 then 6+(2-peripheral_diameter)/0.5*4 when peripheral_diameter<2.5 then 3+(2.5-peripheral_diameter)/0.5*3 when peripheral_diameter is not null then greatest(0,3-(peripheral_diameter-2.5)*3) end as a,
  case when peripheral_branch_volume<10 then 10 when peripheral_branch_volume<20 then 6+(20-peripheral_branch_volume)/10*4 when peripheral_branch_volume<30 then 3+(30-peripheral_branch_volume)/10*3 when peripheral_branch_volume is not null then greatest(0,3-(peripheral_branch_volume-30)/30*3) end as b,
  case when peripheral_pct<10 then 10 when peripheral_pct<15 then 6+(15-peripheral_pct)/5*4 when peripheral_pct<20 then 3+(20-peripheral_pct)/5*3 when peripheral_pct is not null then greatest(0,3-(peripheral_pct-20)/10*3) end as c,
  case when peripheral_diameter<1.5 then 'Severe diameter reduction' when peripheral_diameter<2 then 'Moderate diameter reduction' when peripheral_diameter<2.5 then 'Mild diameter reduction' when peripheral_diameter is not null then 'Normal diameter' end as ta,
  case when peripheral_branch_volume<10 then 'Severe volume loss' when peripheral_branch_volume<20 then 'Moderate volume loss' when peripheral_branch_volume<30 then 'Mild volume reduction' when peripheral_branch_volume is not null then 'Good volume' end as tb from scored),
pv as (select case_id, coalesce(list_avg([a::double,b::double,c::double]),5) as raw, coalesce(a,b,c) is not null as valid,
  case when ta is null and tb is null then 'Unknown' else concat_ws('; ',ta,tb) end as txt from pv0)"""


def weighted(score: str, weights) -> str:
    """Sum of weight (times score) over the valid components, in the order of the weight table."""
    return "(0::double" + "".join(
        f"+case when o{i} then {w}::double{f'*s{i}::double' if score else ''} else 0::double end" for i, w in weights
    ) + ")"


def total_sql(profile: str) -> str:
    t = SCORE["tortuosity"] if profile == "scorer" else RESCORED["tortuosity"]
    s = SCORE["symmetry"] if profile == "scorer" else RESCORED["symmetry"]
    c = f"""{PV_SQL}, c as (
 select case_id, 'peripheral_density' as comp, {SCORE['peripheral_density']} as raw, peripheral_density is not null as ok, 0.35 as wa, 0.15 as wc from scored union all
 select case_id, 'peripheral_volume', raw, valid, 0.25, 0.15 from pv union all
 select case_id, 'pc_ratio', {SCORE['pc_ratio']}, pc_ratio is not null, 0.20, 0 from scored union all
 select case_id, 'tortuosity', {t}, tortuosity is not null, 0.15, 0.05 from scored union all
 select case_id, 'symmetry', {s}, symmetry is not null, 0.05, 0.05 from scored union all
 select case_id, 'parenchymal_entropy', {SCORE['parenchymal_entropy']}, entropy is not null, 0, 0.35 from scored union all
 select case_id, 'parenchymal_density', {SCORE['parenchymal_density']}, lung_density is not null, 0, 0.25 from scored),
x as (select s.case_id, {SCORE['peripheral_density']} as s1, pv.raw as s2, {SCORE['pc_ratio']} as s3, {t} as s4, {s} as s5, {SCORE['parenchymal_entropy']} as s6, {SCORE['parenchymal_density']} as s7,
  peripheral_density is not null as o1, pv.valid as o2, pc_ratio is not null as o3, tortuosity is not null as o4, symmetry is not null as o5, entropy is not null as o6, lung_density is not null as o7 from scored s join pv using (case_id)),
y as (select case_id, {weighted('s', ((1, .35), (2, .25), (3, .20), (4, .15), (5, .05)))} as ta, {weighted('', ((1, .35), (2, .25), (3, .20), (4, .15), (5, .05)))} as airc,
  {weighted('s', ((6, .35), (7, .25), (1, .15), (2, .15), (4, .05), (5, .05)))} as tc, {weighted('', ((6, .35), (7, .25), (1, .15), (2, .15), (4, .05), (5, .05)))} as comc, o6 or o7 as has from x),
w as (select case_id, ta/nullif(airc,0)*10 as air0, airc, tc/nullif(comc,0)*10 as com0, comc, has from y),"""
    if profile == "scorer":
        return c + """a as (select case_id, coalesce(air0,50) as air, airc, case when has then coalesce(com0,50) end as com, case when has then comc end as comc from w),
o as (select *, coalesce(com,air) as ov, case when com is not null then comc else airc end as ovc from a)"""
    return c + """a as (select case_id, air0 as air, airc, com0 as com, comc from w),
o as (select *, coalesce(com,air) as ov, case when com is not null then comc else airc end as ovc from a)"""


def stage_sql(x: str, missing: str = "null") -> str:
    return f"case when {x} is null then {missing} when {x}<20 then 'Minimal/No fibrosis' when {x}<35 then 'Mild fibrosis' when {x}<50 then 'Moderate fibrosis' when {x}<70 then 'Moderate-severe fibrosis (UIP pattern)' else 'Severe/Advanced fibrosis' end"


SIMPLE = {
    "c01": "pc_ratio", "c02": "tortuosity", "c03": "generation_coverage", "c04": "airway_volume", "c05": "symmetry",
    "c08": "peripheral_density", "c10": "parenchymal_entropy", "c11": "parenchymal_density",
}


def _simple(code: str, name: str):
    extra = f", round({RESCORED[name]},6) as rescored" if name in RESCORED else ""

    @query(f"{code}_{name}_score", "scored", f"select case_id, round({SCORE[name]},6) as raw_score, {TEXT[name]} as interpretation{extra} from scored")
    def _(t):
        raw, text, _ = scoring.component(name)
        cols = [r6(raw).alias("raw_score"), text.alias("interpretation")]
        if name in RESCORED:
            cols.append(r6(scoring.component(name, "rescorer")[0]).alias("rescored"))
        return t.scored.select("case_id", *cols)


for _code, _name in SIMPLE.items():
    _simple(_code, _name)

GEN_SQL = """, g as (select scan_id, generation, sum(pi()*diameter_mean_mm*diameter_mean_mm/4*length_mm) as v, avg(diameter_mean_mm) as d from branches where generation is not null group by 1,2)"""


@query("c06_volume_distribution_score", "branches", GEN_SQL + """, n as (select *, lead(v) over w as nv, row_number() over w as i from g window w as (partition by scan_id order by generation)),
a as (select scan_id, count(*) as k, count(*) filter (where v-nv>abs(v)*1e-9) as dn, count(*) filter (where v>0 and (v-nv)/v>0.8+1e-9) as ab, avg(v) filter (where i<=5) as m, stddev_pop(v) filter (where i<=5) as s from n group by 1),
b as (select scan_id, k, coalesce(dn/nullif(k-1,0)::double,0) as dr, ab, case when k>=5 and m>0 then s/m else 0 end as cv from a)
select scan_id, round(dr,6) as decreasing_ratio, ab as abrupt_drops, round(cv,6) as early_cv, case when k<3 then 5 else least(10,
 (case when dr<0.6 then 3 when dr<0.8 then 1.5 else 0 end)+(case when ab>2 then 4 when ab>0 then 2 else 0 end)+(case when cv>1.5 then 3 when cv>1 then 1.5 else 0 end)) end::double as raw_score from b""")
def _(t):
    v = scoring.volume_distribution(branches.volume_by_generation(t.branches))
    return v.select("scan_id", r6("decreasing_ratio").alias("decreasing_ratio"), "abrupt_drops", r6("early_cv").alias("early_cv"), "raw_score")


TAPER_SQL = GEN_SQL + """, tp as (select scan_id, generation as from_generation, lead(generation) over w as to_generation, lead(d) over w/d as ratio from g window w as (partition by scan_id order by generation)),
ta as (select scan_id, avg(ratio) as m, stddev_pop(ratio) as s, abs(avg(ratio)-pow(2,-1.0/3)) as dev from tp where ratio is not null group by 1)"""


@query("c07_tapering_score", "branches", TAPER_SQL + """select scan_id, round(m,6) as mean_ratio, round(dev,6) as deviation, round(s,6) as std_ratio, round(least(10,
 (case when dev<0.05 then dev/0.05*2 when dev<0.1 then 2+(dev-0.05)/0.05*2 when dev<0.15 then 5+(dev-0.1)/0.05*2 else 8+least(2,(dev-0.15)/0.1*2) end)+case when s>0.15 then 1 else 0 end),6) as raw_score,
 (case when dev<0.05 then 'Normal tapering pattern' when dev<0.1 then 'Mild tapering abnormality' when dev<0.15 then 'Moderate tapering abnormality' else 'Severe tapering abnormality' end)||case when s>0.15 then ' with high variability' else '' end as interpretation from ta""")
def _(t):
    s = scoring.tapering_component(branches.tapering(t.branches))
    return s.select("scan_id", *[r6(c).alias(c) for c in ("mean_ratio", "deviation", "std_ratio", "raw_score")], "interpretation")


@query("c09_peripheral_volume_score", "scored", PV_SQL + "select case_id, round(raw,6) as raw_score, txt as interpretation, valid as is_valid from pv")
def _(t):
    raw, text, valid = scoring.component("peripheral_volume")
    return t.scored.select("case_id", r6(raw).alias("raw_score"), text.alias("interpretation"), valid.alias("is_valid"))


def _totals(t, profile):
    a = scoring.assess(t.scored, "case_id", profile)
    return a.select(
        "case_id", r6("airway_score").alias("airway_score"), r6("airway_confidence").alias("airway_confidence"), "airway_stage",
        r6("combined_score").alias("combined_score"), r6("combined_confidence").alias("combined_confidence"), "combined_stage",
    )


def _totals_sql(profile):
    unk = "null" if profile == "scorer" else "'Unknown'"
    return total_sql(profile) + f"select case_id, round(air,6) as airway_score, round(airc::double,6) as airway_confidence, {stage_sql('air', unk)} as airway_stage, round(com,6) as combined_score, round(comc::double,6) as combined_confidence, {stage_sql('com')} as combined_stage from o"


@query("c12_weighted_total_scorer", "scored", _totals_sql("scorer"))
def _(t):
    return _totals(t, "scorer")


@query("c12_weighted_total_rescorer", "scored", _totals_sql("rescorer"))
def _(t):
    return _totals(t, "rescorer")


@query("c12_airway_rescoring", "scored", total_sql("rescorer") + f"select case_id, round(coalesce(air,50),6) as score, round(airc::double,6) as confidence, {stage_sql('coalesce(air,50)')} as stage from o")
def _(t):
    return scoring.assess_airway(t.scored).select("case_id", r6("score").alias("score"), r6("confidence").alias("confidence"), "stage")


@query("c13_method_selection", "scored", total_sql("scorer") + f"select case_id, round(ov,6) as overall_score, {stage_sql('ov')} as overall_stage, round(ovc::double,6) as overall_confidence from o")
def _(t):
    a = scoring.assess(t.scored, "case_id")
    return a.select("case_id", r6("overall_score").alias("overall_score"), "overall_stage", r6("overall_confidence").alias("overall_confidence"))


@query("c14_rescore_counters", "scored", total_sql("rescorer") + """select count(*) as total, count(ov) as rescored, count(*)-count(ov) as skipped, count(*) filter (where entropy is null and lung_density is null) as without_parenchymal from o join scored using (case_id)""")
def _(t):
    return scoring.rescore_counters(scoring.assess(t.scored, "case_id", "rescorer"))


@query("c15_findings", "scored", total_sql("scorer") + f""", c9 as (select case_id, comp, raw from c union all select case_id, 'airway_volume', {SCORE['airway_volume']} from scored union all select case_id, 'generation_coverage', {SCORE['generation_coverage']} from scored),
r9 as (select case_id, round(ov::double,9) as ov from o),
f as (select r9.case_id, comp as f from r9 join c9 using (case_id) where (ov>=35 and ov<50 and round(raw::double,9)>6) or (ov>=70 and round(raw::double,9)>=8) union all
 select r9.case_id, 'severe peripheral loss' from r9 join scored using (case_id) where ov>=50 and ov<70 and pc_ratio<0.25 union all
 select r9.case_id, 'generation loss' from r9 join scored using (case_id) where ov>=50 and ov<70 and generation_coverage<0.70)
select case_id, count(f) as n_findings, coalesce(string_agg(f, ',' order by f),'') as findings from scored left join f using (case_id) group by 1""")
def _(t):
    names = ["peripheral_density", "peripheral_volume", "pc_ratio", "tortuosity", "symmetry", "airway_volume", "generation_coverage", "parenchymal_entropy", "parenchymal_density"]
    f = scoring.findings(scoring.assess(t.scored, "case_id"), names)
    return f.select("case_id", F.size("findings").cast("long").alias("n_findings"), F.array_join(F.array_sort("findings"), ",").alias("findings"))
