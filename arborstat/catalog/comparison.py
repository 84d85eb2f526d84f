"""Run-to-run comparison and report assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborstat.catalog import query, r6
from arborstat.operators import comparison as C

METRICS = ["total_branches", "volume", "pc_ratio", "fibrosis_score"]
PAIR_SQL = """, o as (select *, scan_id||case run when 'F' then ':F-O' else ':O-P' end as k from runs where run<>'P'), f as (select *, scan_id||case run when 'O' then ':F-O' else ':O-P' end as k from runs where run<>'F'),
pr as (select coalesce(o.k,f.k) as pair, o.total_branches as ob, f.total_branches as nb, o.volume/1e6 as ov, f.volume/1e6 as nv, o.pc_ratio/1e5 as op, f.pc_ratio/1e5 as np, o.total_branches*17%101 as os, f.total_branches*17%101 as ns from o full outer join f on o.k=f.k),
u as (select pair, 'total_branches' as metric, ob::double as old, nb::double as new, true as up from pr union all select pair, 'volume', ov, nv, true from pr union all select pair, 'pc_ratio', op, np, true from pr union all select pair, 'fibrosis_score', os, ns, false from pr)"""


def two_runs(t):
    r = t.runs.withColumns({"volume": F.col("volume") / 1e6, "pc_ratio": F.col("pc_ratio") / 1e5, "fibrosis_score": (F.col("total_branches") * 17 % 101).cast("double")})
    # Every run meets the next by name: F with O, O with P.
    def side(runs, first):
        pair = F.when(F.col("run") == first, ":F-O").otherwise(":O-P")
        return runs.withColumn("pair", F.concat(F.col("scan_id").cast("string"), pair))

    return side(r.where("run <> 'P'"), "F"), side(r.where("run <> 'F'"), "O")


def pairs(t):
    return C.pair_runs(*two_runs(t), "pair", METRICS)


@query("j11_run_pairs", "runs", PAIR_SQL + "select pair, metric, round(old,6) as old, round(new,6) as new from u")
def _(t):
    return pairs(t).select("pair", "metric", r6("old").alias("old"), r6("new").alias("new"))


@query("i01_change_rows", "runs", PAIR_SQL + """select pair, metric, round(old,6) as old, round(new,6) as new, round(new-old,6) as diff, round(case when old=0 then 0 else (new-old)/old*100 end,6) as pct_change,
 case when new-old is null then null when abs(new-old)<0.001 then 'same' when (new-old>0)=up then 'better' else 'worse' end as verdict from u""")
def _(t):
    return C.change_rows(pairs(t), C.HIGHER_IS_BETTER).select("pair", "metric", "verdict", *[r6(c).alias(c) for c in ("old", "new", "diff", "pct_change")])


@query("i02_generation_comparison", "branches_keyed", """, a as (select scan_id, generation, avg(diameter_mean_mm) as m from branches_keyed where branch_id%2=0 group by 1,2), b as (select scan_id, generation, avg(diameter_mean_mm) as m from branches_keyed where branch_id%2=1 group by 1,2)
select scan_id, generation, round(a.m,6) as old_mean, round(b.m,6) as new_mean, round(b.m-a.m,6) as diff from a join b using (scan_id,generation)""")
def _(t):
    b = t.branches_keyed
    g = C.generation_comparison(b.where("branch_id % 2 = 0"), b.where("branch_id % 2 = 1"), ["scan_id"], "diameter_mean_mm")
    return g.select("scan_id", "generation", *[r6(c).alias(c) for c in ("old_mean", "new_mean", "diff")])


@query("i03_key_findings", "runs", PAIR_SQL + """, w as (select pair, 'pc_ratio' as metric, case when np>op*1.1 then 'improved' when np<op*0.9 then 'regressed' end as finding from pr union all
 select pair, 'symmetry', case when nv>0.5 and ov<0.5 then 'corrected' when nv>ov*1.1 then 'improved' when nv<ov*0.9 then 'regressed' end from pr union all
 select pair, 'peripheral_branches', case when nb>ob*1.2 then 'improved' when nb<ob*0.8 then 'regressed' end from pr) select * from w where finding is not null""")
def _(t):
    old, new = two_runs(t)

    def side(df, s):
        return df.select("pair", F.col("pc_ratio").alias(f"{s}_pc_ratio"), F.col("volume").alias(f"{s}_symmetry"), F.col("total_branches").alias(f"{s}_peripheral_branches"))

    return C.key_findings(side(old, "old").join(side(new, "new"), "pair", "full_outer"), "pair")


SECTION = """, p as (select doc_id, body, strpos(body,'<article>') as a from texts), e as (select doc_id, body, a, case when a>0 then strpos(substr(body,a),'</article>') else 0 end as b from p)"""


@query("i04_combined_sections", "texts", SECTION + """select doc_id, chr(10)||chr(10)||repeat('=',80)||chr(10)||'CASE: '||doc_id||chr(10)||repeat('=',80)||chr(10)||chr(10)||substr(body,a,b-1) as block from e where b>0""")
def _(t):
    return C.combine_sections(C.extract_section(t.texts, "body", "<article>", "</article>"), "doc_id")


@query("i04_section_counts", "texts", SECTION + "select count(*) filter (where b>0) as successful, count(*) filter (where not b>0) as failed from e")
def _(t):
    return C.section_counts(C.extract_section(t.texts, "body", "<article>", "</article>"))


@query("i05_batch_outcomes", "runs", "select run<>'P' as success, case when run='P' then 'pending' end as error, count(*) as n from runs group by 1,2")
def _(t):
    return C.batch_outcomes(t.runs.select((F.col("run") != "P").alias("success"), F.when(F.col("run") == "P", "pending").alias("error")))
