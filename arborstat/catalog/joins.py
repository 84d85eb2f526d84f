"""Joins between cases, bags, visits and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborstat.catalog import query, r6
from arborstat.catalog.ordered import DECAY
from arborstat.operators import branches, joins as J, longitudinal as L


@query("j01_branch_tables", "branches_keyed", "select scan_id, branch_id, generation, round(diameter_mean_mm,6) as diameter_mean_mm, round(length_mm,6) as length_mm from branches_keyed")
def _(t):
    b = t.branches_keyed
    d = b.select("scan_id", "branch_id", "generation", "diameter_mean_mm")
    m = branches.merge_branch_tables(d, b.select("scan_id", "branch_id", "length_mm"))
    return m.select("scan_id", "branch_id", "generation", r6("diameter_mean_mm").alias("diameter_mean_mm"), r6("length_mm").alias("length_mm"))


DEMO = ", demo as (select distinct o_custkey as entity, o_orderstatus as smoking from orders)"


@query("j03_demographics", "visits", DECAY + DEMO + "select d.entity, round(av-bv,6) as drop_absolute, smoking from d left join demo using (entity)")
def _(t):
    demo = t.raw("orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("smoking"))
    j = J.join_demographics(L.decay_table(t.visits), demo, "entity")
    return j.select("entity", r6("drop_absolute").alias("drop_absolute"), "smoking")


@query("j04_integrated_dataset", "cases visits scored", """select c.case_id, c.grp, v.week, round(v.value,6) as value, round(c.m1,6) as m1, round(b.tortuosity,6) as tortuosity, round(p.entropy,6) as entropy from cases c join (select case_id, tortuosity from scored where tortuosity is not null) b using (case_id)
 join visits v on v.entity=c.case_id left join (select case_id, entropy from scored where entropy is not null) p using (case_id)""")
def _(t):
    cases = t.cases.select("case_id", F.col("case_id").alias("entity"), "grp", "m1")
    bags = t.scored.where("tortuosity is not null").select("case_id", "tortuosity")
    optional = t.scored.where("entropy is not null").select("case_id", "entropy")
    d = J.integrated_dataset(cases, bags, t.visits, optional, "case_id", "entity")
    return d.select("case_id", "grp", "week", *[r6(c).alias(c) for c in ("value", "m1", "tortuosity", "entropy")])


@query("j05_first_target", "cases visits", """, k as (select entity, value, week, row_number() over (partition by entity order by row_id) as rn from visits)
select case_id, grp, round(value,6) as value, week from cases join k on entity=case_id where rn=1""")
def _(t):
    targets = t.visits.select(F.col("entity").alias("case_id"), "value", "week", "row_id")
    return J.prediction_dataset(t.cases.select("case_id", "grp"), targets, "case_id", "row_id").select("case_id", "grp", r6("value").alias("value"), "week")


@query("j06_matched_cases", "cases visits", "select case_id, case_id in (select entity from visits where value>300) as has_target from cases")
def _(t):
    big = t.visits.where("value > 300").select(F.col("entity").alias("case_id"))
    have, skipped = J.with_match(t.cases.select("case_id"), big, "case_id")
    return have.withColumn("has_target", F.lit(True)).unionByName(skipped.withColumn("has_target", F.lit(False)))
