"""Sources and sinks (A1-A11). Inputs are the given tables, written out and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from arborstat.catalog import query, r6
from arborstat.operators import scoring
from arborstat.functions import scores
from arborstat.session import checkpoint_root
from arborstat.sources import readers as R, writers as W


def folder(t, name: str) -> str:
    return f"{checkpoint_root(t.spark)}/arborstat-{name}-{uuid.uuid4().hex}"


@query("a01_typed_csv", "visits", "select entity, row_id, week, round(value,6) as value, case when row_id % 50 <> 0 then round(value,6) end as with_gaps from visits")
def _(t):
    p = folder(t, "csv")
    gaps = F.when(F.col("row_id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    W.write_table(t.visits.select("entity", "row_id", "week", "value", gaps.alias("with_gaps")), p, "csv")
    back = R.read_csv(t.spark, p, "entity long, row_id long, week int, value double, with_gaps double")
    return R.require_columns(back, ["entity", "week", "value"]).withColumns({"value": r6("value"), "with_gaps": r6("with_gaps")})


#: Rows whose week is no number, whose last field is missing, and whose value has a unit.
BROKEN_CSV = """, m as (select *, case when row_id%97=0 then 'not a number: week' when row_id%101=0 then 'wrong number of fields' when row_id%103=0 then 'not a number: value' end as reason from visits)"""


def csv_with_broken_rows(t):
    p = folder(t, "broken")
    k = F.col("row_id")
    fields = [F.col("entity").cast("string"), k.cast("string"), F.when(k % 97 == 0, "six").otherwise(F.col("week").cast("string")), F.when((k % 97 != 0) & (k % 101 != 0) & (k % 103 == 0), "71 ml").otherwise(F.col("value").cast("string"))]
    line = F.when((k % 97 != 0) & (k % 101 == 0), F.concat_ws(",", *fields[:3])).otherwise(F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields]))
    t.visits.select(line.alias("value")).write.text(p)
    return R.read_csv_checked(t.spark, p, "entity long, row_id long, week int, value double", header=False)


@query("a01_csv_accepted", "visits", BROKEN_CSV + "select entity, row_id, week, round(value,6) as value from m where reason is null")
def _(t):
    return csv_with_broken_rows(t)[0].withColumn("value", r6("value"))


@query("a01_csv_rejected", "visits", BROKEN_CSV + "select reason, count(*) as n, sum(row_id)::bigint as row_ids from m where reason is not null group by 1")
def _(t):
    bad = csv_with_broken_rows(t)[1].withColumn("row_id", F.split("record", ",")[1].cast("long"))
    return bad.groupBy("reason").agg(F.count("*").alias("n"), F.sum("row_id").alias("row_ids"))


@query("a03_documents_rejected", "", """select case when c_custkey%89=0 then 'unreadable' else 'not a number: total_volume_mm3' end as reason, cast(c_nationkey as varchar) as "case", count(*) as n from customer where c_custkey%89=0 or c_custkey%83=0 group by 1,2""")
def _(t):
    return broken_documents(t)[1].groupBy("reason", "case").agg(F.count("*").alias("n"))


@query("a03_documents_accepted", "", "select c_custkey, round(c_acctbal,6) as total_volume_mm3 from customer where c_custkey%89<>0 and c_custkey%83<>0")
def _(t):
    return broken_documents(t)[0].select("c_custkey", r6("total_volume_mm3").alias("total_volume_mm3"))


def broken_documents(t):
    p = folder(t, "bags")
    k = F.col("c_custkey")
    whole = F.to_json(F.struct("c_custkey", F.when(k % 83 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("total_volume_mm3")))
    line = F.when(k % 89 == 0, F.substring(whole, 1, 9)).otherwise(whole)
    t.raw("customer").select("c_nationkey", line.alias("value")).write.partitionBy("c_nationkey").text(p)
    return R.read_documents_checked(t.spark, p, {"c_custkey": "long", "total_volume_mm3": "double"}, r"c_nationkey=(\d+)/", multiline=False)


@query("a02_optional_columns", "cases", "select case_id, round(m1,6) as m1, null::double as entropy from cases")
def _(t):
    c = R.with_optional(R.require_columns(t.cases.select("case_id", "m1"), ["case_id", "m1"]), {"entropy": "double"})
    return c.withColumn("m1", r6("m1"))


def documents(t):
    p = folder(t, "json")
    bags = t.raw("customer").select("c_nationkey", "c_custkey", F.col("c_acctbal").cast("string").alias("total_volume_mm3"), "c_mktsegment")
    W.write_table(bags, p, "json", ["c_nationkey"])
    return R.read_documents(t.spark, p, {"c_custkey": "long", "total_volume_mm3": "double"}, r"c_nationkey=(\d+)/", multiline=False)


@query("a03_json_documents", "", "select c_custkey, round(c_acctbal,6) as total_volume_mm3 from customer")
def _(t):
    return documents(t).select("c_custkey", r6("total_volume_mm3").alias("total_volume_mm3"))


@query("a04_directory_key", "", "select cast(c_nationkey as varchar) as \"case\", count(*) as n, round(sum(c_acctbal),6) as total from customer group by 1")
def _(t):
    return documents(t).groupBy("case").agg(F.count("*").alias("n"), r6(F.sum("total_volume_mm3")).alias("total"))


@query("a05_discover_entities", "", "select distinct cast(c_nationkey as varchar) as entity, true as has_files from customer where c_nationkey not in (3,7)")
def _(t):
    p = folder(t, "files")
    W.write_table(t.raw("customer").select("c_nationkey", "c_name"), p, "csv", ["c_nationkey"])
    e = R.discover_entities(R.list_files(t.spark, p, "*.csv"), r"c_nationkey=(\d+)/", ("3", "7"))
    return e.select("entity", (F.col("n_files") > 0).alias("has_files"))


@query("a06_position_sample", "", """, e as (select user_id, event_id, row_number() over (partition by user_id order by event_id)-1 as i, count(*) over (partition by user_id) as n from events)
select user_id, event_id from e where n<=30 or i<10 or i>=n-10 or (i>=n//2-5 and i<n//2+5)""")
def _(t):
    return R.sample_positions(t.raw("events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("a07_file_inventory", "", """, d as (select doc_id%7 as part, case when doc_id%2=0 then 'mhd' else 'raw' end as ext, text from documents)
select part||'_scan' as stem, count(distinct ext) as n_files, sum(strlen(text)+1)::bigint as n_bytes from d group by part""")
def _(t):
    """A header and a data file per stem, each holding half of the texts of a seventh of the documents."""
    p = folder(t, "inventory")
    d = t.raw("documents").select((F.col("doc_id") % 7).alias("part"), F.when(F.col("doc_id") % 2 == 0, "mhd").otherwise("raw").alias("ext"), "text")
    W.write_table(d.repartition("part", "ext"), p, "text", ["part", "ext"])
    # Files get their names from the writer; folder and extension name the member.
    files = R.list_files(t.spark, p, "*.txt").withColumn("path", F.regexp_replace("path", r"part=(\d+)/ext=(\w+)/.*$", "$1_scan.$2"))
    members = files.groupBy("path").agg(F.sum("length").alias("length"))
    return R.file_inventory(members)


@query("a08_copy_integrity", "", "select doc_id, md5(text) as original_digest, doc_id%97<>0 as digest_equal, doc_id%97<>0 as size_equal, doc_id%97<>0 as all_checks_passed from documents")
def _(t):
    p = folder(t, "copy")
    d = t.raw("documents").select("doc_id", "text")
    W.write_table(d.withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), p, "json")
    copy = t.spark.read.schema("doc_id long, text string").json(p)
    return R.copy_integrity(d, copy, "doc_id", "text").select("doc_id", "original_digest", "digest_equal", "size_equal", "all_checks_passed")


@query("a09_partitioned_write", "cases", "select case_id, grp, m2 from cases")
def _(t):
    p = folder(t, "out")
    W.write_table(t.cases.select("case_id", "grp", "m2"), p, "parquet", ["grp"])
    return t.spark.read.parquet(p).select("case_id", "grp", "m2")


@query("a09_assessment_documents", "scored", "select case_id, 7::int as n_components, round(0.35*10*case when peripheral_density is null then 5 when peripheral_density<0.03 then 10 when peripheral_density<0.05 then 7+(0.05-peripheral_density)/0.02*3 when peripheral_density<0.08 then 4+(0.08-peripheral_density)/0.03*3 when peripheral_density<=0.15 then greatest(0,4-(peripheral_density-0.08)/0.07*4) else 0 end,6) as density_weighted from scored")
def _(t):
    names = [*scores.WEIGHTS_AIRWAY, "parenchymal_entropy", "parenchymal_density"]
    wa, wc = F.lit(0.0), F.lit(0.0)
    for n in names:
        wa = F.when(F.col("component") == n, scores.WEIGHTS_AIRWAY.get(n, 0.0)).otherwise(wa)
        wc = F.when(F.col("component") == n, scores.WEIGHTS_COMBINED.get(n, 0.0)).otherwise(wc)
    comps = scoring.score_components(t.scored, "case_id", names, "rescorer").withColumns({"weight_airway": wa, "weight_combined": wc})
    doc = W.assessment_document(scoring.assess(t.scored, "case_id", "rescorer"), "case_id", comps)
    p = folder(t, "assess")
    W.write_table(doc, p, "json")
    back = t.spark.read.schema(doc.schema).json(p)
    return back.select("case_id", F.size("components").alias("n_components"), r6(F.col("components")["peripheral_density"]["weighted_score_airway"]).alias("density_weighted"))


@query("a10_text_reports", "reports", """, l as (select run, unnest(string_split(body,chr(10))) as line from reports) select run as "case", split_part(line,':',1) as label, count(*) as n from l where line<>'' group by 1,2""")
def _(t):
    p = folder(t, "text")
    t.reports.select("run", F.concat("body", F.lit("\f")).alias("body")).write.partitionBy("run").text(p)
    lines = R.read_reports(t.spark, p, r"run=([^/]+)/", separator="\f\n").select("case", F.explode(F.split("body", "\n")).alias("line")).where("line <> ''")
    return lines.groupBy("case", F.split_part("line", F.lit(":"), F.lit(1)).alias("label")).agg(F.count("*").alias("n"))


@query("a11_companion_fallback", "scans", "select scan_id, case when scan_id%3=0 then scan_id||'_full' when scan_id%2=0 then scan_id||'_plain' end as companion from scans")
def _(t):
    s = t.scans.select("scan_id")

    def variant(cond, suffix):
        return s.where(cond).select("scan_id", F.concat(F.col("scan_id").cast("string"), F.lit(suffix)).alias("path"))

    return R.companion(s, [variant("scan_id % 3 = 0", "_full"), variant("scan_id % 2 = 0", "_plain")], "scan_id")
