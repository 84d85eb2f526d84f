"""Binding views: the driver's tables in the shapes the operators work on.

Each view exists twice, as a DataFrame (:class:`Tables`) and as SQL text for the
side-by-side check (:func:`view_sql`). Views group or project; none needs a
per-key ordered window, so a key holding a large share of the rows stays spread.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def visits(self) -> DataFrame:
        """Repeated measurements: entity, row_id, week (may be negative), value."""
        return self.raw("orders").select(
            F.col("o_custkey").alias("entity"),
            F.col("o_orderkey").alias("row_id"),
            F.floor(F.datediff("o_orderdate", F.lit("1997-01-01").cast("date")) / F.lit(7.0)).cast("int").alias("week"),
            (F.col("o_totalprice") / 1000.0).alias("value"),
        )

    @cached_property
    def cases(self) -> DataFrame:
        """One row per case with six metrics; m6 has NULLs. Orders are folded before the join."""
        o = self.raw("orders").groupBy(F.col("o_custkey").alias("case_id")).agg(
            F.count("o_orderkey").alias("m2"), F.avg("o_totalprice").alias("m3"),
            F.max("o_totalprice").alias("m4"), F.min("o_totalprice").alias("m5"),
        )
        c = self.raw("customer").select(
            F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("grp"), F.col("c_acctbal").alias("m1")
        )
        return c.join(o, "case_id", "left").select(
            "case_id", "grp", "m1", F.coalesce("m2", F.lit(0)).alias("m2"), "m3", "m4", "m5",
            F.when(F.col("m1") >= 0, F.col("m1")).alias("m6"),
        )

    @cached_property
    def branches(self) -> DataFrame:
        """Branch measurements per scan; generation is NULL for some."""
        return self.raw("lineitem").select(
            F.col("l_suppkey").alias("scan_id"),
            F.when(~((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "A")), F.pmod("l_partkey", F.lit(17)).cast("int")).alias("generation"),
            (F.col("l_quantity") / 10.0).alias("diameter_mean_mm"),
            (1 + F.col("l_discount") * 100).alias("length_mm"),
        )

    @cached_property
    def branches_keyed(self) -> DataFrame:
        """Branches with a unique (scan_id, branch_id); repeated source rows are folded."""
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_suppkey").alias("scan_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("branch_id"))
            .agg(
                F.min(F.pmod("l_partkey", F.lit(17)).cast("int")).alias("generation"),
                (F.max("l_quantity") / 10.0).alias("diameter_mean_mm"),
                (1 + F.max("l_discount") * 100).alias("length_mm"),
            )
        )

    @cached_property
    def points(self) -> DataFrame:
        """Polyline points: (scan_id, branch_id) lines ordered by a sparse integer seq."""
        return (
            self.raw("lineitem")
            .groupBy(
                F.col("l_suppkey").alias("scan_id"), (F.col("l_orderkey") % 40).alias("branch_id"),
                (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
            )
            .agg(
                F.max("l_quantity").alias("x"), F.max(F.col("l_discount") * 100).alias("y"),
                F.max(F.col("l_tax") * 100).alias("z"), (F.max("l_quantity") / 10.0).alias("radius"),
            )
        )

    @cached_property
    def voxels(self) -> DataFrame:
        """4x4x4 grids: intensity hu and label 0/1 at integer (z, y, x)."""
        return self.raw("embeddings").select(F.col("vec_id").alias("scan_id"), F.posexplode("embedding").alias("pos", "v")).select(
            "scan_id", F.expr("cast(pos div 16 as int)").alias("z"), F.expr("cast((pos div 4) % 4 as int)").alias("y"),
            (F.col("pos") % 4).cast("int").alias("x"),
            (F.round(F.col("v").cast("double") * 1000).cast("int") - 700).alias("hu"),
            F.when(F.col("v") > 0.05, 1).otherwise(0).alias("label"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        """A forest over part keys: branch_id, src, dst, length. Parts of one size are roots: their edge is a self-loop."""
        return self.raw("part").select(
            F.col("p_partkey").alias("branch_id"),
            F.when((F.col("p_partkey") <= 0) | (F.col("p_size") == 50), F.col("p_partkey"))
            .when(F.col("p_size") % 2 == 0, F.floor(F.col("p_partkey") / F.lit(2.0)).cast("long")).otherwise(F.col("p_partkey") - 1).alias("src"),
            F.col("p_partkey").alias("dst"), (F.col("p_retailprice") / 100.0).alias("length"),
        )

    @cached_property
    def nodes(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("node"), F.col("p_size").alias("z"), (F.col("p_partkey") % 13).cast("int").alias("y"),
            (F.col("p_partkey") % 7).cast("int").alias("x"), (F.col("p_retailprice") / 100.0).alias("diameter"),
        )

    @cached_property
    def tags(self) -> DataFrame:
        """Long metadata bag: patient_id, tag, value (distinct)."""
        e = self.raw("events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
        return (
            e.select(F.col("user_id").alias("patient_id"), F.concat(F.lit("k"), (F.col("k") % 80).cast("string")).alias("tag"), F.col("event_type").alias("value"))
            .union(e.select("user_id", "event_type", (F.col("k") % 3).cast("string")))
            .union(e.select("user_id", F.lit("modality"), F.lit("A")))
            .distinct()
        )

    @cached_property
    def scans(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("scan_id"), F.col("p_type").alias("cohort"), (200 + F.col("p_size") * 20).alias("num_slices"),
            (F.lit(0.3) + (F.col("p_partkey") % 14) / F.lit(10.0)).alias("slice_thickness"),
            (F.lit(0.2) + F.col("p_size") / F.lit(50.0)).alias("xy_resolution"),
            F.concat(F.substring("p_brand", 1, 1), (F.col("p_size") + 25).cast("string"), F.lit("f")).alias("kernel"),
            F.col("p_brand").alias("pixel_type"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        return self.raw("orders").groupBy(F.col("o_custkey").alias("scan_id"), F.col("o_orderstatus").alias("run")).agg(
            F.count("*").alias("total_branches"), F.sum("o_totalprice").alias("volume"), F.avg("o_totalprice").alias("pc_ratio")
        )

    @cached_property
    def scored(self) -> DataFrame:
        """Metric vector per case with NULLs in most columns, sweeping the score bands."""
        k = F.col("c_custkey")

        def null_every(n, e):
            return F.when(k % n != 0, e)

        return self.raw("customer").select(
            k.alias("case_id"),
            null_every(11, (k % 80) / F.lit(100.0)).alias("pc_ratio"),
            null_every(13, F.lit(0.8) + (k % 25) / F.lit(10.0)).alias("tortuosity"),
            null_every(17, (k % 101) / F.lit(100.0)).alias("symmetry"),
            ((k % 21) / F.lit(100.0)).alias("peripheral_density"),
            null_every(7, F.lit(1.0) + (k % 30) / F.lit(10.0)).alias("peripheral_diameter"),
            null_every(5, (k % 67) * F.lit(1.0)).alias("peripheral_branch_volume"),
            null_every(3, (k % 41) * F.lit(1.0)).alias("peripheral_pct"),
            null_every(4, F.lit(3.5) + (k % 40) / F.lit(10.0)).alias("entropy"),
            null_every(4, F.lit(-950.0) + (k % 400)).alias("lung_density"),
            (F.lit(5000.0) + (k % 37) * 1000).alias("volume_mm3"),
            ((k % 61) / F.lit(60.0)).alias("generation_coverage"),
        )

    @cached_property
    def slices(self) -> DataFrame:
        """Slice positions; a repeated one stays, as :func:`slice_uniformity` counts it once itself."""
        return self.raw("lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_linenumber").alias("z"))

    @cached_property
    def reports(self) -> DataFrame:
        n = F.col("total_branches")
        return self.runs.select(
            "scan_id", "run",
            F.concat(
                F.lit("Total branches: "), n.cast("string"), F.lit("\nCentral: "), (n * 3).cast("string"), F.lit(" mm³ ("),
                n.cast("string"), F.lit(" branches)\nCLASSIFICATION: "), F.col("run"), F.lit("\n"),
            ).alias("body"),
        )

    @cached_property
    def texts(self) -> DataFrame:
        return self.raw("pages").select(F.col("page_id").alias("doc_id"), "url", F.col("html").alias("body"))


VIEWS: dict[str, str] = {
    "visits": "select o_custkey as entity, o_orderkey as row_id, cast(floor(date_diff('day', DATE '1997-01-01', cast(o_orderdate as date))/7.0) as int) as week, o_totalprice/1000.0 as value from orders",
    "cases": "select c.c_custkey as case_id, c.c_mktsegment as grp, c.c_acctbal as m1, count(o.o_orderkey) as m2, avg(o.o_totalprice) as m3, max(o.o_totalprice) as m4, min(o.o_totalprice) as m5, case when c.c_acctbal<0 then null else c.c_acctbal end as m6 from customer c left join orders o on o.o_custkey=c.c_custkey group by 1,2,3",
    "branches": "select l_suppkey as scan_id, case when l_linenumber=7 and l_returnflag='A' then null else cast(l_partkey % 17 as int) end as generation, l_quantity/10.0 as diameter_mean_mm, 1+l_discount*100 as length_mm from lineitem",
    "branches_keyed": "select l_suppkey as scan_id, l_orderkey*8+l_linenumber as branch_id, min(cast(l_partkey % 17 as int)) as generation, max(l_quantity)/10.0 as diameter_mean_mm, 1+max(l_discount)*100 as length_mm from lineitem group by 1,2",
    "points": "select l_suppkey as scan_id, l_orderkey % 40 as branch_id, l_orderkey*8+l_linenumber as seq, max(l_quantity) as x, max(l_discount*100) as y, max(l_tax*100) as z, max(l_quantity)/10.0 as radius from lineitem group by 1,2,3",
    "voxels": "select vec_id as scan_id, cast((i-1)//16 as int) as z, cast(((i-1)//4)%4 as int) as y, cast((i-1)%4 as int) as x, cast(round(cast(v as double)*1000) as int)-700 as hu, case when v>0.05 then 1 else 0 end as label from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding,1) as i from embeddings)",
    "edges": "select p_partkey as branch_id, case when p_partkey<=0 or p_size=50 then p_partkey when p_size%2=0 then cast(floor(p_partkey/2) as bigint) else p_partkey-1 end as src, p_partkey as dst, p_retailprice/100.0 as length from part",
    "nodes": "select p_partkey as node, p_size as z, cast(p_partkey % 13 as int) as y, cast(p_partkey % 7 as int) as x, p_retailprice/100.0 as diameter from part",
    "tags": "select distinct * from (select user_id as patient_id, 'k'||cast(cast(json_extract_string(props,'$.k') as int)%80 as varchar) as tag, event_type as value from events union all select user_id, event_type, cast(cast(json_extract_string(props,'$.k') as int)%3 as varchar) from events union all select user_id, 'modality', 'A' from events)",
    "scans": "select p_partkey as scan_id, p_type as cohort, 200+p_size*20 as num_slices, 0.3::double+(p_partkey%14)/10.0::double as slice_thickness, 0.2::double+p_size/50.0::double as xy_resolution, substr(p_brand,1,1)||cast(p_size+25 as varchar)||'f' as kernel, p_brand as pixel_type from part",
    "runs": "select o_custkey as scan_id, o_orderstatus as run, count(*) as total_branches, sum(o_totalprice) as volume, avg(o_totalprice) as pc_ratio from orders group by 1,2",
    "scored": "select case_id, case when case_id%11=0 then null else (case_id%80)/100.0::double end as pc_ratio, case when case_id%13=0 then null else 0.8::double+(case_id%25)/10.0::double end as tortuosity, case when case_id%17=0 then null else (case_id%101)/100.0::double end as symmetry, (case_id%21)/100.0::double as peripheral_density, case when case_id%7=0 then null else 1.0::double+(case_id%30)/10.0::double end as peripheral_diameter, case when case_id%5=0 then null else (case_id%67)*1.0::double end as peripheral_branch_volume, case when case_id%3=0 then null else (case_id%41)*1.0::double end as peripheral_pct, case when case_id%4=0 then null else 3.5::double+(case_id%40)/10.0::double end as entropy, case when case_id%4=0 then null else -950.0::double+(case_id%400) end as lung_density, 5000.0::double+(case_id%37)*1000 as volume_mm3, (case_id%61)/60.0::double as generation_coverage from (select c_custkey as case_id from customer)",
    "slices": "select distinct l_orderkey as scan_id, l_linenumber as z from lineitem",
    "reports": "select scan_id, run, 'Total branches: '||cast(total_branches as varchar)||chr(10)||'Central: '||cast(total_branches*3 as varchar)||' mm³ ('||cast(total_branches as varchar)||' branches)'||chr(10)||'CLASSIFICATION: '||run||chr(10) as body from runs",
    "texts": "select page_id as doc_id, url, html as body from pages",
}

_NEEDS = {"reports": ["runs"]}


def view_sql(names: list[str]) -> list[str]:
    """CTE texts of ``names``, each after the views it reads."""
    out: dict[str, str] = {}
    for n in names:
        for v in [*_NEEDS.get(n, []), n]:
            out[v] = f"{v} as ({VIEWS[v]})"
    return list(out.values())
