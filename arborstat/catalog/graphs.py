"""Graph, component and proximity operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborstat.catalog import query, r6
from arborstat.operators import components as C, graphs as G
from arborstat.plans.propagation import connected_components



def graph(t):
    return t.edges.select("*", F.lit(1).alias("scan_id")), t.nodes.select("*", F.lit(1).alias("scan_id"))


K = ["scan_id"]

DEG = """, ends as (select src as node from edges union all select dst from edges), dg as (select node, count(*) as d from ends group by 1),
deg as (select n.node, coalesce(d,0) as degree from nodes n left join dg using (node)),
root as (select arg_max(node, (degree>=2, case when degree>=2 then diameter end, case when degree>=2 then z end, degree, -node)) as root from deg join nodes using (node))"""
COMP = """, arcs as (select src as a, dst as b from edges union select dst, src from edges),
reach as (select node, node as other from nodes union select r.node, arcs.b from reach r join arcs on arcs.a=r.other),
comp as (select node, min(other) as component from reach group by 1)"""
ROOTS = """, mroot as (select component, arg_max(node,(degree,-node)) as root from comp join deg using (node) group by 1),
roots as (select m.component, case when m.component=(select component from comp where node=(select root from root)) then (select root from root) else m.root end as root from mroot m)"""
TREE = """, tree as (select root as node, -1 as gen, null::bigint as parent, 0 as hop from roots union all
 select arcs.b, t.gen+case when deg.degree>=3 then 1 else 0 end, t.node, t.hop+1 from tree t join arcs on arcs.a=t.node join deg on deg.node=t.node where arcs.b is distinct from t.parent and arcs.b<>t.node)"""


@query("g01_simple_graph", "edges", """, e as (select *, least(src,dst) as a, greatest(src,dst) as b from (select * from edges union all select branch_id+1000000, dst, src, length*2 from edges where branch_id%3=0)),
k as (select *, row_number() over (partition by a,b order by branch_id desc) as rn from e) select a as src, b as dst, branch_id, round(length,6) as length from k where rn=1""")
def _(t):
    twice = t.edges.unionByName(t.edges.where("branch_id % 3 = 0").select((F.col("branch_id") + 1000000).alias("branch_id"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("length") * 2).alias("length")))
    return G.simple_graph(twice, [], ["length"]).withColumn("length", r6("length"))


@query("g02_bifurcations", "edges nodes", DEG + COMP + ROOTS + TREE + "select node, degree, gen as generation, z, y, x from deg join nodes using (node) join tree using (node) where degree>=3")
def _(t):
    e, n = graph(t)
    gen, _ = G.assign_generations(e, n, K)
    return G.bifurcations(n, G.degrees(e, n, K), gen, K).select("node", "degree", "generation", "z", "y", "x")


@query("g03_connected_components", "edges nodes", COMP + "select * from comp")
def _(t):
    return connected_components(t.edges, t.nodes, [])


@query("g04_root_selection", "edges nodes", DEG + "select root from root")
def _(t):
    e, n = graph(t)
    return G.select_root(n, G.degrees(e, n, K), K).select("root")


@query("g05_node_generations", "edges nodes", DEG + COMP + ROOTS + TREE + "select node, gen as generation from tree")
def _(t):
    e, n = graph(t)
    return G.assign_generations(e, n, K)[0].select("node", "generation")


@query("g05_edge_generations", "edges nodes", DEG + COMP + ROOTS + TREE + "select branch_id, least(src,dst) as src, greatest(src,dst) as dst, gen as generation from edges left join tree on (tree.node=edges.dst and tree.parent=edges.src) or (tree.node=edges.src and tree.parent=edges.dst)")
def _(t):
    e, n = graph(t)
    return G.assign_generations(e, n, K)[1].select("branch_id", "src", "dst", "generation")


DIST = DEG + """, arcs as (select src as a, dst as b, length as l from edges union all select dst, src, length from edges),
dist as (select root as node, null::bigint as parent, 0::double as d from root union all select arcs.b, t.node, t.d+arcs.l from dist t join arcs on arcs.a=t.node where arcs.b is distinct from t.parent and arcs.b<>t.node),
bd as (select branch_id, case when a.d is not null and b.d is not null then case when a.d<b.d then src else dst end when a.d is not null then src when b.d is not null then dst else src end as proximal_node,
 case when a.d is not null and b.d is not null then case when a.d<b.d then dst else src end when a.d is not null then dst when b.d is not null then src else dst end as distal_node,
 coalesce(least(a.d,b.d),a.d,b.d) as pd, case when a.d is not null and b.d is not null then greatest(a.d,b.d) else coalesce(a.d,b.d)+length end as dd
 from edges left join dist a on a.node=src left join dist b on b.node=dst)"""


def distances(t):
    e, n = graph(t)
    deg = G.degrees(e, n, K)
    return e, n, deg, G.path_distances(e, G.select_root(n, deg, K), K)


@query("g06_path_distances", "edges nodes", DIST + "select node, round(d,6) as distance from dist")
def _(t):
    return distances(t)[3].select("node", r6("distance").alias("distance"))


@query("g06_endpoint_summary", "edges nodes", DIST + "select count(*) as n_endpoints, round(min(d),6) as min_distance, round(max(d),6) as max_distance, round(avg(d),6) as mean_distance from deg join dist using (node) where degree=1")
def _(t):
    _, _, deg, d = distances(t)
    s = G.endpoint_summary(d, deg, K)
    return s.select("n_endpoints", *[r6(c).alias(c) for c in ("min_distance", "max_distance", "mean_distance")])


@query("j02_branch_distances", "edges nodes", DIST + "select branch_id, proximal_node, distal_node, round(pd,6) as proximal_distance, round(dd,6) as distal_distance, round(length,6) as length from edges left join bd using (branch_id)")
def _(t):
    e, _, _, d = distances(t)
    b = G.branch_distances(e, d, K)
    return e.join(b, [*K, "branch_id"], "left").select("branch_id", "proximal_node", "distal_node", *[r6(c).alias(c) for c in ("proximal_distance", "distal_distance", "length")])


@query("g07_symmetry", "edges nodes", DEG + """, nb as (select dst as node from edges, root where src=root and dst<>src union select src from edges, root where dst=root and dst<>src),
nz as (select node, z, row_number() over (order by z,node) as i, count(*) over () as n, min(z) over () as lo, max(z) over () as hi from nb join nodes using (node)),
sd as (select node, case when i<=n//2 then 'left' else 'right' end as side from nz where n>=2 and lo<hi),
arcs as (select src as a, dst as b from edges union select dst, src from edges),
rc as (select side, node from sd union select rc.side, arcs.b from rc join arcs on arcs.a=rc.node where arcs.b<>(select root from root)),
c as (select count(*) filter (where side='left') as l, count(*) filter (where side='right') as r from rc)
select nullif(l,0) as left_side_branch_count, nullif(r,0) as right_side_branch_count, round(case when l>0 and r>0 then least(l,r)::double/greatest(l,r) end,6) as symmetry_index from c""")
def _(t):
    e, n = graph(t)
    root = G.select_root(n, G.degrees(e, n, K), K)
    return G.symmetry(e, n, root, K).select("left_side_branch_count", "right_side_branch_count", r6("symmetry_index").alias("symmetry_index"))


@query("j09_nearest_node", "nodes", "select arg_min(node,(sqrt((z-25)*(z-25)+(y-6)*(y-6)+(x-3)*(x-3)),node)) as node, round(min(sqrt((z-25)*(z-25)+(y-6)*(y-6)+(x-3)*(x-3))),6) as distance from nodes")
def _(t):
    n = t.nodes.select("*", F.lit(1).alias("scan_id"))
    target = n.groupBy("scan_id").agg(F.lit(25).alias("tz"), F.lit(6).alias("ty"), F.lit(3).alias("tx"))
    return G.nearest_node(n, target, K).select("node", r6("distance").alias("distance"))


PRUNE = "".join(
    f""", n{i} as (select src as node from p{i - 1} union all select dst from p{i - 1}), e{i} as (select node from n{i} group by 1 having count(*)=1),
 p{i} as (select * from p{i - 1} where not (length<12 and (src in (select node from e{i}) or dst in (select node from e{i}))))""" for i in (1, 2, 3)
)


@query("g14_prune_short_ends", "edges", ", p0 as (select * from edges)" + PRUNE + "select branch_id, src, dst, round(length,6) as length from p3")
def _(t):
    return G.prune_short_ends(t.edges, [], 12.0).select("branch_id", "src", "dst", r6("length").alias("length"))


# --- voxel components ---------------------------------------------------------------

VC = """, v as (select scan_id, z::bigint*4398046511104+y::bigint*2097152+x as node, z, y, x, hu from voxels where label>0),
ve as (select a.scan_id, a.node as a, b.node as b from v a join v b on a.scan_id=b.scan_id and a.node<>b.node and abs(a.z-b.z)<=1 and abs(a.y-b.y)<=1 and abs(a.x-b.x)<=1),
vr as (select scan_id, node, node as other from v union select r.scan_id, r.node, e.b from vr r join ve e on e.scan_id=r.scan_id and e.a=r.other),
vl as (select scan_id, node, min(other) as component from vr group by 1,2), vc as (select v.*, component from v join vl using (scan_id,node)),
cs as (select scan_id, component, count(*) as n, avg(hu) as mean_hu, avg(z) as cz, avg(y) as cy, avg(x) as cx, min(z) as z0, max(z) as z1, min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1, row_number() over (partition by scan_id order by count(*) desc, component) as rk from vc group by 1,2)"""
# Spacing used below: (0.7, 0.7, 1.25) mm as (x, y, z).
VD = VC + """, dm as (select a.scan_id, a.component, min(sqrt(pow((a.z-b.z)*1.25,2)+pow((a.y-b.y)*0.7,2)+pow((a.x-b.x)*0.7,2))) as dist from vc a join cs ca on ca.scan_id=a.scan_id and ca.component=a.component and ca.rk>1
 join vc b on b.scan_id=a.scan_id join cs cb on cb.scan_id=b.scan_id and cb.component=b.component and cb.rk=1 group by 1,2)"""
SP = (0.7, 0.7, 1.25)


def comp(t):
    from arborstat.session import cut_lineage

    c = cut_lineage(C.voxel_components(t.voxels))
    return c, cut_lineage(C.component_stats(c, SP))


@query("g03_voxel_components", "voxels", VC + "select scan_id, z, y, x, component from vc")
def _(t):
    return C.voxel_components(t.voxels).select("scan_id", "z", "y", "x", "component")


@query("e21_component_stats", "voxels", VC + """select scan_id, component, n as voxel_count, round(n*0.7*0.7*1.25::double,6) as volume_mm3, round(mean_hu,6) as mean_hu, round(cz,6) as centroid_z, round(cy,6) as centroid_y, round(cx,6) as centroid_x,
 z0 as bbox_min_z, z1 as bbox_max_z, y0 as bbox_min_y, y1 as bbox_max_y, x0 as bbox_min_x, x1 as bbox_max_x, round((z1-z0)*1.25::double,6) as extent_z_mm, round((y1-y0)*0.7::double,6) as extent_y_mm, round((x1-x0)*0.7::double,6) as extent_x_mm from cs""")
def _(t):
    _, s = comp(t)
    floats = [c for c in s.columns if c.startswith(("volume", "mean", "centroid", "extent"))]
    return s.withColumns({c: r6(c) for c in floats})


@query("e21_fragmentation", "voxels", VC + """select scan_id, count(*) as n_components, max(n) filter (where rk=1) as main_voxels, coalesce(max(n) filter (where rk=2),0) as second_voxels,
 round(100.0*max(n) filter (where rk=1)/sum(n)::double,6) as main_percentage, round(coalesce(max(n) filter (where rk=2),0)::double/max(n) filter (where rk=1),6) as fragmentation_ratio from cs group by 1""")
def _(t):
    _, s = comp(t)
    return C.fragmentation(s).withColumns({c: r6(c) for c in ("main_percentage", "fragmentation_ratio")})


@query("j10_closest_pair", "voxels", VD + "select scan_id, component, round(dist,6) as distance from dm")
def _(t):
    c, s = comp(t)
    return C.distance_to_main(c, s, SP).select("scan_id", "component", r6("distance").alias("distance"))


@query("g08_component_triage", "voxels", VD + """select scan_id, component, n as voxel_count, round(dist,6) as distance, case when dist<=1.5 and n>=2 then 'reconnect' when n>6 then 'keep' when n<2 then 'remove' else 'keep' end as action from dm join cs using (scan_id,component)""")
def _(t):
    c, s = comp(t)
    return C.triage(c, s, 1.5, 2, 6, SP).select("scan_id", "component", "voxel_count", r6("distance").alias("distance"), "action")


@query("g08_triage_counts", "voxels", VD + """, a as (select n, case when dist<=1.5 and n>=2 then 'reconnect' when n>6 then 'keep' when n<2 then 'remove' else 'keep' end as action from dm join cs using (scan_id,component))
select action, count(*) as n_components, sum(n)::bigint as n_voxels from a group by 1""")
def _(t):
    c, s = comp(t)
    return C.triage_counts(C.triage(c, s, 1.5, 2, 6, SP))


@query("g09_force_link", "voxels", VC + """, p as (select scan_id, max(component) filter (where rk=1) as c1, max(component) filter (where rk=2) as c2 from cs group by 1 having max(n) filter (where rk=2)>0.2*max(n) filter (where rk=1))
select scan_id, c1 as component, round(min(sqrt(pow((a.z-b.z)*1.25,2)+pow((a.y-b.y)*0.7,2)+pow((a.x-b.x)*0.7,2))),6) as distance from p join vc a using (scan_id) join vc b using (scan_id) where a.component=c1 and b.component=c2 group by 1,2""")
def _(t):
    c, s = comp(t)
    return C.force_link(c, s, 0.20, SP).select("scan_id", "component", r6("distance").alias("distance"))


@query("g11_remove_small", "voxels", VC + "select scan_id, z, y, x, component from vc join cs using (scan_id,component) where n>=3 or rk=1")
def _(t):
    c, s = comp(t)
    return C.remove_small(c, s, 2, 1.9, 0.7 * 0.7 * 1.25).select("scan_id", "z", "y", "x", "component")


@query("g11_remove_isolated", "voxels", VD + "select scan_id, z, y, x, component from vc left join dm using (scan_id,component) where dist is null or dist<=2.5")
def _(t):
    c, s = comp(t)
    return C.remove_isolated(c, s, 2.5, SP).select("scan_id", "z", "y", "x", "component")


@query("g11_spurious_components", "voxels", VD + """, q as (select scan_id, component, n, dist, mean_hu, greatest((z1-z0+1)*1.25,(y1-y0+1)*0.7,(x1-x0+1)*0.7)::double/least((z1-z0+1)*1.25,(y1-y0+1)*0.7,(x1-x0+1)*0.7)::double as el from dm join cs using (scan_id,component))
select scan_id, component, n as voxel_count, round(dist,6) as distance, round(el,6) as elongation, round(mean_hu,6) as mean_hu from q where el<1.5 and dist>1.5 and mean_hu>-650 and n<15""")
def _(t):
    c, s = comp(t)
    return C.spurious(c, s, 1.5, (0.7, 0.7, 1.25)).withColumns({k: r6(k) for k in ("distance", "elongation", "mean_hu")})


@query("g12_keep_largest", "voxels", VC + "select scan_id, z, y, x from vc join cs using (scan_id,component) where rk=1")
def _(t):
    c, s = comp(t)
    return C.keep_largest(c, s).select("scan_id", "z", "y", "x")


@query("g13_reconnection", "voxels", VC + """, lk as (select distinct a.scan_id, a.component as a, b.component as b from vc a join vc b on a.scan_id=b.scan_id and a.component<>b.component join cs ca on ca.scan_id=a.scan_id and ca.component=a.component and (ca.n>=2 or ca.rk=1) join cs cb on cb.scan_id=b.scan_id and cb.component=b.component and (cb.n>=2 or cb.rk=1)
  where sqrt(pow((a.z-b.z)*1.25,2)+pow((a.y-b.y)*0.7,2)+pow((a.x-b.x)*0.7,2))<=2.2),
rr as (select scan_id, component from cs where rk=1 union select rr.scan_id, lk.b from rr join lk on lk.scan_id=rr.scan_id and lk.a=rr.component)
select cs.scan_id, cs.component, n as voxel_count, rr.component is not null as reconnected from cs left join rr on rr.scan_id=cs.scan_id and rr.component=cs.component""")
def _(t):
    c, s = comp(t)
    return C.reconnect(c, s, 2.2, 2, SP)


@query("g13_growing_reconnection", "voxels", VC + """, pd as (select a.scan_id, ca.rk as r, cb.rk as s, min(sqrt(pow((a.z-b.z)*1.25,2)+pow((a.y-b.y)*0.7,2)+pow((a.x-b.x)*0.7,2))) as d
  from cs ca join cs cb on ca.scan_id=cb.scan_id and cb.rk<ca.rk and ca.rk<=11 and ca.n>=2 and (cb.n>=2 or cb.rk=1) join vc a on a.scan_id=ca.scan_id and a.component=ca.component join vc b on b.scan_id=cb.scan_id and b.component=cb.component group by 1,2,3),
pl as (select scan_id, r, list({'s': s, 'd': d}) as near from pd group by 1,2),
g as (select scan_id, 1::bigint as k, [1::bigint] as joined, null::double as d from cs where rk=1
  union all select scan_id, k, case when d<=2.2 then list_append(joined,k) else joined end, d from (select g.scan_id, g.k+1 as k, g.joined, list_min(list_transform(list_filter(pl.near, lambda p: list_contains(g.joined, p.s)), lambda p: p.d)) as d
   from g left join pl on pl.scan_id=g.scan_id and pl.r=g.k+1 where g.k<11))
select cs.scan_id, cs.component, rk::int as rank, n as voxel_count, round(d,6) as distance, d<=2.2 as reconnected from g join cs on cs.scan_id=g.scan_id and cs.rk=g.k where k>1 and d is not null""")
def _(t):
    c, s = comp(t)
    return C.grow_main(c, s, 2.2, 2, 10, SP).withColumn("distance", r6("distance"))


CAND = """, cd as (select l_suppkey as scan_id, l_orderkey*8+l_linenumber as seq, max(l_returnflag) as method, max(l_quantity)::int as z, (max(l_partkey)%400)::int as y, (max(l_orderkey)%400)::int as x, 1+max(l_discount)*10 as weight from lineitem group by 1,2),
sc as (select a.scan_id, a.seq, a.method, a.z, a.y, a.x, a.weight+coalesce(sum(b.weight*(1-sqrt((a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x))/25.0::double)),0) as score from cd a left join cd b on a.scan_id=b.scan_id and a.seq<>b.seq
  and (a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)<625 group by a.scan_id,a.seq,a.method,a.z,a.y,a.x,a.weight),
k as (select *, row_number() over (partition by scan_id order by round(score,9) desc, seq) as rn, count(*) over (partition by scan_id) as n from sc)"""


@query("j13_consensus_vote", "", CAND + "select scan_id, method, z, y, x, round(least(5,score/n),6) as confidence from k where rn=1")
def _(t):
    cand = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("scan_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq")).agg(
        F.max("l_returnflag").alias("method"), F.max("l_quantity").cast("int").alias("z"), (F.max("l_partkey") % 400).cast("int").alias("y"),
        (F.max("l_orderkey") % 400).cast("int").alias("x"), (1 + F.max("l_discount") * 10).alias("weight"),
    )
    return C.consensus(cand).withColumn("confidence", r6("confidence"))
