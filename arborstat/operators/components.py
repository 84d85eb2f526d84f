"""Voxel components: labelling, statistics, filters, triage and reconnection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborstat.functions.numeric import ratio
from arborstat.operators.voxels import POSITION, overlapping, voxel_runs
from arborstat.plans.propagation import connected_components
from arborstat.session import cut_and_count, cut_lineage, spread
from arborstat.plans.proximity import closest_pairs, linked_groups, within_radius


def voxel_id(z: Column, y: Column, x: Column) -> Column:
    """Order-keeping 64-bit id of a position; 21 bits per axis, and an error for positions outside them."""
    inside = F.lit(True)
    for c in (z, y, x):
        inside = inside & c.between(0, (1 << 21) - 1)
    number = F.shiftleft(z.cast("long"), 42) + F.shiftleft(y.cast("long"), 21) + x.cast("long")
    return F.when(inside, number).otherwise(F.raise_error(F.lit("voxel positions go from 0 to 2097151")).cast("long"))


def voxel_components(voxels: DataFrame, faces_only: bool = False) -> DataFrame:
    """Masked voxels with ``component``: 26-neighbour (or face) connected, id of the first voxel.

    Runs along x are the nodes, so a solid region costs a node per scan line and not a
    node per voxel. Runs of neighbouring lines touch when they overlap, by one voxel
    more for diagonal neighbours.
    """
    v = voxels.where("label > 0").select(*POSITION, "hu")
    runs, n = cut_and_count(voxel_runs(v).withColumn("node", voxel_id(F.col("z"), F.col("y"), F.col("x0"))), F.lit(True))
    runs = spread(runs, n)
    ahead = [(0, 1), (1, 0)] if faces_only else [(0, 1), (1, -1), (1, 0), (1, 1)]
    reach = 0 if faces_only else 1
    lines = F.array(*[F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy")) for dz, dy in ahead])
    sent = runs.select("scan_id", "x0", "x1", F.col("node").alias("src"), "z", "y", F.explode(lines).alias("o")).select(
        "scan_id", (F.col("z") + F.col("o.dz")).alias("z"), (F.col("y") + F.col("o.dy")).alias("y"), "src", F.col("x0").alias("a0"), F.col("x1").alias("a1")
    )
    edges = overlapping(runs, sent, reach).select("scan_id", "src", F.col("node").alias("dst"))
    labelled = runs.join(spread(connected_components(edges, runs, ["scan_id"]), n), ["scan_id", "node"])
    return spread(labelled.select("scan_id", "z", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "component"), n).join(v, POSITION)


def component_stats(comp: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Size, volume, centroid, bounding box and extents of every component."""
    sx, sy, sz = spacing
    a = [F.count("*").alias("voxel_count"), (F.count("*") * F.lit(sx * sy * sz)).alias("volume_mm3"), F.avg("hu").alias("mean_hu")]
    for c, s in (("z", sz), ("y", sy), ("x", sx)):
        a += [
            F.avg(c).alias(f"centroid_{c}"), F.min(c).alias(f"bbox_min_{c}"), F.max(c).alias(f"bbox_max_{c}"),
            ((F.max(c) - F.min(c)) * F.lit(s)).alias(f"extent_{c}_mm"),
        ]
    return comp.groupBy("scan_id", "component").agg(*a)


def largest(stats: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` largest components per scan with their rank; the first id wins ties."""
    w = Window.partitionBy("scan_id").orderBy(F.desc("voxel_count"), "component")
    return stats.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fragmentation(stats: DataFrame) -> DataFrame:
    """Number of components, main share, second size and second/main per scan."""
    top = largest(stats, 2).groupBy("scan_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("voxel_count"))).alias("main_voxels"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("voxel_count"))), F.lit(0)).alias("second_voxels"),
    )
    n = stats.groupBy("scan_id").agg(F.count("*").alias("n_components"), F.sum("voxel_count").alias("total"))
    return n.join(spread(top), "scan_id").select(
        "scan_id", "n_components", "main_voxels", "second_voxels", (ratio("main_voxels", "total") * 100).alias("main_percentage"),
        ratio("second_voxels", "main_voxels").alias("fragmentation_ratio"),
    )


def split_main(comp: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(voxels of the main component, voxels of the others)."""
    main = spread(largest(stats).select("scan_id", "component"))
    return comp.join(main, ["scan_id", "component"], "left_semi"), comp.join(main, ["scan_id", "component"], "left_anti")


def distance_to_main(comp: DataFrame, stats: DataFrame, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Exact closest pair of every other component and the main one."""
    main, rest = split_main(comp, stats)
    return closest_pairs(rest, main.select(*POSITION), ["scan_id"], "component", spacing)


def triage(comp: DataFrame, stats: DataFrame, reconnect_mm: float, min_voxels: int, keep_voxels: int, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Action per non-main component: reconnect, keep or remove, judged on the original main component."""
    d = distance_to_main(comp, stats, spacing).join(spread(stats), ["scan_id", "component"])
    n = F.col("voxel_count")
    action = (
        F.when((F.col("distance") <= reconnect_mm) & (n >= min_voxels), "reconnect").when(n > keep_voxels, "keep")
        .when(n < min_voxels, "remove").otherwise("keep")
    )
    return d.select("scan_id", "component", "voxel_count", "distance", "point_a", "point_b", action.alias("action"))


def triage_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n_components"), F.sum("voxel_count").alias("n_voxels"))


def force_link(comp: DataFrame, stats: DataFrame, share: float = 0.20, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Closest pair of the two largest components where the second exceeds ``share`` of the first."""
    top = largest(stats, 2)
    pair = top.groupBy("scan_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("voxel_count"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("voxel_count"))).alias("second"),
        F.max(F.when(F.col("rank") == 1, F.col("component"))).alias("c1"), F.max(F.when(F.col("rank") == 2, F.col("component"))).alias("c2"),
    ).where(F.col("second") > share * F.col("first"))
    a = comp.join(spread(pair.select("scan_id", F.col("c1").alias("component"))), ["scan_id", "component"], "left_semi")
    b = comp.join(spread(pair.select("scan_id", F.col("c2").alias("component"))), ["scan_id", "component"], "left_semi")
    return closest_pairs(a, b.select(*POSITION), ["scan_id"], "component", spacing)


def remove_small(comp: DataFrame, stats: DataFrame, min_voxels: int, min_mm3: float = 0.0, voxel_mm3: float = 1.0, keep_main: bool = True) -> DataFrame:
    """Voxels of components of at least max(min_voxels, min_mm3 in voxels); the main one stays if asked."""
    limit = max(min_voxels, int(min_mm3 / voxel_mm3))
    keep = stats.where(F.col("voxel_count") >= limit).select("scan_id", "component")
    if keep_main:
        keep = keep.unionByName(largest(stats).select("scan_id", "component")).distinct()
    return comp.join(spread(keep), ["scan_id", "component"], "left_semi")


def remove_isolated(comp: DataFrame, stats: DataFrame, max_mm: float, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    far = distance_to_main(comp, stats, spacing).where(F.col("distance") > max_mm)
    return comp.join(spread(far), ["scan_id", "component"], "left_anti")


def spurious(comp: DataFrame, stats: DataFrame, max_mm: float = 15.0, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Non-main components that are compact, far, bright and tiny.

    Extents count voxels here (max - min + 1), unlike the component table.
    """
    sx, sy, sz = spacing
    ext = [(F.col(f"bbox_max_{c}") - F.col(f"bbox_min_{c}") + 1) * F.lit(s) for c, s in (("z", sz), ("y", sy), ("x", sx))]
    d = distance_to_main(comp, stats, spacing).join(spread(stats), ["scan_id", "component"])
    d = d.withColumn("elongation", ratio(F.greatest(*ext), F.least(*ext)))
    return d.where((F.col("elongation") < 1.5) & (F.col("distance") > max_mm) & (F.col("mean_hu") > -650) & (F.col("voxel_count") < 15)).select(
        "scan_id", "component", "voxel_count", "distance", "elongation", "mean_hu"
    )


def keep_largest(comp: DataFrame, stats: DataFrame) -> DataFrame:
    return split_main(comp, stats)[0]


def reconnect(comp: DataFrame, stats: DataFrame, max_mm: float, min_voxels: int = 1, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """Whether each component ends up joined to the main one.

    Components within ``max_mm`` of each other are linked and everything linked to the
    main component, directly or through others, is reconnected. All components take
    part, so the outcome depends on no order.
    """
    eligible = stats.where(F.col("voxel_count") >= min_voxels).select("scan_id", "component")
    eligible = eligible.unionByName(largest(stats).select("scan_id", "component")).distinct()
    points = comp.join(spread(eligible), ["scan_id", "component"], "left_semi")
    links = linked_groups(points, ["scan_id"], "component", max_mm, spacing)
    merged = connected_components(links, eligible.withColumnRenamed("component", "node"), ["scan_id"])
    merged = merged.select("scan_id", F.col("node").alias("component"), F.col("component").alias("merged"))
    main = largest(stats).select("scan_id", "component").join(spread(merged), ["scan_id", "component"]).select("scan_id", F.col("merged").alias("main"))
    return stats.join(spread(merged), ["scan_id", "component"], "left").join(spread(main), "scan_id").select(
        "scan_id", "component", "voxel_count", F.coalesce(F.col("merged") == F.col("main"), F.lit(False)).alias("reconnected")
    )


def grow_main(comp: DataFrame, stats: DataFrame, max_mm: float, min_voxels: int = 1, limit: int = 10, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """The next ``limit`` components by size meet a main set that grows: (scan_id, component, rank, voxel_count, distance, reconnected).

    Largest first, each joins if its closest point lies within ``max_mm`` of the main
    component or of one that joined before it; distance is to the set as it is then.
    One that is met too early stays out though a later one would have linked it, which
    is where this differs from :func:`reconnect`. Components of fewer than
    ``min_voxels`` are passed over and use up their place. Bridges carry no voxels.
    """
    top = largest(stats, limit + 1).where((F.col("rank") == 1) | (F.col("voxel_count") >= min_voxels)).select("scan_id", "component", "voxel_count", "rank")
    top = cut_lineage(top)
    points = cut_lineage(comp.join(spread(top), ["scan_id", "component"]).select(*POSITION, "component", "rank"))
    # Every component is measured from the larger ones, so its voxels are copied ``limit`` times at most.
    larger = top.select("scan_id", F.col("rank").alias("to"))
    a = points.join(spread(larger), "scan_id").where(F.col("to") < F.col("rank"))
    b = points.select("scan_id", F.col("rank").alias("to"), "z", "y", "x")
    near = closest_pairs(a, b, ["scan_id", "to"], "component", spacing).groupBy("scan_id", "component").agg(F.collect_list(F.struct("to", "distance")).alias("near"))
    steps = top.where("rank > 1").join(spread(near), ["scan_id", "component"]).groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("rank", "component", "voxel_count", "near"))).alias("steps"))

    def step(acc: Column, s: Column) -> Column:
        d = F.array_min(F.transform(F.filter(s["near"], lambda n: F.array_contains(acc["joined"], n["to"])), lambda n: n["distance"]))
        joins = d <= max_mm
        row = F.struct(s["component"].alias("component"), s["rank"].alias("rank"), s["voxel_count"].alias("voxel_count"), d.alias("distance"), joins.alias("reconnected"))
        return F.struct(F.when(joins, F.array_append(acc["joined"], s["rank"])).otherwise(acc["joined"]).alias("joined"), F.array_append(acc["out"], row).alias("out"))

    kind = "struct<joined:array<int>,out:array<struct<component:bigint,rank:int,voxel_count:bigint,distance:double,reconnected:boolean>>>"
    grown = F.aggregate("steps", F.struct(F.array(F.lit(1)).alias("joined"), F.array().alias("out")).cast(kind), lambda acc, s: step(acc, s).cast(kind), lambda acc: acc["out"])
    return steps.select("scan_id", F.inline(grown))


def consensus(candidates: DataFrame, radius: int = 25) -> DataFrame:
    """Best candidate per scan by its weight plus distance-discounted support of the others.

    ``candidates`` has scan_id, seq (input order), method, weight and a position. Votes
    at one position are added up first, so what a position hears from is bounded by
    the volume around it. The earliest candidate wins ties; confidence is the score
    per candidate, at most 5.
    """
    # What is at one position has one score, so its earliest candidate stands for it.
    spots = candidates.groupBy(*POSITION).agg(F.sum("weight").alias("w"), F.count("*").alias("votes"), F.min("seq").alias("seq"), F.min_by("method", "seq").alias("method"))
    near = within_radius(spots.drop("w"), spots.select(*POSITION, "w"), ["scan_id"], radius)
    # A position hears itself at distance 0, which adds its own weight once. Its cell is a key so that no pair is moved again.
    heard = near.groupBy("scan_id", "__cz", "__cy", "__cx", "z", "y", "x", "votes", "seq", "method").agg(F.sum(F.col("o_w") * (1 - F.col("distance") / radius)).alias("score"))
    best = heard.groupBy("scan_id").agg(
        F.min_by(F.struct("method", "z", "y", "x", "score"), F.struct(-F.round("score", 9), "seq")).alias("b"), F.sum("votes").alias("n")
    )
    return best.select("scan_id", "b.method", "b.z", "b.y", "b.x", F.least(F.lit(5.0), ratio("b.score", "n")).alias("confidence"))
