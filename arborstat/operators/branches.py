"""Branch, generation and region statistics of trees (one or many scans at once)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborstat.functions.numeric import count_if, dbl, ratio, ratio_or_zero, sum_if
from arborstat.plans.ordered import with_previous
from arborstat.session import cut_lineage
from arborstat.plans.selection import grouped, join_groups, select_ranks


def is_central() -> Column:
    return F.col("generation") <= 7


def is_intermediate() -> Column:
    return (F.col("generation") > 7) & (F.col("generation") <= 10)


def is_peripheral() -> Column:
    return F.col("generation") > 10


def with_geometry(df: DataFrame) -> DataFrame:
    """Cylinder volume and lateral surface, and the diameter-to-length ratio."""
    d, length = dbl("diameter_mean_mm"), dbl("length_mm")
    return df.withColumns({
        "volume_mm3": F.pi() * (d / 2) * (d / 2) * length,
        "surface_area_mm2": F.pi() * d * length,
        "diameter_to_length_ratio": ratio(d, length),
    })


def merge_branch_tables(diameters: DataFrame, lengths: DataFrame) -> DataFrame:
    return diameters.join(lengths, ["scan_id", "branch_id"])


def generation_stats(branches: DataFrame) -> DataFrame:
    """Per scan and generation: count, diameter and length statistics, volume and surface sums."""
    b = with_geometry(branches.where("generation is not null"))
    keys = ["scan_id", "generation"]
    return grouped(b, keys, [
        F.count("*").alias("n_branches"),
        F.avg("diameter_mean_mm").alias("diameter_mean_mm"), F.stddev_samp("diameter_mean_mm").alias("diameter_std_mm"),
        F.min("diameter_mean_mm").alias("diameter_min_mm"), F.max("diameter_mean_mm").alias("diameter_max_mm"),
        F.avg("length_mm").alias("length_mean_mm"), F.stddev_samp("length_mm").alias("length_std_mm"),
        F.sum("volume_mm3").alias("total_volume_mm3"), F.sum("surface_area_mm2").alias("total_surface_area_mm2"),
    ], {"diameter_median_mm": ("diameter_mean_mm", 0.5), "length_median_mm": ("length_mm", 0.5)})


def generation_means(branches: DataFrame) -> DataFrame:
    return branches.where("generation is not null").groupBy("scan_id", "generation").agg(
        F.count("*").alias("n_branches"), F.avg("diameter_mean_mm").alias("diameter_mean_mm")
    )


def tapering(branches: DataFrame) -> DataFrame:
    """Diameter ratio of each present generation to the one before it.

    The window runs over one row per generation, a bounded number per scan.
    """
    w = Window.partitionBy("scan_id").orderBy("generation")
    g = generation_means(branches)
    return g.select(
        "scan_id", F.col("generation").alias("from_generation"), F.lead("generation").over(w).alias("to_generation"),
        ratio(F.lead("diameter_mean_mm").over(w), "diameter_mean_mm").alias("diameter_ratio"),
    ).where("to_generation is not null and diameter_ratio is not null")


def volume_by_generation(branches: DataFrame) -> DataFrame:
    """Volume per (scan, generation) with the scan total on every row."""
    g = with_geometry(branches.where("generation is not null")).groupBy("scan_id", "generation").agg(F.sum("volume_mm3").alias("volume_mm3"))
    return g.withColumn("total_volume_mm3", F.sum("volume_mm3").over(Window.partitionBy("scan_id")))


def _coverage_aggs() -> list[Column]:
    return [
        F.min("generation").alias("__lo"), F.max("generation").alias("__hi"),
        F.collect_set("generation").alias("__present"),  # distinct small integers
    ]


def _finish_coverage(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "generation_coverage": ratio(F.size("__present"), F.col("__hi") - F.col("__lo") + 1),
        "missing_generations": F.array_sort(F.array_except(F.sequence("__lo", "__hi"), "__present")),
        "n_present": F.size("__present").cast("long"),
    }).drop("__lo", "__hi", "__present")


def generation_coverage(branches: DataFrame) -> DataFrame:
    """Present share of the generations between the smallest and largest, and the missing ones."""
    return _finish_coverage(branches.where("generation is not null").groupBy("scan_id").agg(*_coverage_aggs()))


# Each family of per-scan metrics is a list of aggregates and a finishing step, so that
# one pass over the branches can serve any of them, or all (metric_vector).


def _region_aggs() -> list[Column]:
    aggs = []
    for name, cond in {"central": is_central(), "intermediate": is_intermediate(), "peripheral": is_peripheral()}.items():
        aggs.append(F.coalesce(sum_if(cond, "volume_mm3"), F.lit(0.0)).alias(f"{name}_volume_mm3"))
        aggs.append(count_if(cond).alias(f"{name}_branch_count"))
    return aggs


def _finish_regions(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "peripheral_to_central_ratio": ratio_or_zero("peripheral_volume_mm3", "central_volume_mm3"),
        "peripheral_to_central_branch_ratio": ratio_or_zero("peripheral_branch_count", "central_branch_count"),
    })


def region_rollup(branches: DataFrame) -> DataFrame:
    """Volume and count per region and their peripheral-to-central ratios."""
    return _finish_regions(with_geometry(branches).groupBy("scan_id").agg(*_region_aggs()))


def region_breakdown(rollup: DataFrame) -> DataFrame:
    """Three rows per scan from the wide roll-up."""
    rows = [
        F.struct(F.lit(r).alias("region"), F.col(f"{r}_volume_mm3").alias("volume_mm3"), F.col(f"{r}_branch_count").alias("branch_count"))
        for r in ("central", "intermediate", "peripheral")
    ]
    return rollup.select("scan_id", F.inline(F.array(*rows)))


def _with_peripheral(branches: DataFrame) -> DataFrame:
    per = is_peripheral()
    return with_geometry(branches).withColumns({"__pd": F.when(per, F.col("diameter_mean_mm")), "__pv": F.when(per, F.col("volume_mm3"))})


def _peripheral_aggs() -> list[Column]:
    return [
        count_if(is_peripheral()).alias("__n"), F.coalesce(F.sum("__pv"), F.lit(0.0)).alias("__v"),
        sum_if(F.col("generation").isNotNull(), "volume_mm3").alias("total_volume_mm3"),
        F.avg("__pd").alias("mean_peripheral_diameter_mm"), F.stddev_samp("__pd").alias("std_peripheral_diameter_mm"),
        F.avg("__pv").alias("mean_peripheral_branch_volume_mm3"), F.avg(F.when(is_central(), F.col("diameter_mean_mm"))).alias("__central"),
    ]


PERIPHERAL_MEDIANS = {"median_peripheral_diameter_mm": ("__pd", 0.5), "median_peripheral_branch_volume_mm3": ("__pv", 0.5)}


def _finish_peripheral(df: DataFrame) -> DataFrame:
    has = F.col("mean_peripheral_diameter_mm").isNotNull()
    return df.withColumns({
        "peripheral_volume_percent": ratio_or_zero("__v", "total_volume_mm3") * 100,
        "peripheral_branch_density": ratio_or_zero("__n", "__v"),
        "mean_central_diameter_mm": F.when(has, F.col("__central")),
        "central_to_peripheral_diameter_ratio": F.when(F.col("mean_peripheral_diameter_mm") > 0, ratio("__central", "mean_peripheral_diameter_mm")),
    }).drop("__n", "__v", "__central")


def peripheral_stats(branches: DataFrame) -> DataFrame:
    """Peripheral diameters, volumes, density and the central/peripheral diameter ratio."""
    s = grouped(_with_peripheral(branches), ["scan_id"], _peripheral_aggs(), PERIPHERAL_MEDIANS)
    return _finish_peripheral(s).drop("total_volume_mm3")


def _variation_aggs() -> list[Column]:
    return [F.avg("diameter_mean_mm").alias("diameter_mean_all"), F.stddev_samp("diameter_mean_mm").alias("diameter_std_all")]


def _finish_variation(df: DataFrame) -> DataFrame:
    return df.withColumn("diameter_cv", F.when(F.col("diameter_mean_all") > 0, ratio("diameter_std_all", "diameter_mean_all")))


def diameter_variation(branches: DataFrame) -> DataFrame:
    return _finish_variation(branches.groupBy("scan_id").agg(*_variation_aggs()))


def edge_tortuosity(edges: DataFrame, nodes: DataFrame, keys: list[str], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Branch length over the straight distance of its end nodes, plausible values only.

    ``spacing`` is mm per voxel as (x, y, z).
    """
    sx, sy, sz = spacing
    pos = nodes.select(*keys, "node", "z", "y", "x")

    def at(end: str) -> DataFrame:
        return pos.select(*keys, F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in "zyx"])

    j = edges.join(at("src"), [*keys, "src"]).join(at("dst"), [*keys, "dst"])
    sq = sum(
        (((F.col(f"dst_{c}") - F.col(f"src_{c}")) * F.lit(s)) * ((F.col(f"dst_{c}") - F.col(f"src_{c}")) * F.lit(s)) for c, s in zip("yx", (sy, sx))),
        ((F.col("dst_z") - F.col("src_z")) * F.lit(sz)) * ((F.col("dst_z") - F.col("src_z")) * F.lit(sz)),
    )
    return (
        j.withColumn("euclidean", F.sqrt(sq)).where("euclidean > 0.5")
        .withColumn("tortuosity", ratio("length", "euclidean")).where("tortuosity > 0.8 and tortuosity < 5.0")
    )


def tortuosity_summary(edges: DataFrame, nodes: DataFrame, keys: list[str], spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    t = edge_tortuosity(edges, nodes, keys, spacing)
    return grouped(t, keys, [
        F.avg("tortuosity").alias("mean_tortuosity"), F.stddev_pop("tortuosity").alias("std_tortuosity"), F.count("*").alias("n_tortuosity"),
    ], {"median_tortuosity": ("tortuosity", 0.5)})


def metric_vector(branches: DataFrame, tortuosity: DataFrame | None = None, symmetry: DataFrame | None = None) -> DataFrame:
    """One row per scan with every branch-level metric, in one pass; graph metrics are joined when given."""
    aggs = [
        *_peripheral_aggs(), *_region_aggs(), *_variation_aggs(), *_coverage_aggs(),
        F.avg("diameter_to_length_ratio").alias("mean_diameter_to_length_ratio"),
    ]
    out = grouped(_with_peripheral(branches), ["scan_id"], aggs, PERIPHERAL_MEDIANS)
    out = _finish_coverage(_finish_variation(_finish_regions(_finish_peripheral(out)))).drop("n_present")
    for p in (tortuosity, symmetry):
        if p is not None:
            out = out.join(p, "scan_id", "left")
    return out


def scan_summary(branches: DataFrame) -> DataFrame:
    """Per scan: counts, diameter and length figures, volume, generations, mean tapering."""
    s = with_geometry(branches).groupBy("scan_id").agg(
        F.count("*").alias("n_branches"), F.avg("diameter_mean_mm").alias("mean_diameter_mm"),
        F.min("diameter_mean_mm").alias("min_diameter_mm"), F.max("diameter_mean_mm").alias("max_diameter_mm"),
        F.avg("length_mm").alias("mean_length_mm"), F.sum("length_mm").alias("total_length_mm"), F.sum("volume_mm3").alias("total_volume_mm3"),
    )
    g = branches.where("generation is not null").select("scan_id", "generation").distinct().groupBy("scan_id").agg(
        F.max("generation").alias("max_generation"), F.count("*").alias("n_generations")
    )
    t = tapering(branches).groupBy("scan_id").agg(F.avg("diameter_ratio").alias("mean_tapering"))
    return s.join(g, "scan_id", "left").join(t, "scan_id", "left")


def theoretical_curves(branches: DataFrame) -> DataFrame:
    """Observed generation means and counts against d0*2^(-g/3) and 2^(g+1)."""
    w = Window.partitionBy("scan_id").orderBy("generation")  # one row per generation
    g = generation_means(branches)
    expected = F.first("diameter_mean_mm").over(w) * F.pow(F.lit(2.0), -F.col("generation") / F.lit(3.0))
    return g.select(
        "scan_id", "generation", F.col("diameter_mean_mm").alias("observed_diameter"), expected.alias("expected_diameter"),
        F.abs(F.col("diameter_mean_mm") - expected).alias("diameter_gap"),
        F.pow(F.lit(2.0), F.col("generation") + 1).alias("expected_branches"),
        F.abs(F.col("n_branches") - F.pow(F.lit(2.0), F.col("generation") + 1)).alias("branch_gap"),
    )


def polyline_lengths(points: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Length in mm and number of points of every polyline; a single point has length 0.

    ``spacing`` is mm per voxel as (x, y, z). Each point looks at its predecessor
    through blocks of ``seq``, so a long polyline is not one task.
    """
    step = sum(
        ((F.col(c) - F.col(f"prev_{c}")) * s * ((F.col(c) - F.col(f"prev_{c}")) * s) for c, s in zip("yz", spacing[1:])),
        (F.col("x") - F.col("prev_x")) * spacing[0] * ((F.col("x") - F.col("prev_x")) * spacing[0]),
    )
    p = with_previous(points, ["scan_id", "branch_id"], "seq", ["x", "y", "z"])
    return p.groupBy("scan_id", "branch_id").agg(
        F.coalesce(F.sum(F.sqrt(step)), F.lit(0.0)).alias("length_mm"), F.count("*").alias("num_points")
    )


def trimmed_profile(points: DataFrame, exclude_percent: int = 10) -> DataFrame:
    """Robust diameter profile of every polyline.

    Above ten points, a tenth (at least one) is dropped at each end and the 75th
    and 95th percentile stand for mean and maximum; shorter lines use plain
    statistics. The two cut positions come from exact selection on ``seq``.
    """
    keys = ["scan_id", "branch_id"]

    def cut(n):
        return F.when(n > 10, F.greatest(F.lit(1), F.floor(n * exclude_percent / 100))).otherwise(0)

    ends = select_ranks(points, keys, "seq", {"first": cut, "last": lambda n: n - 1 - cut(n)})
    kept = join_groups(points, ends.select(*keys, "n", "first", "last"), keys).where("seq between first and last")
    kept = cut_lineage(kept.select(*keys, "n", (F.col("radius") * 2).alias("d")))
    q = grouped(kept, keys, [
        F.max("n").alias("n"), F.avg("d").alias("avg"), F.stddev_pop("d").alias("diameter_std_mm"),
        F.min("d").alias("diameter_min_mm"), F.max("d").alias("max"),
    ], {"p75": ("d", 0.75), "p95": ("d", 0.95)})
    long_ = F.col("n") > 10
    return q.select(
        *keys, F.col("n").alias("num_points"), F.when(long_, F.col("p75")).otherwise(F.col("avg")).alias("diameter_mean_mm"),
        "diameter_std_mm", "diameter_min_mm", F.when(long_, F.col("p95")).otherwise(F.col("max")).alias("diameter_max_mm"),
    )
