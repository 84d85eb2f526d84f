"""Intensity, mask and profile statistics over sparse voxel tables.

``voxels`` has scan_id, z, y, x (integers), hu and label. Aggregations combine on
the map side; values with a bounded domain (intensities, bins, slices) are folded
to counts before anything is ordered, so a scan of any size stays spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborstat.functions.numeric import count_if, dbl, ratio, ratio_or_zero
from arborstat.plans.selection import counted_percentile

POSITION = ["scan_id", "z", "y", "x"]


def intensity_stats(voxels: DataFrame) -> DataFrame:
    base = voxels.groupBy("scan_id").agg(
        F.min("hu").alias("min_hu"), F.max("hu").alias("max_hu"), F.avg("hu").alias("mean_hu"), F.stddev_pop("hu").alias("std_hu"),
        (F.max("hu") - F.min("hu")).alias("range_hu"),
    )
    return base.join(counted_percentile(voxels, ["scan_id"], "hu", {"median_hu": 0.5}), "scan_id")


def masked_density(voxels: DataFrame) -> DataFrame:
    return voxels.where("label > 0").groupBy("scan_id").agg(F.avg("hu").alias("mean_density_hu"), F.count("*").alias("n_voxels"))


def histogram_bin(value: Column | str, lo: float, hi: float, bins: int) -> Column:
    """0-based equal-width bin; the upper edge belongs to the last bin, values outside give NULL."""
    v = dbl(value)
    pos = F.floor((v - lo) * bins / F.lit(hi - lo)).cast("int")  # exact for integers
    return F.when((v >= lo) & (v < hi), F.least(pos, F.lit(bins - 1))).when(v == hi, bins - 1)


def histogram(voxels: DataFrame, lo: float = -1024.0, hi: float = 100.0, bins: int = 100) -> DataFrame:
    b = voxels.select("scan_id", histogram_bin("hu", lo, hi, bins).alias("bin")).where("bin is not null")
    return b.groupBy("scan_id", "bin").agg(F.count("*").alias("n"))


def histogram_entropy(voxels: DataFrame, lo: float = -1024.0, hi: float = 100.0, bins: int = 100) -> DataFrame:
    """Shannon entropy (bits) of the masked intensity histogram."""
    h = histogram(voxels.where("label > 0"), lo, hi, bins)
    # -sum(p log2 p) = log2(N) - sum(n log2 n)/N
    return h.groupBy("scan_id").agg(
        (F.log2(F.sum("n")) - ratio(F.sum(F.col("n") * F.log2("n")), F.sum("n"))).alias("histogram_entropy")
    )


def band_percentages(voxels: DataFrame) -> DataFrame:
    """Share of masked voxels per intensity band."""
    v = voxels.where("label > 0")
    bands = {
        "below_minus_950": F.col("hu") < -950, "minus_950_to_850": (F.col("hu") >= -950) & (F.col("hu") < -850),
        "minus_850_to_700": (F.col("hu") >= -850) & (F.col("hu") < -700), "above_minus_700": F.col("hu") >= -700,
    }
    return v.groupBy("scan_id").agg(*[(ratio(count_if(c), F.count("*")) * 100).alias(f"pct_{n}") for n, c in bands.items()])


def mask_extent(voxels: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Voxel count, volume and z-extent of the mask; spacing is mm per voxel as (x, y, z)."""
    sx, sy, sz = spacing
    return voxels.where("label > 0").groupBy("scan_id").agg(
        F.count("*").alias("n_voxels"), (F.count("*") * F.lit(sx * sy * sz)).alias("volume_mm3"),
        (F.max("z") - F.min("z")).alias("z_extent_slices"), ((F.max("z") - F.min("z")) * F.lit(sz)).alias("z_extent_mm"),
    )


def slice_areas(voxels: DataFrame) -> DataFrame:
    """Mask area per slice over every slice of the scan, empty ones included."""
    return voxels.groupBy("scan_id", "z").agg(count_if(F.col("label") > 0).alias("area"))


def slice_area_profile(voxels: DataFrame) -> DataFrame:
    a = F.when(F.col("area") > 0, F.col("area"))
    zero = F.lit(0.0)
    s = slice_areas(voxels).groupBy("scan_id").agg(F.coalesce(F.avg(a), zero).alias("area_mean"), F.coalesce(F.stddev_pop(a), zero).alias("area_std"))
    return s.withColumn("area_cv", ratio_or_zero("area_std", "area_mean"))


def profile_gaps(voxels: DataFrame) -> DataFrame:
    """Full-to-empty transitions along z; emptiness after the last full slice counts.

    One row per slice, a bounded number per scan.
    """
    prev = F.lag("area").over(Window.partitionBy("scan_id").orderBy("z"))
    return slice_areas(voxels).select("scan_id", ((F.col("area") == 0) & (prev > 0)).alias("gap")).groupBy("scan_id").agg(
        count_if(F.col("gap")).alias("n_gaps")
    )


def corner_noise(voxels: DataFrame, size: int = 10) -> DataFrame:
    return voxels.where(f"z < {size} and y < {size} and x < {size} and z >= 0 and y >= 0 and x >= 0").groupBy("scan_id").agg(F.stddev_pop("hu").alias("noise_std"))


def voxel_runs(masked: DataFrame) -> DataFrame:
    """Maximal runs of the given voxels along x: (scan_id, z, y, x0, x1).

    The window covers one scan line, which the grid width bounds.
    """
    w = Window.partitionBy("scan_id", "z", "y").orderBy("x")
    step = F.when(F.col("x") - F.lag("x").over(w) == 1, 0).otherwise(1)
    runs = masked.withColumn("__new", step).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("scan_id", "z", "y", "__run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("__run")


CELL = 64  # positions along x that one join key covers


def in_cells(runs: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Each run once per cell of CELL positions along x that ``lo`` to ``hi`` touches."""
    return runs.withColumn("cell", F.explode(F.sequence(F.floor(lo / CELL), F.floor(hi / CELL))))


def overlapping(runs: DataFrame, sent: DataFrame, reach: int) -> DataFrame:
    """Pairs of ``runs`` (x0, x1) and ``sent`` (a0, a1) of one line that overlap or come within ``reach``.

    Lines are joined cell by cell, and a pair counts in the cell where its overlap
    begins, so what meets is bounded by a cell and not by the runs of a line.
    """
    left = in_cells(runs, F.col("x0"), F.col("x1"))
    right = in_cells(sent, F.col("a0") - reach, F.col("a1") + reach)
    begins = F.floor(F.greatest(F.col("x0"), F.col("a0") - reach) / CELL)
    met = left.join(right, ["scan_id", "z", "y", "cell"])
    return met.where((F.col("a0") - reach <= F.col("x1")) & (F.col("a1") + reach >= F.col("x0")) & (F.col("cell") == begins)).drop("cell")


def neighbour_counts(voxels: DataFrame) -> DataFrame:
    """Masked neighbours (of 26) of every masked voxel, and whether it is an endpoint.

    Runs along x are sent to the nine lines around and including their own, so what is
    shuffled is runs and not voxels; the counts are added up where the lines meet.
    """
    runs = voxel_runs(voxels.where("label > 0").select(*POSITION))
    lines = F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    sent = runs.select("scan_id", "z", "y", F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.explode(lines).alias("o")).select(
        "scan_id", (F.col("z") + F.col("o.dz")).alias("z"), (F.col("y") + F.col("o.dy")).alias("y"), "a0", "a1"
    )
    met = overlapping(runs, sent, 1)
    reached = F.sequence(F.greatest("x0", F.col("a0") - 1), F.least("x1", F.col("a1") + 1))
    near = met.select("scan_id", "z", "y", "a0", "a1", F.explode(reached).alias("x"))
    common = F.least(F.col("x") + 1, F.col("a1")) - F.greatest(F.col("x") - 1, F.col("a0")) + 1
    return near.groupBy(*POSITION).agg((F.sum(common) - 1).alias("n_neighbours")).withColumn("is_endpoint", F.col("n_neighbours") == 1)


def smooth_along_x(voxels: DataFrame) -> DataFrame:
    """Three-point moving average along x (rows of one scan line; edges use what is there)."""
    w = Window.partitionBy("scan_id", "z", "y").orderBy("x").rangeBetween(-1, 1)
    return voxels.select(*POSITION, F.avg("hu").over(w).alias("hu"), "label")


def image_pair_quality(pairs: DataFrame) -> DataFrame:
    """Signal-to-noise, noise reduction, histogram similarity, PSNR and MAE per scan.

    ``pairs`` has hu and hu_processed. Band masks are taken on each image by itself; a
    band with 100 or fewer voxels in the original reports 0.
    """
    o, s = F.col("hu"), F.col("hu_processed")
    bands = {"lung": (-900, -500), "tissue": (-100, 100)}
    aggs = [F.avg((o - s) * (o - s)).alias("mse"), F.avg(F.abs(o - s)).alias("mean_absolute_error")]
    for b, (lo, hi) in bands.items():
        for side, c in (("o", o), ("s", s)):
            v = F.when((c > lo) & (c < hi), dbl(c))
            aggs += [F.count(v).alias(f"{b}_n_{side}"), F.avg(v).alias(f"{b}_m_{side}"), F.stddev_pop(v).alias(f"{b}_sd_{side}")]
    q = pairs.groupBy("scan_id").agg(*aggs)
    cols = {}
    for b in bands:
        enough = F.col(f"{b}_n_o") > 100

        def snr(side, b=b):
            return F.abs(ratio_or_zero_signed(f"{b}_m_{side}", f"{b}_sd_{side}"))

        cols[f"{b}_snr_original"] = F.when(enough, snr("o")).otherwise(0.0)
        cols[f"{b}_snr_smoothed"] = F.when(enough, snr("s")).otherwise(0.0)
        cols[f"{b}_noise_reduction"] = F.when(enough, ratio_or_zero_signed(F.col(f"{b}_sd_o") - F.col(f"{b}_sd_s"), f"{b}_sd_o") * 100).otherwise(0.0)
    cols["psnr"] = F.when(F.col("mse") > 0, 20 * F.log10(F.lit(4095.0) / F.sqrt("mse")))
    q = q.withColumns(cols)

    # Bhattacharyya coefficient of the two 100-bin histograms.
    both = pairs.select("scan_id", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), histogram_bin(o, -1024.0, 3071.0, 100).alias("bin")),
        F.struct(F.lit(1).alias("side"), histogram_bin(s, -1024.0, 3071.0, 100).alias("bin")),
    ))).where("bin is not null")
    h = both.groupBy("scan_id", "bin").agg(count_if(F.col("side") == 0).alias("a"), count_if(F.col("side") == 1).alias("b"))
    sim = h.groupBy("scan_id").agg(
        ratio(F.sum(F.sqrt(dbl("a") * dbl("b"))), F.sqrt(dbl(F.sum("a")) * dbl(F.sum("b")))).alias("histogram_similarity")
    )
    return q.join(sim, "scan_id", "left").select("scan_id", *cols, "histogram_similarity", "mean_absolute_error")


def ratio_or_zero_signed(num, den) -> Column:
    return F.when(dbl(den) > 0, ratio(num, den)).otherwise(0.0)
