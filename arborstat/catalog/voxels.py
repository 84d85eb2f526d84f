"""Intensity, mask and image-pair operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborstat.catalog import query, r6
from arborstat.operators import joins, voxels as V

SP = (0.7, 0.7, 1.25)


def rounded(df, keys, cols):
    return df.select(*keys, *[r6(c).alias(c) for c in cols])


@query("e14_intensity_stats", "voxels", "select scan_id, min(hu) as min_hu, max(hu) as max_hu, max(hu)-min(hu) as range_hu, round(avg(hu),6) as mean_hu, round(stddev_pop(hu),6) as std_hu, round(median(hu)::double,6) as median_hu from voxels group by 1")
def _(t):
    return rounded(V.intensity_stats(t.voxels), ["scan_id", "min_hu", "max_hu", "range_hu"], ["mean_hu", "std_hu", "median_hu"])


@query("e15_masked_density", "voxels", "select scan_id, count(*) as n_voxels, round(avg(hu),6) as mean_density_hu from voxels where label>0 group by 1")
def _(t):
    return rounded(V.masked_density(t.voxels), ["scan_id", "n_voxels"], ["mean_density_hu"])


HIST = """, hb as (select scan_id, case when hu=100 then 99 else floor((hu+1024)*100/1124.0::double)::int end as bin, count(*) as n from voxels where {w} and hu between -1024 and 100 group by 1,2)"""


@query("e16_histogram", "voxels", HIST.format(w="true") + "select * from hb")
def _(t):
    return V.histogram(t.voxels)


@query("e16_histogram_entropy", "voxels", HIST.format(w="label>0") + ", p as (select scan_id, n/sum(n) over (partition by scan_id)::double as p from hb) select scan_id, round(-sum(p*log2(p)),6)+0 as histogram_entropy from p group by 1")
def _(t):
    return rounded(V.histogram_entropy(t.voxels), ["scan_id"], ["histogram_entropy"])


@query("e17_band_percentages", "voxels", """select scan_id, round(100.0::double*count(*) filter (where hu<-950)/count(*),6) as pct_below_minus_950, round(100.0::double*count(*) filter (where hu>=-950 and hu<-850)/count(*),6) as pct_minus_950_to_850,
 round(100.0::double*count(*) filter (where hu>=-850 and hu<-700)/count(*),6) as pct_minus_850_to_700, round(100.0::double*count(*) filter (where hu>=-700)/count(*),6) as pct_above_minus_700 from voxels where label>0 group by 1""")
def _(t):
    b = V.band_percentages(t.voxels)
    return rounded(b, ["scan_id"], b.columns[1:])


@query("e18_mask_extent", "voxels", "select scan_id, count(*) as n_voxels, round(count(*)*0.6125::double,6) as volume_mm3, max(z)-min(z) as z_extent_slices, round((max(z)-min(z))*1.25::double,6) as z_extent_mm from voxels where label>0 group by 1")
def _(t):
    return rounded(V.mask_extent(t.voxels, SP), ["scan_id", "n_voxels", "z_extent_slices"], ["volume_mm3", "z_extent_mm"])


AREA = ", a as (select scan_id, z, count(*) filter (where label>0) as area from voxels group by 1,2)"


@query("e19_slice_area_profile", "voxels", AREA + """, s as (select scan_id, coalesce(avg(area) filter (where area>0),0) as m, coalesce(stddev_pop(area) filter (where area>0),0) as s from a group by 1)
select scan_id, round(m,6) as area_mean, round(s,6) as area_std, round(case when m>0 then s/m else 0 end,6) as area_cv from s""")
def _(t):
    return rounded(V.slice_area_profile(t.voxels), ["scan_id"], ["area_mean", "area_std", "area_cv"])


@query("e20_corner_noise", "voxels", "select scan_id, round(stddev_pop(hu),6) as noise_std from voxels where z<3 and y<3 and x<3 group by 1")
def _(t):
    return rounded(V.corner_noise(t.voxels, 3), ["scan_id"], ["noise_std"])


@query("f11_profile_gaps", "voxels", """, a as (select scan_id, z*4+y as z, count(*) filter (where label>0) as area from voxels group by 1,2), p as (select scan_id, area, lag(area) over (partition by scan_id order by z) as pa from a)
select scan_id, count(*) filter (where area=0 and pa>0) as n_gaps from p group by 1""")
def _(t):
    lines = t.voxels.withColumn("z", F.col("z") * 4 + F.col("y"))  # scan lines as slices, so that gaps occur
    return V.profile_gaps(lines)


@query("g10_neighbour_counts", "voxels", """, v as (select scan_id, z, y, x from voxels where label>0),
n as (select a.scan_id, a.z, a.y, a.x, count(b.z) as n_neighbours from v a left join v b on a.scan_id=b.scan_id and abs(a.z-b.z)<=1 and abs(a.y-b.y)<=1 and abs(a.x-b.x)<=1 and not (a.z=b.z and a.y=b.y and a.x=b.x) group by 1,2,3,4)
select *, n_neighbours=1 as is_endpoint from n""")
def _(t):
    return V.neighbour_counts(t.voxels)


SMOOTH = """, sm as (select scan_id, z, y, x, hu+{s} as hu, avg(hu+{s}) over (partition by scan_id, z, y order by x range between 1 preceding and 1 following) as hu_processed from {v})"""


@query("j12_voxel_pairs", "voxels", SMOOTH.format(s=0, v="voxels") + "select scan_id, z, y, x, hu, round(hu_processed,6) as hu_processed from sm")
def _(t):
    p = joins.pair_voxels(t.voxels.drop("label"), V.smooth_along_x(t.voxels))
    return p.withColumn("hu_processed", r6("hu_processed"))


QUALITY = SMOOTH.format(s=700, v="vw") .replace(", sm as", ", vw as (select scan_id//10 as scan_id, (scan_id%10)*4+z as z, y, x, hu from voxels), sm as") + """, q as (select scan_id, avg((hu-hu_processed)*(hu-hu_processed)) as mse, avg(abs(hu-hu_processed)) as mae,
 count(*) filter (where hu>-900 and hu<-500) as ln, avg(hu) filter (where hu>-900 and hu<-500) as lm, stddev_pop(hu) filter (where hu>-900 and hu<-500) as ls, avg(hu_processed) filter (where hu_processed>-900 and hu_processed<-500) as lpm, stddev_pop(hu_processed) filter (where hu_processed>-900 and hu_processed<-500) as lps,
 count(*) filter (where hu>-100 and hu<100) as tn, avg(hu) filter (where hu>-100 and hu<100) as tm, stddev_pop(hu) filter (where hu>-100 and hu<100) as ts, avg(hu_processed) filter (where hu_processed>-100 and hu_processed<100) as tpm, stddev_pop(hu_processed) filter (where hu_processed>-100 and hu_processed<100) as tps from sm group by 1),
 hh as (select scan_id, bin, sum(a) as a, sum(b) as b from (select scan_id, floor((hu+1024)*100/4095.0::double) as bin, 1 as a, 0 as b from sm where hu>=-1024 and hu<3071 union all select scan_id, floor((hu_processed+1024)*100/4095.0::double), 0, 1 from sm where hu_processed>=-1024 and hu_processed<3071) group by 1,2),
 hs as (select scan_id, sum(sqrt(a::double*b::double))/sqrt(sum(a)::double*sum(b)::double) as sim from hh group by 1)
select scan_id, round(case when ln>100 and ls>0 then abs(lm/ls) else 0 end,6) as lung_snr_original, round(case when ln>100 and lps>0 then abs(lpm/lps) else 0 end,6) as lung_snr_smoothed, round(case when ln>100 and ls>0 then (ls-lps)/ls*100 else 0 end,6) as lung_noise_reduction,
 round(case when tn>100 and ts>0 then abs(tm/ts) else 0 end,6) as tissue_snr_original, round(case when tn>100 and tps>0 then abs(tpm/tps) else 0 end,6) as tissue_snr_smoothed, round(case when tn>100 and ts>0 then (ts-tps)/ts*100 else 0 end,6) as tissue_noise_reduction,
 round(case when mse>0 then 20*log10(4095/sqrt(mse)) end,6) as psnr, round(sim,6) as histogram_similarity, round(mae,6) as mean_absolute_error from q join hs using (scan_id)"""


@query("e22_image_pair_quality", "voxels", QUALITY)
def _(t):
    # ten grids stacked along z and shifted by +700, so that the soft-tissue band is filled
    v = t.voxels.select(F.expr("scan_id div 10").alias("scan_id"), ((F.col("scan_id") % 10) * 4 + F.col("z")).alias("z"), "y", "x", (F.col("hu") + 700).alias("hu"), "label")
    q = V.image_pair_quality(joins.pair_voxels(v, V.smooth_along_x(v)))
    return rounded(q, ["scan_id"], q.columns[1:])
