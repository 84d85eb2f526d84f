"""Nearest pairs between point sets without comparing every pair.

Points are boxed at a coarse grid first. Pairs of boxes whose smallest possible
distance exceeds the best guaranteed distance are dropped, the rest are split into
finer boxes, down to single points. What is compared is the thin set of boxes that
could still hold the answer, and the answer is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborstat.session import cut_lineage, release, spread

AXES = ("z", "y", "x")


def closest_pairs(a: DataFrame, b: DataFrame, keys: list[str], group: str, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Closest point of ``b`` for each (keys, group) of ``a``.

    ``a`` has keys, group, z, y, x (integers); ``b`` has keys, z, y, x. ``spacing`` is
    mm per step as (x, y, z). Result: keys, group, distance and both points; ties go
    to the smallest points. The first boxes are as wide as everything in a volume, so
    eight at most on either side; from there boxes are halved, and at each level only
    pairs that can still hold their group's answer are split.
    """
    mm = dict(zip(AXES, (spacing[2], spacing[1], spacing[0])))
    a = a.select(*keys, group, *[F.col(c).cast("int").alias(f"a{c}") for c in AXES]).distinct()
    b = b.select(*keys, *[F.col(c).cast("int").alias(f"b{c}") for c in AXES]).distinct()

    def boxes(df: DataFrame, side: str, level: int, extra: list[str]) -> DataFrame:
        cells = [F.shiftright(f"{side}{c}", level).alias(f"{side}{c}") for c in AXES]
        return df.select(*keys, *extra, *cells).distinct() if level else df

    def bounds(level: int) -> tuple[Column, Column]:
        side = 1 << level
        lo, hi = [], []
        for c in AXES:
            d = F.abs(F.col(f"a{c}") - F.col(f"b{c}")) * side  # distance of the box corners
            lo.append(F.greatest(d - (side - 1), F.lit(0)) * mm[c])
            hi.append((d + (side - 1)) * mm[c])
        return tuple(F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]) for v in (lo, hi))

    both = a.select(*keys, *[F.col(f"a{c}").alias(c) for c in AXES]).unionByName(b.select(*keys, *[F.col(f"b{c}").alias(c) for c in AXES]))
    widest = F.greatest(*[F.max(c) - F.min(c) for c in AXES]).alias("w")
    width, rows = both.groupBy(*keys).agg(widest, F.count("*").alias("n")).agg(F.max("w"), F.sum("n")).first()
    level, rows = (width or 0).bit_length(), rows or 0
    pairs, table = None, []
    while True:
        ca, cb = boxes(a, "a", level, [group]), boxes(b, "b", level, [])
        if pairs is None:
            joined = ca.join(spread(cb, rows), keys)  # eight boxes at most of a volume and of a group in it
        else:
            up = prev - level
            pa = ca.select("*", *[F.shiftright(f"a{c}", up).alias(f"pa{c}") for c in AXES])
            pb = cb.select("*", *[F.shiftright(f"b{c}", up).alias(f"pb{c}") for c in AXES])
            parent = pairs.select(*keys, group, *[F.col(f"{s}{c}").alias(f"p{s}{c}") for s in "ab" for c in AXES])
            joined = parent.join(spread(pa, rows), [*keys, group, *[f"pa{c}" for c in AXES]]).join(spread(pb, rows), [*keys, *[f"pb{c}" for c in AXES]])
        lo, hi = bounds(level)
        joined = joined.select(*keys, group, *[f"{s}{c}" for s in "ab" for c in AXES], lo.alias("lo"), hi.alias("hi"))
        if level == 0:
            pt = lambda s: F.struct(*[F.col(f"{s}{c}").alias(c) for c in AXES])
            best = joined.groupBy(*keys, group).agg(F.min(F.struct(F.col("lo").alias("distance"), pt("a").alias("a"), pt("b").alias("b"))).alias("m"))
            return best.select(*keys, group, "m.distance", F.col("m.a").alias("point_a"), F.col("m.b").alias("point_b"))
        before, table = table, cut_lineage(joined)
        release(*before)
        limit = table.groupBy(*keys, group).agg(F.min("hi").alias("limit"))
        pairs = table.join(spread(limit, rows), [*keys, group]).where(F.col("lo") <= F.col("limit")).drop("lo", "hi", "limit")
        prev, level, table = level, level - 1, [table]


def within_radius(a: DataFrame, b: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Pairs (a.*, b columns prefixed o_) closer than ``radius``, by a grid of that size.

    Cells are four times as wide, and ``b`` announces itself in those it can reach: 3.4
    on average, 27 with cells of the radius. Positions should be distinct in ``b`` so that what meets in a
    cell is bounded by the cell's volume. With the pairs come the cells of ``a`` (__cz,
    __cy, __cx): pairs of one row of ``a`` are together in one task.
    """
    wide = 4 * radius
    left = a.withColumns({f"__c{c}": F.floor(F.col(c) / wide).cast("int") for c in AXES})
    right = b.select(*keys, *[F.col(c).alias(f"o_{c}") for c in b.columns if c not in keys])
    for c in AXES:
        first, last = (F.floor((F.col(f"o_{c}") + d) / wide).cast("int") for d in (-radius, radius))
        right = right.withColumn(f"__c{c}", F.explode(F.sequence(first, last)))
    near = left.join(spread(right), [*keys, *[f"__c{c}" for c in AXES]])
    sq = sum(((F.col(c) - F.col(f"o_{c}")) * (F.col(c) - F.col(f"o_{c}")) for c in AXES[1:]), (F.col("z") - F.col("o_z")) * (F.col("z") - F.col("o_z")))
    return near.withColumn("distance", F.sqrt(sq.cast("double"))).where(F.col("distance") < radius)


def linked_groups(points: DataFrame, keys: list[str], group: str, radius: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Pairs of groups (src < dst) whose closest points are within ``radius`` mm.

    Boxes at least as wide as the radius meet only their neighbours. A pair of groups
    is settled as soon as two of its boxes lie within the radius altogether; boxes
    that cannot reach each other are dropped; the rest is split. A large group never
    meets itself.
    """
    mm = dict(zip(AXES, (spacing[2], spacing[1], spacing[0])))
    level = 0
    while (1 << level) * min(mm.values()) < radius:
        level += 1
    p = points.select(*keys, group, *AXES).distinct()

    def side(s: str, lv: int, up: int = 0) -> DataFrame:
        cells = [F.shiftright(c, lv).alias(f"{s}{c}") for c in AXES]
        out = p.select(*keys, F.col(group).alias("src" if s == "a" else "dst"), *cells).distinct()
        return out.select("*", *[F.shiftright(f"{s}{c}", up).alias(f"p{s}{c}") for c in AXES])

    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    found, near = [], None
    while True:
        if near is None:
            b = side("b", level)
            for c in AXES:
                b = b.withColumn("__s", F.explode(steps)).withColumn(f"pb{c}", F.col(f"b{c}") + F.col("__s")).drop("__s")
            a = side("a", level)
            on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col(f"l.a{c}") == F.col(f"r.pb{c}") for c in AXES] + [F.col("src") < F.col("dst")]
            pairs = a.alias("l").join(spread(b.alias("r")), on).select(*[F.col(f"l.{k}") for k in keys], "src", "dst", *[f"{s}{c}" for s in "ab" for c in AXES])
        else:
            up = prev - level
            parent = near.select(*keys, "src", "dst", *[F.col(f"{s}{c}").alias(f"p{s}{c}") for s in "ab" for c in AXES])
            pairs = parent.join(spread(side("a", level, up)), [*keys, "src", *[f"pa{c}" for c in AXES]]).join(spread(side("b", level, up)), [*keys, "dst", *[f"pb{c}" for c in AXES]])
        width = (1 << level) - 1
        lo, hi = F.lit(0.0), F.lit(0.0)
        for c in AXES:
            d = F.abs(F.col(f"a{c}") - F.col(f"b{c}")) * (1 << level)
            lo = lo + F.pow(F.greatest(d - width, F.lit(0)) * mm[c], F.lit(2))
            hi = hi + F.pow((d + width) * mm[c], F.lit(2))
        pairs = pairs.select(*keys, "src", "dst", *[f"{s}{c}" for s in "ab" for c in AXES], F.sqrt(lo).alias("lo"), F.sqrt(hi).alias("hi")).where(F.col("lo") <= radius)
        pairs = cut_lineage(pairs)
        done = pairs.where(F.col("hi") <= radius).select(*keys, "src", "dst").distinct()
        found.append(done)
        if level == 0:
            break
        near = pairs.join(spread(done), [*keys, "src", "dst"], "left_anti")
        prev, level = level, max(0, level - 2)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
