"""Exact order statistics per group, and global positions.

Group sizes are counted first. Small groups are gathered and sorted in one grouping;
in larger ones passes of map-side bucket counts narrow each rank to a few rows, so nothing is
sorted as a whole and no task holds a large group. NULL keys are a group like any other.

Positions come from a range partitioning that is written once; no task sees more than its range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborstat.functions.numeric import clean
from arborstat.session import cut_and_count, cut_lineage, release


def positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Add the 0-based position of every row in the global order of ``order``.

    ``order`` has to identify rows. A range partitioning sorts across tasks, the
    result is written once so that positions cannot shift on a retry, and each
    row's position is its place in its partition plus the sizes of the partitions
    before. No task sees more than its range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged = cut_lineage(ranged)
    part, local = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return (
        ranged.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")  # as many rows as shuffle partitions
        .withColumn(name, F.col("__offset") + local)
        .drop("__id", "__part", "__offset")
    )


def running_totals(df: DataFrame, order: list[str], count: str, name: str) -> DataFrame:
    """Add the sum of ``count`` over all rows before a row in the global order of ``order``, which has to identify rows.

    Rows are dealt by range and written once; each range is summed for itself and starts
    where those before it end, so no task sees more than its range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = ranged.groupBy("__part").agg(F.sum(count).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn(name, F.coalesce(F.sum(count).over(within), F.lit(0)))
    return summed.join(F.broadcast(offsets), "__part").withColumn(name, F.col(name) + F.col("__offset")).drop("__part", "__offset")  # as many rows as shuffle partitions


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the keys of ``left`` stay."""
    other = right.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return left.join(other, on, how).drop(*[f"__of_{k}" for k in keys])


#: Groups of more rows than this are not gathered: their ranks are found by counting.
WHOLE = 100_000
#: Buckets that a pass of counting splits an interval into.
BUCKETS = 1024


def select_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Values at given 0-based ranks of each group's sorted non-null values.

    ``ranks`` maps an output name to a function from the group's row count to a rank (it
    may read the key columns too); a rank outside the group gives NULL. Integer values
    keep their type. Per group with a value: ``keys``, ``n`` and a value for each name.
    Without keys the whole table is one group. Small groups are gathered and sorted each;
    larger ones are counted (:func:`counted_ranks`).
    """
    whole = df.select(value).dtypes[0][1] in ("tinyint", "smallint", "int", "bigint")
    v = F.col(value) if whole else clean(value)
    rows = df.select(*keys, v.alias("__v")).where("__v is not null")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")).where("n > 0")
    sizes, large = cut_and_count(sizes, F.col("n") > WHOLE)
    small = rows
    if large:
        hot = sizes.where(F.col("n") > WHOLE)
        small = _without(rows, hot, keys)
    gathered = small.groupBy(*keys).agg(F.sort_array(F.collect_list("__v")).alias("__all")).where(F.size("__all") > 0)
    size = F.size("__all").cast("bigint")

    def at(rank: Column) -> Column:
        rank = rank.cast("long")
        return F.when((rank >= 0) & (rank < size), F.element_at("__all", (F.when((rank >= 0) & (rank < size), rank).otherwise(0) + 1).cast("int")))

    found = gathered.withColumn("n", size).select(*keys, "n", *[at(fn(F.col("n"))).alias(k) for k, fn in ranks.items()])
    return found.unionByName(counted_ranks(join_groups(rows, hot.select(*keys), keys), hot, keys, ranks)) if large else found


def _without(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    return join_groups(rows, groups.select(*keys), keys, "left_anti")


def counted_ranks(rows: DataFrame, groups: DataFrame, keys: list[str], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """:func:`select_ranks` for groups of any size, by counting: no row is sorted or gathered but those next to a rank.

    ``rows`` has keys and __v, ``groups`` (keys, n, low, high) their sizes and limits. Every
    pass counts an interval's rows in BUCKETS parts, on the map side first, and goes on with the
    part that holds the rank. Once a part has few rows or a single value that is all that is
    left to look at.
    """
    wanted = F.array(*[F.struct(F.lit(k).alias("__name"), fn(F.col("n")).cast("long").alias("rank")) for k, fn in ranks.items()])
    asked = groups.select(*keys, "n", "low", "high", F.col("n").alias("left"), F.lit(0).cast("bigint").alias("before"), F.inline(wanted)).where("rank between 0 and n - 1")
    asked, open_ = cut_and_count(asked, (F.col("low") < F.col("high")) & (F.col("left") > WHOLE))
    span = [*keys, "low", "high"]
    inside = (F.col("__v") >= F.col("low")) & (F.col("__v") <= F.col("high"))

    def members(cond: Column) -> DataFrame:
        return join_groups(rows, asked.where(cond).select(*span).distinct(), keys).where(inside)

    while open_:
        few = (F.col("left") <= WHOLE) | (F.col("low") == F.col("high"))
        wide = F.col("high").cast("double") - F.col("low").cast("double")
        part = F.floor((F.col("__v").cast("double") - F.col("low").cast("double")) / wide * BUCKETS)
        # An interval without end is split into its ends and the rest first.
        part = F.when(F.col("__v") == F.col("low"), 0).when(F.col("__v") == F.col("high"), BUCKETS - 1).when(F.abs(wide) == float("inf"), BUCKETS // 2).otherwise(F.least(part.cast("int"), F.lit(BUCKETS - 1)))
        counts = members(~few).groupBy(*span, part.alias("part")).agg(F.count("*").alias("c"), F.min("__v").alias("a"), F.max("__v").alias("b"))
        upto = F.sum("c").over(Window.partitionBy(*span).orderBy("part"))  # BUCKETS rows at most
        parts = cut_lineage(counts.select("*", (upto - F.col("c")).alias("below")))
        met = join_groups(asked.where(~few), parts, span)
        here = (F.col("rank") >= F.col("before") + F.col("below")) & (F.col("rank") < F.col("before") + F.col("below") + F.col("c"))
        narrowed = met.where(here).select(*keys, "n", F.col("a").alias("low"), F.col("b").alias("high"), F.col("c").alias("left"), (F.col("before") + F.col("below")).alias("before"), "__name", "rank")
        last = asked
        asked, open_ = cut_and_count(narrowed.unionByName(last.where(few)), (F.col("low") < F.col("high")) & (F.col("left") > WHOLE))
        release(parts, last)

    near = members(F.col("low") < F.col("high")).groupBy(*span).agg(F.sort_array(F.collect_list("__v")).alias("__all"))
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.element_at("__all", (F.col("rank") - F.col("before") + 1).cast("int")))
    picked = join_groups(asked, near, span, "left").select(*keys, "n", "__name", value.alias("__v"))
    found = picked.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == k, F.col("__v"))).alias(k) for k in ranks])
    return join_groups(groups.select(*keys, "n"), found, keys, "left")


def grouped(df: DataFrame, keys: list[str], aggs: list[Column], probs: dict[str, tuple[str, float]]) -> DataFrame:
    """Aggregates and exact interpolated percentiles of each group side by side.

    ``probs`` maps an output name to (column, p). Where every group is small one grouping
    does it all; else all columns are ranked together, each as a group of its own.
    """
    columns = list(dict.fromkeys(c for c, _ in probs.values()))
    between = lambda lo, hi, p, n: lo + (hi - lo) * (F.lit(p) * (n - 1) - F.floor(F.lit(p) * (n - 1)))
    sizes, large = cut_and_count(df.groupBy(*keys).agg(F.count("*").alias("n")), F.col("n") > WHOLE)
    release(sizes)
    if not large:
        sorted_ = {c: f"__s{i}" for i, c in enumerate(columns)}
        every = df.groupBy(*keys).agg(*aggs, *[F.sort_array(F.collect_list(clean(c))).alias(s) for c, s in sorted_.items()])

        def percentile(c: str, p: float) -> Column:
            s, n = F.col(sorted_[c]), F.size(sorted_[c])
            lo, hi = (F.element_at(s, f(F.lit(p) * (F.greatest(n, F.lit(1)) - 1)).cast("int") + 1) for f in (F.floor, F.ceil))
            return F.when(n > 0, between(lo, hi, p, n))

        return every.withColumns({k: percentile(c, p) for k, (c, p) in probs.items()}).drop(*sorted_.values())
    long = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("__c"), clean(c).alias("__x")) for i, c in enumerate(columns)])))
    ranks: dict[str, Callable[[Column], Column]] = {}
    for p in dict.fromkeys(p for _, p in probs.values()):
        ranks[f"{p!r} lo"] = lambda n, p=p: F.floor(F.lit(p) * (n - 1))
        ranks[f"{p!r} hi"] = lambda n, p=p: F.ceil(F.lit(p) * (n - 1))
    got = select_ranks(long, [*keys, "__c"], "__x", ranks)
    out = []
    for k, (c, p) in probs.items():
        value = between(F.col(f"`{p!r} lo`"), F.col(f"`{p!r} hi`"), p, F.col("n"))
        out.append(F.max(F.when(F.col("__c") == columns.index(c), value)).alias(k))
    stats = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    return join_groups(stats, got.groupBy(*keys).agg(*out), keys, "left")


def counted_percentile(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Percentiles of a value with a bounded domain (a small integer, say).

    Rows are folded to (value, count) first, so a group is never larger than the
    domain of its values.
    """
    folded = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return folded.groupBy(*keys).agg(*[F.percentile(F.col(value), p, F.col("__n")).alias(k) for k, p in probs.items()])
