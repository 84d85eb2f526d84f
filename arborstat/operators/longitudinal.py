"""Repeated measurements: nearest visits, value-at-target, slopes, quartile trajectories.

Every per-entity result is an aggregate (``min_by`` over an ordering struct,
regression moments), so rows are combined before the shuffle and an entity with
very many visits is never held as a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborstat.functions.labels import drop_absolute, drop_relative, progressed
from arborstat.functions.numeric import count_if, dbl, intercept, pearson, ratio, slope
from arborstat.plans.ordered import rank_quartile
from arborstat.plans.selection import grouped


def _nearest(target: int, *first: Column) -> Column:
    """Aggregate: (value, week) of the visit nearest to ``target``; ties by week, then row."""
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(first)], F.abs(F.col("week") - target).alias("d"), F.col("week").alias("w"), F.col("row_id").alias("r"))
    return F.min_by(F.struct("value", "week"), order)


def nearest_visit(visits: DataFrame, target: int) -> DataFrame:
    return visits.groupBy("entity").agg(_nearest(target).alias("v")).select("entity", "v.value", "v.week")


def nearest_visit_windowed(visits: DataFrame, target: int, lo: int, hi: int) -> DataFrame:
    """Nearest visit inside [lo, hi], else the nearest of all."""
    outside = ~F.col("week").between(lo, hi)
    return visits.groupBy("entity").agg(_nearest(target, outside).alias("v")).select(
        "entity", "v.value", "v.week", F.col("v.week").between(lo, hi).alias("in_window")
    )


def nearest_pair(visits: DataFrame, first: int, last: int) -> DataFrame:
    return visits.groupBy("entity").agg(_nearest(first).alias("a"), _nearest(last).alias("b")).select(
        "entity", F.col("a.value").alias("first_value"), F.col("b.value").alias("last_value")
    )


def drops(pairs: DataFrame, first: str = "first_value", last: str = "last_value") -> DataFrame:
    return pairs.withColumns({"drop_absolute": drop_absolute(first, last), "drop_relative": drop_relative(first, last)})


def value_at_target(visits: DataFrame, target: int, window: int, max_distance: int) -> DataFrame:
    """Value of each entity at ``target``: exact, nearest, regression or extrapolation.

    One aggregation gathers everything the cascade can need; the cascade itself is
    a projection. Columns: value, actual_week, method, quality, n_points, distance.
    """
    dist = F.abs(F.col("week") - target)
    order = F.struct(dist.alias("d"), F.col("week").alias("w"), F.col("row_id").alias("r"))
    week = dbl("week")
    a = visits.where("value is not null").groupBy("entity").agg(
        F.min_by(F.struct("value", "week"), order).alias("near"),
        F.min(dist).alias("d"),
        count_if(dist <= window).alias("n_window"),
        F.count("*").alias("n"),
        F.min("week").alias("lo"), F.max("week").alias("hi"),
        F.avg("value").alias("mean"),
        slope("value", week).alias("slope"), intercept("value", week).alias("intercept"), pearson("value", week).alias("r"),
    )
    exact = F.col("d") < 1
    nearest = (F.col("d") <= window) & (F.col("d") <= max_distance)
    flat = (F.col("n") >= 2) & (F.col("lo") == F.col("hi"))
    fitted = F.col("n") >= 2
    gap = F.when(F.lit(target) < F.col("lo"), F.col("lo") - target).when(F.lit(target) > F.col("hi"), F.lit(target) - F.col("hi")).otherwise(0)
    ar = F.abs("r")

    def pick(on_exact, on_nearest, on_flat, on_fit, failed):
        return F.when(exact, on_exact).when(nearest, on_nearest).when(flat, on_flat).when(fitted, on_fit).otherwise(failed)

    a = a.withColumn("gap", gap)
    inside = (
        F.when((ar > 0.85) & (F.col("n") >= 3), "high").when(ar > 0.7, "medium").otherwise("low")
    )
    outside = (
        F.when(F.col("gap") > 15, "low").when(F.col("gap") > 8, "medium")
        .when((ar > 0.8) & (F.col("n") >= 3), "medium").otherwise("low")
    )
    none = F.lit(None)
    return a.select(
        "entity",
        pick(F.col("near.value"), F.col("near.value"), F.col("mean"), F.col("slope") * target + F.col("intercept"), none.cast("double")).alias("value"),
        pick(F.col("near.week"), F.col("near.week"), F.col("lo"), F.col("near.week"), none.cast("int")).alias("actual_week"),
        pick(
            F.lit("exact"), F.lit("nearest"), F.lit("regression_simple"),
            F.when(F.col("gap") == 0, "regression").otherwise("extrapolation"), F.lit("failed"),
        ).alias("method"),
        pick(
            F.lit("high"), F.when(F.col("d") <= 3, "high").when(F.col("d") <= 8, "medium").otherwise("low"),
            F.when(F.col("d") > 20, "low").otherwise("medium"), F.when(F.col("gap") == 0, inside).otherwise(outside), F.lit("failed"),
        ).alias("quality"),
        pick(F.lit(1).cast("long"), F.col("n_window"), F.col("n"), F.col("n"), F.col("n")).alias("n_points"),
        pick(F.col("d"), F.col("d"), F.col("d"), F.col("gap"), none.cast("int")).alias("distance"),
    )


def interpolated_targets(visits: DataFrame, demographics: DataFrame | None = None) -> DataFrame:
    """Values at weeks 0 and 52 with drops, one row per entity.

    ``demographics`` has one or more rows per entity with a ``row_id``; the first
    row counts.
    """
    cols = ("value", "actual_week", "method", "quality", "distance")

    def at(target, window, max_distance, prefix):
        v = value_at_target(visits, target, window, max_distance)
        return v.select("entity", *[F.col(c).alias(f"{prefix}_{c}") for c in cols])

    n = visits.groupBy("entity").agg(F.count("*").alias("n_measurements"))
    out = at(0, 10, 8, "week0").join(at(52, 15, 10, "week52"), "entity").join(n, "entity")
    out = drops(out, "week0_value", "week52_value")
    if demographics is not None:
        others = [c for c in demographics.columns if c not in ("entity", "row_id")]
        first = demographics.groupBy("entity").agg(*[F.min_by(c, "row_id").alias(c) for c in others])
        out = out.join(first, "entity", "left")
    return out


def decay_table(visits: DataFrame, baseline: tuple[int, int] = (-5, 10), late: tuple[int, int] = (42, 62)) -> DataFrame:
    """Baseline, week-42 and week-52 values per entity with drops and progression flags.

    Entities whose chosen visits fall outside ``baseline`` / ``late`` are left out.
    """
    outside = ~F.col("week").between(44, 60)
    d = visits.groupBy("entity").agg(
        _nearest(0).alias("a"), _nearest(42).alias("m"), _nearest(52, outside).alias("b")
    ).select(
        "entity", F.col("a.value").alias("baseline_value"), F.col("a.week").alias("baseline_week"),
        F.col("m.value").alias("week42_value"), F.col("m.week").alias("week42_week"),
        F.col("b.value").alias("week52_value"), F.col("b.week").alias("week52_week"),
    ).where(F.col("baseline_week").between(*baseline) & F.col("week52_week").between(*late))
    d = drops(d, "baseline_value", "week52_value")
    return d.withColumns({
        "change_percent": ratio(F.col("week52_value") - F.col("baseline_value"), "baseline_value") * 100,
        **progressed("drop_absolute", "drop_relative"),
    })


def decay_summary(decay: DataFrame) -> DataFrame:
    """The four-column target table."""
    return decay.select("entity", "baseline_value", "week42_value", F.col("drop_absolute").alias("drop_1_year"))


def baseline_metric(visits: DataFrame, metric: str, window: tuple[int, int] | None = (-5, 10), name: str = "baseline") -> DataFrame:
    """First non-null ``metric`` per entity in row order, within the week window if given."""
    v = visits.where(F.col(metric).isNotNull())
    if window is not None:
        v = v.where(F.col("week").between(*window))
    return v.groupBy("entity").agg(F.min_by(metric, "row_id").alias(name))


def with_quartiles(visits: DataFrame, metric: str = "value", window: tuple[int, int] | None = (-5, 10)) -> DataFrame:
    """Visits of entities with a baseline, with the rank quartile of the baseline over visit rows."""
    v = visits.join(baseline_metric(visits, metric, window), "entity").where("baseline is not null and value is not null")
    return rank_quartile(v, "baseline", "row_id")


def trajectories(quartiled: DataFrame, at_least: int = 3) -> DataFrame:
    return quartiled.groupBy("quartile", "week").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("*").alias("n")
    ).where(F.col("n") >= at_least)


def entity_slopes(visits: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares slope and R2 of value on week for groups with at least two visits."""
    week = dbl("week")
    return visits.groupBy(*keys).agg(
        slope("value", week).alias("slope"), F.count("value").alias("n"),
        F.regr_syy(dbl("value"), week).alias("syy"), F.regr_sxy(dbl("value"), week).alias("sxy"), F.regr_sxx(dbl("value"), week).alias("sxx"),
    ).where("n >= 2").withColumn(
        "r2", F.when(F.col("syy") > 0, ratio(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy"))).otherwise(0.0)
    ).drop("syy", "sxy", "sxx")


def decline_summary(quartiled: DataFrame) -> DataFrame:
    """Slopes per (quartile, entity) summarised per quartile, with direction counts."""
    s = entity_slopes(quartiled, ["quartile", "entity"]).where("slope is not null")
    base = quartiled.groupBy("quartile").agg(F.avg("baseline").alias("baseline_mean"))
    agg = grouped(s, ["quartile"], [
        F.avg("slope").alias("mean_decline"), F.stddev_pop("slope").alias("std_decline"), F.count("*").alias("n_entities"),
        count_if(F.col("slope") < -0.5).alias("declining"), count_if(F.col("slope").between(-0.5, 0.5)).alias("stable"),
        count_if(F.col("slope") > 0.5).alias("improving"),
    ], {"median_decline": ("slope", 0.5)})
    return agg.join(base, "quartile")


def direction_of_progression(summary: DataFrame) -> DataFrame:
    """Does a high or a low baseline go with the faster decline?"""
    m = summary.agg(
        F.max(F.when(F.col("quartile") == 1, F.col("mean_decline"))).alias("q1"),
        F.max(F.when(F.col("quartile") == 4, F.col("mean_decline"))).alias("q4"),
    )
    return m.withColumn(
        "direction",
        F.when(F.col("q4") < F.col("q1") - 0.3, "predictive").when(F.col("q1") < F.col("q4") - 0.3, "protective").otherwise("none"),
    )


def moving_average_spike(series: DataFrame, key: str, order: str, value: str, width: int = 5) -> DataFrame:
    """First index whose smoothed step exceeds mean |step| + 2 deviations, else the middle index.

    ``series`` holds one row per (key, step) of an aggregated profile; indexes are
    0-based positions in ``order``. The mean covers a row and the ``width - 1``
    after it, incomplete windows are left out.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    s = series.withColumns({
        "idx": F.row_number().over(w) - 1,
        "avg": F.avg(value).over(w.rowsBetween(0, width - 1)),
        "full": F.count(value).over(w.rowsBetween(0, width - 1)) == width,
    })
    s = s.withColumn("step", F.when(F.lead("full").over(w), F.lead("avg").over(w) - F.col("avg")))
    limit = s.groupBy(key).agg(
        F.count("*").alias("__rows"), (F.avg(F.abs("step")) + 2 * F.stddev_pop("step")).alias("limit")
    )
    return (
        s.join(limit, key).groupBy(key)
        .agg(F.max("__rows").alias("n"), F.min(F.when(F.col("step") > F.col("limit"), F.col("idx"))).alias("spike"))
        .select(
            key, F.col("spike").isNotNull().alias("found"),
            F.when(F.col("spike").isNotNull(), F.least(F.col("spike") + width, F.col("n") - 1)).otherwise(F.floor(F.col("n") / 2)).cast("long").alias("index"),
        )
    )
