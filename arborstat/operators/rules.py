"""Checks over case metrics: long rows, roll-ups, wide summaries and the QC batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborstat.functions.labels import PLAUSIBLE_RANGES, plausibility, reference_check
from arborstat.functions.numeric import count_if, dbl


def long_checks(df: DataFrame, key: str, metrics: dict[str, str], limits=PLAUSIBLE_RANGES) -> DataFrame:
    """One row per (case, metric): value, status, message. No shuffle.

    ``metrics`` maps check names in ``limits`` to columns of ``df``.
    """
    rows = []
    for name, column in metrics.items():
        status, message = plausibility(dbl(column), *limits[name])
        rows.append(F.struct(F.lit(name).alias("metric"), dbl(column).alias("value"), status.alias("status"), message.alias("message")))
    return df.select(key, F.inline(F.array(*rows)))


def long_reference_checks(df: DataFrame, key: str, metrics: dict[str, str], references) -> DataFrame:
    rows = []
    for name, column in metrics.items():
        status, message = reference_check(dbl(column), *references[name])
        rows.append(F.struct(F.lit(name).alias("metric"), dbl(column).alias("value"), status.alias("status"), message.alias("message")))
    return df.select(key, F.inline(F.array(*rows)))


def rollup_checks(checks: DataFrame, key: str) -> DataFrame:
    """Per case: number of checks, passed, failed, and whether none failed."""
    return checks.groupBy(key).agg(
        F.count("*").alias("n_checks"), count_if(F.col("status") == "PASS").alias("n_passed"),
        count_if(F.col("status") == "FAIL").alias("n_failed"),
    ).withColumn("reliable", F.col("n_failed") == 0)


def pivot_checks(checks: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Wide summary: one value and one status column per metric.

    The metric list is fixed, so one grouped pass with filtered aggregates does it
    and no pass over the data is spent on finding the pivot values.
    """
    aggs: list[Column] = []
    for m in metrics:
        hit = F.col("metric") == m
        aggs.append(F.max(F.when(hit, F.col("value"))).alias(f"{m}_value"))
        aggs.append(F.max(F.when(hit, F.col("status"))).alias(f"{m}_status"))
    return checks.groupBy(key).agg(*aggs)


def qc_batch(
    df: DataFrame, key: str, metrics: dict[str, str], present: Column, zero_if_missing: tuple[str, ...] = (),
    failed: Column | None = None, limits=PLAUSIBLE_RANGES,
) -> DataFrame:
    """Quality-check every case on its own row, without a shuffle.

    A case without inputs is SKIPPED and one whose load failed is ERROR. A missing
    metric is not checked at all, except those in ``zero_if_missing``, which are
    judged as 0. Counts and wide columns come from the same row.
    """
    checked, passed, wide = F.lit(0), F.lit(0), []
    for name, column in metrics.items():
        v = dbl(column)
        if name in zero_if_missing:
            v = F.coalesce(v, F.lit(0.0))
        status, _ = plausibility(v, *limits[name])
        has = v.isNotNull() & present
        checked = checked + F.when(has, 1).otherwise(0)
        passed = passed + F.when(has & (status == "PASS"), 1).otherwise(0)
        wide += [F.when(has, v).alias(f"{name}_value"), F.when(has, status).alias(f"{name}_status")]
    broken = failed if failed is not None else F.lit(False)
    return df.select(key, checked.alias("__checked"), passed.alias("__passed"), present.alias("__present"), broken.alias("__broken"), *wide).select(
        key,
        F.when(~F.col("__present"), "SKIPPED").when(F.col("__broken"), "ERROR")
        .when(F.col("__checked") == F.col("__passed"), "RELIABLE").otherwise("UNRELIABLE").alias("status"),
        F.col("__checked").alias("tech_checks"), F.col("__passed").alias("tech_passed"),
        (F.col("__checked") - F.col("__passed")).alias("tech_failed"),
        *[F.col(f"{m}_{s}") for m in metrics for s in ("value", "status")],
    )


def status_distribution(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))
