"""Joins between cases, metric bags, visits and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from arborstat.functions.numeric import dbl


def join_demographics(left: DataFrame, demographics: DataFrame, key: str) -> DataFrame:
    """Left join of the distinct demographic rows.

    Only whole duplicate rows are dropped: an entity with inconsistent demographics
    fans out, as it should.
    """
    return left.join(demographics.dropDuplicates(), key, "left")


def integrated_dataset(cases: DataFrame, bags: DataFrame, visits: DataFrame, optional: DataFrame | None, case_key: str, entity: str) -> DataFrame:
    """(case x visit) rows: cases with a metric bag and visits, optional metrics where present.

    Case-constant columns repeat on every visit. The case side is joined first, so
    the visits are shuffled once.
    """
    c = cases.join(bags, case_key)
    if optional is not None:
        c = c.join(optional, case_key, "left")
    return visits.join(c, entity)


def first_target(targets: DataFrame, key: str, order: str) -> DataFrame:
    """First target row per key; an aggregate, so rows are combined before the shuffle."""
    others = [c for c in targets.columns if c != key]
    return targets.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("__t")).select(key, "__t.*")


def prediction_dataset(cases: DataFrame, targets: DataFrame, key: str, order: str) -> DataFrame:
    return cases.join(first_target(targets, key, order), key)


def with_match(cases: DataFrame, other: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(cases that have a match, cases that were skipped)."""
    return cases.join(other.select(key), key, "left_semi"), cases.join(other.select(key), key, "left_anti")


def pair_voxels(original: DataFrame, processed: DataFrame) -> DataFrame:
    """Original and processed intensity at the same position."""
    p = processed.select("scan_id", "z", "y", "x", F.col("hu").alias("hu_processed"))
    return original.join(p, ["scan_id", "z", "y", "x"])
