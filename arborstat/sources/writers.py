"""Writers for result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = (), mode: str = "errorifexists") -> None:
    """Write a result as parquet, csv (with header) or json, by partition columns if given.

    Rows are not moved first: a partition value with most of the rows is written by
    all the tasks that hold it.
    """
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def assessment_document(df: DataFrame, key: str, components: DataFrame) -> DataFrame:
    """Nested assessment per case: overall, scoring methods and a component map.

    ``df`` has the assessed columns, ``components`` the long component rows with
    weights. The component set is fixed, so the map is small.
    """
    entry = F.struct(
        "raw_score", (F.col("raw_score") * F.col("weight_airway") * 10).alias("weighted_score_airway"),
        (F.col("raw_score") * F.col("weight_combined") * 10).alias("weighted_score_combined"), "interpretation", "weight_airway", "weight_combined",
    )
    bag = components.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", entry)))).alias("components"))

    def method(p: str) -> Column:
        return F.struct(F.col(f"{p}_score").alias("fibrosis_score"), F.col(f"{p}_stage").alias("stage"), F.col(f"{p}_confidence").alias("confidence"))

    return df.join(bag, key).select(
        key, method("overall").alias("overall"),
        F.struct(method("airway").alias("airway_only"), method("combined").alias("combined")).alias("scoring_methods"), "components",
    )
