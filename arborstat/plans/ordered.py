"""Ordered operations on groups that may be far larger than one task should hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arborstat.functions.numeric import clean
from arborstat.plans.selection import positions

def with_previous(df: DataFrame, keys: list[str], seq: str, cols: list[str]) -> DataFrame:
    """Add ``prev_<col>``: the row before in ``seq`` order within ``keys``.

    ``seq`` is unique per key; gaps do not matter. Rows get their position in the global
    order of (keys, seq) once and meet the position before by an equi-join, so one key
    may hold most of the rows.
    """
    at = positions(df, [*keys, seq], "__at")
    before = at.select((F.col("__at") + 1).alias("__at"), *[F.col(k).alias(f"__of_{k}") for k in keys], F.lit(True).alias("__met"), *[F.col(c).alias(f"prev_{c}") for c in cols])
    same = F.col("__met").isNotNull()
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    out = at.join(before, "__at", "left")
    return out.withColumns({f"prev_{c}": F.when(same, F.col(f"prev_{c}")) for c in cols}).drop("__at", "__met", *[f"__of_{k}" for k in keys])


def rank_quartile(df: DataFrame, value: str, row_id: str, name: str = "quartile") -> DataFrame:
    """Add the quartile 1-4 of each row's rank by (value, row_id) over the whole table.

    The rows are ordered once in narrow form; the three rows at the cuts come back to the
    driver and every row is compared with them, so the table itself is not moved. A table
    without rows or with one row is all first quartile; a NULL value has none.
    """
    narrow = df.select(clean(value).alias("v"), F.col(row_id).alias("row")).where("v is not null")
    at = positions(narrow, ["v", "row"], "at")
    n = at.count()
    if not n:
        return df.withColumn(name, F.lit(None).cast("int"))
    place = {q: q * (n - 1) // 4 for q in (1, 2, 3)}
    rows = {r["at"]: r for r in at.where(F.col("at").isin(list(place.values()))).collect()}  # three rows
    v, r = clean(value), F.col(row_id)
    quart = F.when(v.isNull(), F.lit(None).cast("int"))
    for q, p in place.items():
        cut = rows[p]
        quart = quart.when((v < cut["v"]) | ((v == cut["v"]) & (r <= cut["row"])), q)
    return df.withColumn(name, quart.otherwise(4))
