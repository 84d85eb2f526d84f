"""Run-to-run comparison, report text parsing and report assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from arborstat.functions.numeric import count_if, dbl, ratio

# Labelled lines of the text report.
NUMBER_PATTERNS = {
    "total_branches": r"Total branches:\s*(\d+)",
    "total_length_mm": r"Total tree length:\s*([\d.]+)\s*mm",
    "total_volume_mm3": r"Total tree volume:\s*([\d.]+)\s*mm³",
    "diameter_mean": r"Diameter.*Mean:\s*([\d.]+)\s*mm",
    "max_generation": r"Maximum generation:\s*(\d+)",
    "num_generations": r"Number of generations:\s*(\d+)",
    "pc_ratio": r"P/C Ratio:\s*([\d.]+)",
    "tortuosity": r"Tortuosity:\s*([\d.]+)",
    "symmetry": r"Symmetry Index:\s*([\d.]+)",
    "generation_coverage": r"Generation Coverage:\s*([\d.]+)%",
    "fibrosis_score": r"FIBROSIS SCORE:\s*([\d.]+)/100",
}
PAIR_PATTERNS = {
    "central": r"Central:\s*([\d.]+)\s*mm³\s*\((\d+)\s*branches\)",
    "peripheral": r"Peripheral:\s*([\d.]+)\s*mm³\s*\((\d+)\s*branches\)",
}
STAGE_PATTERN = r"CLASSIFICATION:\s*([^\n]+)"

# Metrics where a larger value is better.
HIGHER_IS_BETTER = {
    "total_branches": True, "total_volume_mm3": True, "max_generation": True, "pc_ratio": True,
    "peripheral_branches": True, "central_branches": True, "symmetry": True, "tortuosity": False,
    "generation_coverage": True, "fibrosis_score": False, "diameter_mean": True,
}


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_report_metrics(df: DataFrame, text: str) -> DataFrame:
    """Typed metrics of a text report; a label that is absent gives NULL."""
    body = F.col(text)
    cols = {n: _group(body, p, 1).try_cast("double") for n, p in NUMBER_PATTERNS.items()}
    for n, p in PAIR_PATTERNS.items():
        cols[f"{n}_volume"] = _group(body, p, 1).try_cast("double")
        cols[f"{n}_branches"] = _group(body, p, 2).try_cast("long")
    cols["fibrosis_stage"] = F.nullif(F.trim(_group(body, STAGE_PATTERN, 1)), F.lit(""))
    return df.withColumns(cols)


def extract_section(df: DataFrame, text: str, start: str, end: str) -> DataFrame:
    """Text from the start marker up to the end marker after it; NULL if either is absent."""
    body = F.col(text)
    a = F.instr(body, start)
    b = F.when(a > 0, F.position(F.lit(end), body, a)).otherwise(0)
    return df.withColumns({
        "extracted": b > 0,
        "section": F.when(b > 0, F.substr(body, a, b - a)),
    })


def combine_sections(df: DataFrame, key: str, section: str = "section") -> DataFrame:
    """One block per case that has a section, in case order, under a case header.

    The blocks stay rows: a combined document is the sorted output of a write, so
    it never has to fit in one task.
    """
    rule = "=" * 80
    head = F.concat(F.lit(f"\n\n{rule}\nCASE: "), F.col(key).cast("string"), F.lit(f"\n{rule}\n\n"))
    return df.where(F.col(section).isNotNull()).select(key, F.concat(head, F.col(section)).alias("block")).orderBy(key)


def section_counts(df: DataFrame) -> DataFrame:
    return df.agg(count_if(F.col("extracted")).alias("successful"), count_if(~F.col("extracted")).alias("failed"))


def unpivot_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), dbl(m).alias("value")) for m in metrics])))


def pair_runs(old: DataFrame, new: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, metric, old, new) for every key of either run."""
    o = old.select(key, *[F.col(m).alias(f"old_{m}") for m in metrics])
    n = new.select(key, *[F.col(m).alias(f"new_{m}") for m in metrics])
    rows = [F.struct(F.lit(m).alias("metric"), dbl(f"old_{m}").alias("old"), dbl(f"new_{m}").alias("new")) for m in metrics]
    return o.join(n, key, "full_outer").select(key, F.inline(F.array(*rows)))


def change_rows(pairs: DataFrame, higher_is_better: dict[str, bool] = HIGHER_IS_BETTER) -> DataFrame:
    """diff, percent change (0 when the old value is 0) and verdict per pair."""
    up = F.lit(True)
    for m, better in higher_is_better.items():
        if not better:
            up = F.when(F.col("metric") == m, False).otherwise(up)
    diff = F.col("new") - F.col("old")
    return pairs.withColumn("diff", diff).withColumns({
        "pct_change": F.when(F.col("old") == 0, 0.0).otherwise(ratio("diff", "old") * 100),
        "verdict": F.when(F.col("diff").isNull(), F.lit(None)).when(F.abs("diff") < 0.001, "same")
        .when((F.col("diff") > 0) == up, "better").otherwise("worse"),
    })


def key_findings(old_new: DataFrame, key: str) -> DataFrame:
    """Improvements and regressions of the three key metrics; the first rule that holds wins.

    Expects old_/new_ columns for pc_ratio, symmetry and peripheral_branches.
    """

    def rule(m, up, down, cross=None):
        o, n = dbl(f"old_{m}"), dbl(f"new_{m}")
        f = F.when((n > cross) & (o < cross), "corrected") if cross is not None else F.when(F.lit(False), "")
        return F.struct(F.lit(m).alias("metric"), f.when(n > o * up, "improved").when(n < o * down, "regressed").alias("finding"))

    return old_new.select(key, F.inline(F.array(
        rule("pc_ratio", 1.1, 0.9), rule("symmetry", 1.1, 0.9, 0.5), rule("peripheral_branches", 1.2, 0.8),
    ))).where("finding is not null")


def generation_comparison(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean value per generation in both runs; each side is aggregated before the join."""
    o = old.groupBy(*keys, "generation").agg(F.avg(value).alias("old_mean"))
    n = new.groupBy(*keys, "generation").agg(F.avg(value).alias("new_mean"))
    return o.join(n, [*keys, "generation"]).withColumn("diff", F.col("new_mean") - F.col("old_mean"))


def batch_outcomes(df: DataFrame, success: str = "success", error: str = "error") -> DataFrame:
    return df.groupBy(success, error).agg(F.count("*").alias("n"))
