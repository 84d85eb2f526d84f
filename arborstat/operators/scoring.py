"""Component scores, weighted totals, stages and findings per case.

All components of a case come from one row, so scoring a table of cases is a
projection: no shuffle, no join, whatever the number of cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from arborstat.functions import scores as S
from arborstat.functions.labels import stage
from arborstat.functions.numeric import count_if, dbl, ratio

# Input column of each simple component.
INPUTS = {
    "pc_ratio": "pc_ratio", "tortuosity": "tortuosity", "symmetry": "symmetry", "peripheral_density": "peripheral_density",
    "parenchymal_entropy": "entropy", "parenchymal_density": "lung_density",
    "airway_volume": "volume_mm3", "generation_coverage": "generation_coverage",
}


#: Relative difference up to which sums count as equal.
SAME = 1e-9


def component(name: str, profile: str = "scorer") -> tuple[Column, Column, Column]:
    """(raw score, wording, valid) of a component over the standard input columns."""
    if name == "peripheral_volume":
        return S.peripheral_volume_score("peripheral_diameter", "peripheral_branch_volume", "peripheral_pct")
    value = INPUTS[name]
    if name == "tortuosity":
        raw, text = S.tortuosity_score(value, profile)
    elif name == "symmetry":
        raw, text = S.symmetry_score(value, profile)
    elif profile != "scorer" and name == "pc_ratio":
        raw, text = S.band_score(value, S.PC_RATIO_RESCORED)
    elif profile != "scorer" and name == "parenchymal_entropy":
        raw, text = S.band_score(value, S.PARENCHYMAL_ENTROPY_RESCORED, "Not available")
    elif profile != "scorer" and name == "parenchymal_density":
        raw, text = S.band_score(value, S.PARENCHYMAL_DENSITY, "Not available")
    else:
        bands = {
            "pc_ratio": S.PC_RATIO, "peripheral_density": S.PERIPHERAL_DENSITY, "parenchymal_entropy": S.PARENCHYMAL_ENTROPY,
            "parenchymal_density": S.PARENCHYMAL_DENSITY, "airway_volume": S.AIRWAY_VOLUME, "generation_coverage": S.GENERATION_COVERAGE,
        }[name]
        raw, text = S.band_score(value, bands)
    return raw, text, dbl(value).isNotNull()


def score_components(df: DataFrame, key: str, names: list[str], profile: str = "scorer") -> DataFrame:
    """Long form: one row per (case, component) with raw score, wording and validity."""
    rows = []
    for n in names:
        raw, text, valid = component(n, profile)
        rows.append(F.struct(F.lit(n).alias("component"), raw.alias("raw_score"), text.alias("interpretation"), valid.alias("is_valid")))
    return df.select(key, F.inline(F.array(*rows)))


def with_scores(df: DataFrame, names: list[str], profile: str = "scorer") -> DataFrame:
    """Adds raw_<component> and ok_<component>; later expressions read these columns."""
    cols = {}
    for n in names:
        raw, _, valid = component(n, profile)
        cols[f"raw_{n}"], cols[f"ok_{n}"] = raw, valid
    return df.withColumns(cols)


def weighted_total(weights: dict[str, float]) -> tuple[Column, Column]:
    """(sum of weighted scores, available weight) over the valid components of :func:`with_scores`."""
    total = " + ".join(f"if(ok_{n}, raw_{n} * {w}D, 0D)" for n, w in weights.items())
    available = " + ".join(f"if(ok_{n}, {w}D, 0D)" for n, w in weights.items())
    return F.expr(f"0D + {total}"), F.expr(f"0D + {available}")


def assess(df: DataFrame, key: str, profile: str = "scorer") -> DataFrame:
    """Airway-only and combined totals with stage and confidence, and the overall choice.

    The scorer profile has no combined score without parenchymal data and falls
    back to 50 when nothing is valid; the rescorer computes combined from whatever
    is there and leaves an empty case unknown.
    """
    names = list(dict.fromkeys([*S.WEIGHTS_AIRWAY, *S.WEIGHTS_COMBINED]))
    a_total, a_conf = weighted_total(S.WEIGHTS_AIRWAY)
    c_total, c_conf = weighted_total(S.WEIGHTS_COMBINED)
    sums = with_scores(df, names, profile).select(
        *df.columns, a_total.alias("__at"), a_conf.alias("airway_confidence"), c_total.alias("__ct"), c_conf.alias("combined_confidence")
    )

    def score(total: str, weight: str) -> Column:
        return ratio(total, F.nullif(F.col(weight), F.lit(0.0))) * 10

    unknown = None
    a_score, c_score = score("__at", "airway_confidence"), score("__ct", "combined_confidence")
    if profile == "scorer":
        has = dbl("entropy").isNotNull() | dbl("lung_density").isNotNull()
        a_score = F.coalesce(a_score, F.lit(50.0))
        c_score, c_conf = F.when(has, F.coalesce(c_score, F.lit(50.0))), F.when(has, F.col("combined_confidence"))
    else:
        unknown, c_conf = "Unknown", F.col("combined_confidence")
    out = sums.select(*df.columns, a_score.alias("airway_score"), "airway_confidence", c_score.alias("combined_score"), c_conf.alias("combined_confidence"))
    combined = F.col("combined_score").isNotNull()
    return out.withColumns({
        "airway_stage": stage("airway_score", unknown),
        "combined_stage": F.when(combined, stage("combined_score")),
        "overall_score": F.coalesce("combined_score", "airway_score"),
        "overall_confidence": F.when(combined, F.col("combined_confidence")).otherwise(F.col("airway_confidence")),
    }).withColumn("overall_stage", stage("overall_score", unknown))


def assess_airway(df: DataFrame) -> DataFrame:
    """Airway-only rescoring: rescored components, 50 when no component is valid."""
    total, available = weighted_total(S.WEIGHTS_AIRWAY)
    out = with_scores(df, list(S.WEIGHTS_AIRWAY), "rescorer").select(*df.columns, total.alias("__total"), available.alias("confidence"))
    score = ratio("__total", F.nullif(F.col("confidence"), F.lit(0.0))) * 10
    return out.withColumn("score", F.coalesce(score, F.lit(50.0))).drop("__total").withColumn("stage", stage("score"))


def rescore_counters(df: DataFrame) -> DataFrame:
    """One row of batch counters over assessed cases."""
    missing = dbl("entropy").isNull() & dbl("lung_density").isNull()
    return df.agg(
        F.count("*").alias("total"), count_if(F.col("overall_score").isNotNull()).alias("rescored"),
        count_if(F.col("overall_score").isNull()).alias("skipped"), count_if(missing).alias("without_parenchymal"),
    )


def findings(df: DataFrame, names: list[str], profile: str = "scorer") -> DataFrame:
    """Adds ``findings``: prominent components by stage of the overall score, and alerts.

    Scores are compared at nine decimals, so that one that lies on a limit does so however its terms were rounded.
    """
    scored = with_scores(df, names, profile)
    comps, score = F.array(*[F.struct(F.lit(n).alias("n"), F.round(f"raw_{n}", 9).alias("s")) for n in names]), F.round("overall_score", 9)

    def above(keep) -> Column:
        return F.transform(F.filter(comps, keep), lambda c: c["n"])

    alerts = F.array_compact(F.array(
        F.when(dbl("pc_ratio") < 0.25, "severe peripheral loss"), F.when(dbl("generation_coverage") < 0.70, "generation loss"),
    ))
    return scored.select(
        *df.columns,
        F.when((score >= 35) & (score < 50), above(lambda c: c["s"] > 6))
        .when((score >= 50) & (score < 70), alerts)
        .when(score >= 70, above(lambda c: c["s"] >= 8))
        .otherwise(F.array().cast("array<string>")).alias("findings"),
    )


def volume_distribution(volumes: DataFrame) -> DataFrame:
    """Score the volume profile over generations of (scan_id, generation, volume_mm3).

    One row per generation, so the window holds a bounded number of rows per scan.
    Volumes and drops that agree to a billionth are equal, whatever the order of the sums.
    """
    w = Window.partitionBy("scan_id").orderBy("generation")
    v, nxt = F.col("volume_mm3"), F.lead("volume_mm3").over(w)
    s = volumes.select("scan_id", v, nxt.alias("__next"), F.row_number().over(w).alias("__i"))
    early = F.when(F.col("__i") <= 5, v)
    a = s.groupBy("scan_id").agg(
        F.count("*").alias("n_generations"),
        count_if(v - F.col("__next") > F.abs(v) * SAME).alias("__down"),
        count_if((v > 0) & (F.try_divide(v - F.col("__next"), v) > 0.80 + SAME)).alias("abrupt_drops"),
        F.avg(early).alias("__m"), F.stddev_pop(early).alias("__s"),
    )
    a = a.withColumns({
        "decreasing_ratio": F.coalesce(ratio("__down", F.col("n_generations") - 1), F.lit(0.0)),
        "early_cv": F.when((F.col("n_generations") >= 5) & (F.col("__m") > 0), ratio("__s", "__m")).otherwise(0.0),
    }).drop("__down", "__m", "__s")
    return a.withColumn("raw_score", S.volume_distribution_score("n_generations", "decreasing_ratio", "abrupt_drops", "early_cv"))


def tapering_component(ratios: DataFrame) -> DataFrame:
    """Score the adjacent-generation ratios of (scan_id, diameter_ratio)."""
    a = ratios.groupBy("scan_id").agg(F.avg("diameter_ratio").alias("mean_ratio"), F.stddev_pop("diameter_ratio").alias("std_ratio"))
    raw, text = S.tapering_score("mean_ratio", "std_ratio")
    return a.withColumns({"deviation": F.abs(F.col("mean_ratio") - S.IDEAL_TAPERING), "raw_score": raw, "interpretation": text})
