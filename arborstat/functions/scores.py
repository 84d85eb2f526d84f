"""Piecewise component scores on a 0-10 scale.

Every score is a list of :class:`Band` rows read top to bottom; the first band
whose upper bound holds gives the score and its wording. A missing value scores
the neutral 5 with the wording 'Unknown' and is not counted as valid.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

from arborstat.functions.numeric import col, dbl

NEUTRAL = 5.0


class Band(NamedTuple):
    """score = base + gain * (x - anchor) / span, then clamped to [floor, cap]."""

    upto: float | None  # upper bound of x; None for the last band
    closed: bool  # whether the bound itself belongs to the band
    base: float
    text: str
    gain: float = 0.0
    anchor: float = 0.0
    span: float = 1.0
    floor: float | None = None
    cap: float | None = None
    folded: bool = False  # use |x - anchor|


def band_score(value: str, bands: list[Band], missing: str = "Unknown") -> tuple[Column, Column]:
    """(raw score, wording) of the SQL expression ``value`` under ``bands``."""
    x = f"cast({value} as double)"
    score, text = f"case when {x} is null then {NEUTRAL}D", f"case when {x} is null then '{missing}'"
    for b in bands:
        delta = f"({x} - ({b.anchor}D))"
        if b.folded:
            delta = f"abs{delta}"
        s = f"{b.base}D + ({b.gain}D) * {delta} / {b.span}D" if b.gain else f"{b.base}D"
        if b.floor is not None:
            s = f"greatest({s}, {b.floor}D)"
        if b.cap is not None:
            s = f"least({s}, {b.cap}D)"
        when = "else" if b.upto is None else f"when {x} {'<=' if b.closed else '<'} {b.upto}D then"
        score += f" {when} {s}"
        text += f" {when} '{b.text}'"
    return F.expr(f"{score} end"), F.expr(f"{text} end")


# --- fixed values: score bands -------------------------------------------------
PC_RATIO = [
    Band(0.15, False, 10.0, "Severe peripheral airway loss"),
    Band(0.25, False, 7.0, "Moderate to severe peripheral loss", -3.0, 0.25, 0.10),
    Band(0.40, False, 4.0, "Mild peripheral airway loss", -3.0, 0.40, 0.15),
    Band(0.65, True, 0.0, "Within normal range", 1.5, 0.45, 0.15, cap=3.0, folded=True),
    Band(None, False, 2.0, "Unusually high (possible compensatory changes)", 1.0, 0.65, 0.20, cap=3.0),
]
PC_RATIO_RESCORED = [*PC_RATIO[:-1], PC_RATIO[-1]._replace(text="Unusually high")]
TORTUOSITY = [
    Band(1.0, False, 1.0, "Unusually straight airways", -2.0, 1.0),
    Band(1.5, True, 0.0, "Within normal range", 1.5, 1.25, 0.15, cap=3.0, folded=True),
    Band(2.0, True, 4.0, "Mild airway distortion", 2.0, 1.5, 0.5),
    Band(2.5, True, 7.0, "Moderate airway distortion", 1.0, 2.0, 0.5),
    Band(None, False, 9.0, "Severe airway distortion", 1.0, 2.5, 0.5, cap=10.0),
]
TORTUOSITY_RESCORED = [
    Band(1.0, False, 1.0, "Unusually straight airways", -2.0, 1.0),
    Band(1.5, True, 0.0, "Within normal range", 1.5, 1.25, 0.15, cap=3.0, folded=True),
    Band(2.0, False, 3.0, "Mild airway distortion", 3.0, 1.5, 0.5),
    Band(2.5, False, 6.0, "Moderate airway distortion", 2.0, 2.0, 0.5),
    Band(None, False, 8.0, "Severe airway distortion", 2.0, 2.5, 0.5, cap=10.0),
]
GENERATION_COVERAGE = [
    Band(0.50, False, 9.0, "Very poor coverage - severe airway loss", -1.0, 0.50, 0.30, cap=10.0),
    Band(0.70, False, 7.0, "Poor coverage with significant gaps", -1.0, 0.70, 0.20),
    Band(0.80, False, 4.0, "Fair coverage with moderate gaps", -2.0, 0.80, 0.10),
    Band(0.90, True, 1.0, "Good coverage with minor gaps", -2.0, 0.90, 0.10),
    Band(None, False, 0.0, "Excellent generation coverage", -10.0, 1.0),
]
AIRWAY_VOLUME = [
    Band(10000.0, True, 8.0, "Severe airway volume loss", -1.0, 10000.0, 5000.0, floor=0.0, cap=10.0),
    Band(15000.0, True, 6.0, "Significant airway volume loss", -2.0, 15000.0, 5000.0, floor=0.0, cap=10.0),
    Band(20000.0, True, 3.0, "Moderate airway volume reduction", -3.0, 20000.0, 5000.0, floor=0.0, cap=10.0),
    Band(30000.0, True, 0.0, "Good airway volume", -3.0, 30000.0, 10000.0, floor=0.0, cap=10.0),
    Band(None, False, 0.0, "Excellent airway volume - well preserved"),
]
SYMMETRY = [
    Band(0.50, False, 8.0, "Severe asymmetry - unilateral predominance", -2.0, 0.50, 0.30, cap=10.0),
    Band(0.70, False, 6.0, "Moderate asymmetry - possible focal disease", -1.0, 0.70, 0.20),
    Band(0.80, False, 4.0, "Fair symmetry", -1.0, 0.80, 0.10),
    Band(0.90, True, 1.0, "Good symmetry with minor differences", -2.0, 0.90, 0.10),
    Band(None, False, 0.0, "Highly symmetric - bilateral disease pattern", -10.0, 1.0),
]
ASYMMETRY_RESCORED = [  # read on |1 - symmetry|
    Band(0.15, False, 0.0, "Symmetric - bilateral disease"),
    Band(0.30, False, 0.0, "Mildly asymmetric", 4.0, 0.15, 0.15),
    Band(0.50, False, 4.0, "Moderate asymmetry", 3.0, 0.30, 0.20),
    Band(None, False, 7.0, "Severe asymmetry", 3.0, 0.50, 0.30, cap=10.0),
]
TAPERING_DEVIATION = [
    Band(0.05, False, 0.0, "Normal tapering pattern", 2.0, 0.0, 0.05),
    Band(0.10, False, 2.0, "Mild tapering abnormality", 2.0, 0.05, 0.05),
    Band(0.15, False, 5.0, "Moderate tapering abnormality", 2.0, 0.10, 0.05),
    Band(None, False, 8.0, "Severe tapering abnormality", 2.0, 0.15, 0.10, cap=10.0),
]
PERIPHERAL_DENSITY = [
    Band(0.03, False, 10.0, "Severe peripheral airway loss"),
    Band(0.05, False, 7.0, "Moderate to severe peripheral loss", -3.0, 0.05, 0.02),
    Band(0.08, False, 4.0, "Mild peripheral airway loss", -3.0, 0.08, 0.03),
    Band(0.15, True, 4.0, "Within normal range", -4.0, 0.08, 0.07, floor=0.0),
    Band(None, False, 0.0, "Excellent peripheral preservation"),
]
PERIPHERAL_DIAMETER = [
    Band(1.5, False, 10.0, "Severe diameter reduction"),
    Band(2.0, False, 6.0, "Moderate diameter reduction", -4.0, 2.0, 0.5),
    Band(2.5, False, 3.0, "Mild diameter reduction", -3.0, 2.5, 0.5),
    Band(None, False, 3.0, "Normal diameter", -3.0, 2.5, 1.0, floor=0.0),
]
PERIPHERAL_BRANCH_VOLUME = [
    Band(10.0, False, 10.0, "Severe volume loss"),
    Band(20.0, False, 6.0, "Moderate volume loss", -4.0, 20.0, 10.0),
    Band(30.0, False, 3.0, "Mild volume reduction", -3.0, 30.0, 10.0),
    Band(None, False, 3.0, "Good volume", -3.0, 30.0, 30.0, floor=0.0),
]
PERIPHERAL_PERCENT = [
    Band(10.0, False, 10.0, ""),
    Band(15.0, False, 6.0, "", -4.0, 15.0, 5.0),
    Band(20.0, False, 3.0, "", -3.0, 20.0, 5.0),
    Band(None, False, 3.0, "", -3.0, 20.0, 10.0, floor=0.0),
]
# The fall from 2 to 0 before 5.0 is part of the score.
PARENCHYMAL_ENTROPY = [
    Band(4.0, False, 0.0, "Very homogeneous (unusual)"),
    Band(5.0, False, 0.0, "Normal homogeneity", -2.0, 5.0, floor=0.0),
    Band(5.5, False, 2.0, "Mild texture heterogeneity", 2.0, 5.0, 0.5),
    Band(6.0, False, 4.0, "Moderate texture heterogeneity", 2.0, 5.5, 0.5),
    Band(6.5, False, 6.0, "Marked texture heterogeneity", 2.0, 6.0, 0.5),
    Band(None, False, 8.0, "Severe texture heterogeneity", 2.0, 6.5, 0.5, cap=10.0),
]
PARENCHYMAL_ENTROPY_RESCORED = [PARENCHYMAL_ENTROPY[0]._replace(text="Very homogeneous"), *PARENCHYMAL_ENTROPY[1:]]
# Inside each band the score falls as density rises; that is part of the score.
PARENCHYMAL_DENSITY = [
    Band(-900.0, False, 0.0, "Very low density (emphysematous)"),
    Band(-850.0, False, 0.0, "Low density", -1.0, -850.0, 50.0, floor=0.0),
    Band(-750.0, False, 1.0, "Normal density", -2.0, -750.0, 100.0),
    Band(-700.0, False, 3.0, "Mildly increased density", -2.0, -700.0, 50.0),
    Band(-650.0, False, 5.0, "Moderately increased density", -2.0, -650.0, 50.0),
    Band(-600.0, False, 7.0, "Markedly increased density", -2.0, -600.0, 50.0),
    Band(None, False, 9.0, "Severe parenchymal density increase", -1.0, -600.0, 50.0, cap=10.0),
]

# --- fixed values: component weights -------------------------------------------
WEIGHTS_AIRWAY = {
    "peripheral_density": 0.35,
    "peripheral_volume": 0.25,
    "pc_ratio": 0.20,
    "tortuosity": 0.15,
    "symmetry": 0.05,
}
WEIGHTS_COMBINED = {
    "parenchymal_entropy": 0.35,
    "parenchymal_density": 0.25,
    "peripheral_density": 0.15,
    "peripheral_volume": 0.15,
    "tortuosity": 0.05,
    "symmetry": 0.05,
}
IDEAL_TAPERING = 2.0 ** (-1.0 / 3.0)


def tortuosity_score(v: str, profile: str = "scorer"):
    return band_score(v, TORTUOSITY if profile == "scorer" else TORTUOSITY_RESCORED)


def symmetry_score(v: str, profile: str = "scorer"):
    if profile == "scorer":
        return band_score(v, SYMMETRY)
    return band_score(f"abs(1D - {v})", ASYMMETRY_RESCORED)


def peripheral_volume_score(diameter: str, branch_volume: str, percent: str) -> tuple[Column, Column, Column]:
    """(raw, wording, valid): mean of the sub-scores whose input is present."""
    d, d_text = band_score(diameter, PERIPHERAL_DIAMETER)
    v, v_text = band_score(branch_volume, PERIPHERAL_BRANCH_VOLUME)
    p, _ = band_score(percent, PERIPHERAL_PERCENT)
    have = [dbl(diameter).isNotNull(), dbl(branch_volume).isNotNull(), dbl(percent).isNotNull()]
    n = sum((h.cast("int") for h in have[1:]), have[0].cast("int"))
    total = sum(
        (F.when(h, s).otherwise(0.0) for h, s in zip(have[1:], [v, p])), F.when(have[0], d).otherwise(0.0)
    )
    raw = F.when(n > 0, F.try_divide(total, n)).otherwise(NEUTRAL)
    text = F.concat_ws("; ", F.when(have[0], d_text), F.when(have[1], v_text))
    return raw, F.when(text == "", "Unknown").otherwise(text), n > 0


def tapering_score(mean_ratio: str, std_ratio: str) -> tuple[Column, Column]:
    """Deviation of the mean adjacent ratio from its ideal, one point more when it varies a lot."""
    m = dbl(mean_ratio)
    raw, text = band_score(f"abs({mean_ratio} - {IDEAL_TAPERING}D)", TAPERING_DEVIATION)
    loose = dbl(std_ratio) > 0.15
    raw = F.when(m.isNull(), NEUTRAL).otherwise(F.least(F.lit(10.0), raw + F.when(loose, 1.0).otherwise(0.0)))
    return raw, F.when(m.isNotNull() & loose, F.concat(text, F.lit(" with high variability"))).otherwise(text)


def volume_distribution_score(n_generations, decreasing_ratio, abrupt_drops, early_cv) -> Column:
    """Additive penalties for an uneven volume profile; neutral below three generations."""
    dr, drops, cv = dbl(decreasing_ratio), col(abrupt_drops), dbl(early_cv)
    penalty = (
        F.when(dr < 0.6, 3.0).when(dr < 0.8, 1.5).otherwise(0.0)
        + F.when(drops > 2, 4.0).when(drops > 0, 2.0).otherwise(0.0)
        + F.when(cv > 1.5, 3.0).when(cv > 1.0, 1.5).otherwise(0.0)
    )
    return F.when(col(n_generations) < 3, NEUTRAL).otherwise(F.least(F.lit(10.0), penalty))
