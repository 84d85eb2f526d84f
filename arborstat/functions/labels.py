"""Rule checks, staging and threshold labels as column expressions.

Rule tables are plain Python values: small, fixed, and inlined as literals, so a
check costs no join. Callers may pass their own tables.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from arborstat.functions.numeric import clip, col, dbl, ratio

# Plausibility limits per metric (lo, hi).
PLAUSIBLE_RANGES = {
    "max_generation": (5.0, 35.0),
    "airway_volume_ml": (5.0, 600.0),
    "pc_ratio": (0.0, 5.0),
    "tapering_ratio": (0.5, 1.0),
    "branch_count": (50.0, 5000.0),
    "tortuosity": (1.0, 3.0),
}

# Published reference figures per metric (mean, std, lo, hi).
REFERENCE_RANGES = {
    "airway_volume_ml": (180.0, 50.0, 80.0, 350.0),
    "surface_area_cm2": (200.0, 80.0, 80.0, 400.0),
    "branch_count": (1500.0, 500.0, 500.0, 3000.0),
    "bifurcation_ratio": (0.15, 0.05, 0.05, 0.30),
    "avg_branch_length_mm": (12.0, 5.0, 5.0, 25.0),
    "max_generation": (18.0, 3.0, 12.0, 23.0),
    "tapering_ratio": (0.793, 0.05, 0.70, 0.88),
    "diameter_trachea_mm": (18.0, 2.0, 14.0, 22.0),
    "diameter_gen5_mm": (3.5, 1.0, 2.0, 6.0),
    "pc_ratio_healthy": (0.45, 0.15, 0.25, 0.65),
    "pc_ratio_fibrotic": (0.20, 0.10, 0.05, 0.35),
    "tortuosity": (1.25, 0.15, 1.0, 1.6),
}

# Severity stages by exclusive upper bound of the 0-100 score.
STAGES = (
    (20.0, "Minimal/No fibrosis"),
    (35.0, "Mild fibrosis"),
    (50.0, "Moderate fibrosis"),
    (70.0, "Moderate-severe fibrosis (UIP pattern)"),
)
TOP_STAGE = "Severe/Advanced fibrosis"

# Reconstruction kernels known to be sharp, and name keywords.
SHARP_KERNELS = ("B60f", "B70f", "B80f", "B80s", "FC51", "FC53", "FC18", "LUNG", "BONEPLUS")
SHARP_KEYWORDS = ("LUNG", "BONE", "EDGE", "SHARP", "DETAIL", "HIGH")
SMOOTH_KEYWORDS = ("SOFT", "SMOOTH", "STANDARD", "STD")

# Acquisition criteria.
MIN_SLICES = 300
THICKNESS_RANGE = (0.5, 1.5)
RESOLUTION_RANGE = (0.3, 1.1)

# Anatomical names of label codes.
LABEL_NAMES = {2: "Artery", 1: "Vein"}


def plausibility(value: Column | str, lo: float, hi: float) -> tuple[Column, Column]:
    """(status, message): missing fails, inside [lo, hi] passes, else fails."""
    v = col(value)
    inside = v.between(F.lit(lo), F.lit(hi))
    status = F.when(inside, "PASS").otherwise("FAIL")
    text = f"Outside technical limits ({lo:g}-{hi:g})"
    message = F.when(v.isNull(), "Value missing").when(inside, "Technically plausible").otherwise(text)
    return status, message


def reference_check(value: Column | str, mean: float, std: float, lo: float, hi: float) -> tuple[Column, Column]:
    """(status, message) with a WARNING band of two deviations around the mean."""
    v = col(value)
    inside = v.between(F.lit(lo), F.lit(hi))
    near = F.abs(v - mean) <= 2 * std
    status = F.when(inside, "PASS").when(near, "WARNING").otherwise("FAIL")
    message = (
        F.when(v.isNull(), "Value missing").when(inside, "Within literature range")
        .when(near, "Outside range but within 2σ").otherwise("Implausible value")
    )
    return status, message


def stage(score: Column | str, missing: str | None = None) -> Column:
    """Severity stage of a 0-100 score; bins are closed on the left."""
    s = col(score)
    out = F.when(s.isNull(), F.lit(missing))
    for upper, name in STAGES:
        out = out.when(s < upper, name)
    return out.otherwise(TOP_STAGE)


def strength(r: Column | str) -> Column:
    a = F.abs(col(r))
    return F.when(a >= 0.5, "Strong").when(a >= 0.3, "Moderate").when(a.isNotNull(), "Weak")


def direction(r: Column | str) -> Column:
    return F.when(col(r) > 0, "positive").when(col(r).isNotNull(), "negative")


def stars(p: Column | str) -> Column:
    p = col(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")


def drop_absolute(first: Column | str, last: Column | str) -> Column:
    return dbl(first) - dbl(last)


def drop_relative(first: Column | str, last: Column | str) -> Column:
    """Percent lost relative to the first value, NULL unless it is positive."""
    return F.when(dbl(first) > 0, ratio(drop_absolute(first, last), first) * 100)


def progressed(absolute: Column | str, relative: Column | str) -> dict[str, Column]:
    """Progression flags: >5 points, >10 percent, both. A missing drop is no progression."""
    a = F.coalesce(col(absolute) > 5, F.lit(False))
    r = F.coalesce(col(relative) > 10, F.lit(False))
    return {"progressed_absolute": a, "progressed_relative": r, "progressed_combined": a & r}


def region(generation: Column | str) -> Column:
    g = col(generation)
    return F.when(g <= 7, "central").when(g <= 10, "intermediate").when(g > 10, "peripheral")


def base_case(key: Column | str, suffix: str = "_gaussian") -> tuple[Column, Column]:
    """(key without the processing suffix, whether it carried one)."""
    return F.replace(col(key), F.lit(suffix), F.lit("")), F.contains(col(key), F.lit(suffix))


def kernel_sharpness(kernel: Column | str) -> tuple[Column, Column]:
    """(is_sharp, score 0-100) of a reconstruction kernel name.

    The exact list is case-sensitive; numbered B and FC families are judged by
    their first number, the rest by keyword.
    """
    k = col(kernel)
    up = F.upper(k)
    num = F.regexp_extract(up, "[0-9]+", 0).try_cast("int")
    b, fc = num.isNotNull() & up.startswith("B"), num.isNotNull() & up.startswith("FC")
    sharp_word, smooth_word = up.rlike("|".join(SHARP_KEYWORDS)), up.rlike("|".join(SMOOTH_KEYWORDS))
    blank = k.isNull() | (k == "")
    known = k.isin(*SHARP_KERNELS)
    sharp = (
        F.when(blank, False).when(known, True).when(b, num > 50).when(fc, num > 10)
        .when(sharp_word, True).otherwise(False)
    )
    score = (
        F.when(blank, 0).when(known, 90).when(b | fc, num)
        .when(sharp_word, 80).when(smooth_word, 20).otherwise(50)
    )
    return sharp, score


def compatibility_issues(slices, thickness, resolution, uniform=None, max_gap=None, gap_std=None) -> Column:
    """Array of issue texts, empty when the acquisition fits every criterion."""
    n, t, xy = col(slices), col(thickness), col(resolution)
    tests = []
    if uniform is not None:
        tests.append(
            F.when(~col(uniform), F.format_string("Non-uniform or missing slices (max gap: %.2fmm, std: %.2fmm)", dbl(max_gap), dbl(gap_std)))
        )
    tests += [
        F.when(n < MIN_SLICES, F.concat(F.lit("Too few slices: "), n.cast("string"), F.lit(f" < {MIN_SLICES}"))),
        F.when(t < THICKNESS_RANGE[0], F.lit("Slice too thin")).when(t > THICKNESS_RANGE[1], F.lit("Slice too thick")),
        F.when(xy < RESOLUTION_RANGE[0], F.lit("XY resolution too fine")).when(xy > RESOLUTION_RANGE[1], F.lit("XY resolution too coarse")),
    ]
    return F.array_compact(F.array(*tests))


def issue_reason(issue: Column | str) -> Column:
    """Reason category of an issue text; the first matching rule wins."""
    t = F.lower(col(issue))
    slice_ = t.contains("slice")
    return (
        F.when(slice_ & (t.contains("few") | t.contains("slices:")), "num_slices_out_of_range")
        .when(slice_ & (t.contains("thin") | t.contains("thick")), "slice_thickness_out_of_range")
        .when(t.contains("xy") | t.contains("resolution"), "xy_resolution_out_of_range")
        .when(t.contains("uniform") | t.contains("missing"), "non_uniform_slices")
        .otherwise("other")
    )


def label_name(code: Column | str, names: dict[int, str] = LABEL_NAMES, default: str = "") -> tuple[Column, Column]:
    """(code with negatives as background 0, its name)."""
    c = F.greatest(col(code), F.lit(0))
    name = F.lit(default)
    for k, v in names.items():
        name = F.when(c == k, v).otherwise(name)
    return c, name


def window_level(value: Column | str, center: float, width: float) -> Column:
    return clip(dbl(value), center - width / 2.0, center + width / 2.0)


def density_label(hu) -> Column:
    v = col(hu)
    return F.when(v > -700, "ELEVATED").when(v < -850, "LOW").when(v.isNotNull(), "NORMAL")


def entropy_label(e) -> Column:
    v = col(e)
    return F.when(v > 4.5, "HIGH").when(v < 3.5, "LOW").when(v.isNotNull(), "NORMAL")


def pc_label_report(r) -> Column:
    v = col(r)
    return F.when(v < 0.2, "LOW").when(v > 0.6, "HIGH").when(v.isNotNull(), "NORMAL")


def pc_label_console(r) -> Column:
    v = col(r)
    return (
        F.when(v < 0.15, "VERY LOW").when(v < 0.3, "LOW").when(v < 0.5, "BORDERLINE")
        .when(v > 1.0, "EXCELLENT").when(v.isNotNull(), "NORMAL")
    )


def tortuosity_label(t) -> Column:
    return F.when(col(t) > 1.5, "HIGH").when(col(t).isNotNull(), "NORMAL")


def symmetry_label(s) -> Column:
    v = col(s)
    return F.when(v < 0.5, "VERY ASYMMETRIC").when(v < 0.7, "ASYMMETRIC").when(v < 0.85, "MILD").when(v.isNotNull(), "SYMMETRIC")


def affected_side(left, right) -> Column:
    l, r = col(left), col(right)
    return F.when(l < r * 0.7, "left").when(r < l * 0.7, "right").when(l.isNotNull() & r.isNotNull(), "none")
