"""Correlation, leave-one-out regression, error metrics and agreement.

Everything is reduced to per-(feature, target) moments first. Feature and target
lists are fixed, so moments are a handful of rows that are broadcast back for the
per-row step; no group of rows is ever refitted or collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from arborstat.functions.numeric import count_if, dbl, intercept, pearson, ratio, slope
from arborstat.operators.comparison import unpivot_metrics
from arborstat.plans.selection import running_totals
from arborstat.session import cut_lineage, spread


def long_pairs(df: DataFrame, key: str, features: list[str], targets: list[str]) -> DataFrame:
    """(key, feature, target, x, y) rows with both values present."""
    rows = [F.struct(F.lit(f).alias("feature"), F.lit(t).alias("target"), dbl(f).alias("x"), dbl(t).alias("y")) for f in features for t in targets]
    return df.select(key, F.inline(F.array(*rows))).where("x is not null and y is not null")


def pair_correlations(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """Pearson r, n, slope and intercept for every (feature, target) in one pass over ``df``.

    All moments are aggregates of the wide rows; only the single result row is unpivoted.
    """
    aggs, rows = [], []
    for i, f in enumerate(features):
        for j, t in enumerate(targets):
            k = f"{i}_{j}"
            aggs += [
                pearson(t, f).alias(f"r_{k}"), F.regr_count(dbl(t), dbl(f)).alias(f"n_{k}"),
                slope(t, f).alias(f"s_{k}"), intercept(t, f).alias(f"i_{k}"),
            ]
            rows.append(F.struct(
                F.lit(f).alias("feature"), F.lit(t).alias("target"), F.col(f"n_{k}").alias("n"), F.col(f"r_{k}").alias("pearson_r"),
                F.col(f"s_{k}").alias("slope"), F.col(f"i_{k}").alias("intercept"),
            ))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def with_average_ranks(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Add the average ranks (ties share their mean) of ``columns`` (name to name of the rank) within ``keys``.

    Rows are folded to distinct values with counts first, all columns together; the ranks
    are running totals of those, and rows meet them by value. A key with most of the rows
    is spread over all tasks. Rows with a null key or value are left out.

    ``df`` is written once: a mean computed twice may differ in its last bit, and its row
    would then meet no rank.
    """
    names, df = list(columns), cut_lineage(df)
    long = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("__c"), dbl(c).alias("__v")) for i, c in enumerate(names)]))).where("__v is not null")
    folded = long.groupBy(*keys, "__c", "__v").agg(F.count("*").alias("__n"))
    before = running_totals(folded, [*keys, "__c", "__v"], "__n", "__before")
    start = before.groupBy(*keys, "__c").agg(F.min("__before").alias("__start"))
    ranks = before.join(start, [*keys, "__c"]).withColumn("__rank", F.col("__before") - F.col("__start") + (F.col("__n") + 1) / 2.0)
    out = df
    for i, (c, name) in enumerate(columns.items()):
        of = ranks.where(F.col("__c") == i).select(*keys, F.col("__v").alias(f"__v{i}"), F.col("__rank").alias(name))
        out = out.withColumn(f"__v{i}", dbl(c)).join(spread(of), [*keys, f"__v{i}"]).drop(f"__v{i}")
    return out


def spearman(df: DataFrame, key: str, features: list[str], targets: list[str]) -> DataFrame:
    pairs = long_pairs(df, key, features, targets)
    ranked = with_average_ranks(pairs, ["feature", "target"], {"x": "rx", "y": "ry"})
    return ranked.groupBy("feature", "target").agg(F.count("*").alias("n"), pearson("ry", "rx").alias("spearman_rho"))


def with_p_values(df: DataFrame, r: str, n: str, name: str = "p_value") -> DataFrame:
    """Two-sided p of a correlation from Student's t with n-2 degrees of freedom.

    ``df`` is a table of results (one row per pair), so this is never on a data path.
    """
    @F.pandas_udf("double")
    def p(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return correlation_p(rs, ns)

    return df.withColumn(name, p(dbl(r), dbl(n)))


def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """I_{df/(df+t^2)}(df/2, 1/2), where df/(df+t^2) = 1 - r^2."""
    dof = n.to_numpy(float) - 2
    x = 1.0 - np.clip(np.abs(r.to_numpy(float)), 0, 1) ** 2
    out = np.array([_beta_inc(d / 2.0, 0.5, v) if d > 0 and np.isfinite(v) else np.nan for d, v in zip(dof, x)])
    return pd.Series(out).where(np.isfinite(out), None).astype("float64")


def _beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    from math import exp, lgamma, log, log1p

    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_inc(b, a, 1.0 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * h


def sensitivity(df: DataFrame, flag: str, features: list[str], target: str, at_least: int = 10) -> DataFrame:
    """r on all, original and processed rows (more than ``at_least`` each) and the shift against original."""
    subsets = {"all": F.lit(True), "original": ~F.col(flag), "smoothed": F.col(flag)}
    aggs, rows = [], []
    for i, f in enumerate(features):
        both = dbl(f).isNotNull() & dbl(target).isNotNull()
        for s, cond in subsets.items():
            aggs += [pearson(target, f, cond).alias(f"r_{s}_{i}"), count_if(cond & both).alias(f"n_{s}_{i}")]
        rows.append(F.struct(
            F.lit(f).alias("metric"),
            *[F.when(F.col(f"n_{s}_{i}") > at_least, F.col(f"r_{s}_{i}")).alias(f"r_{s}") for s in subsets],
            *[F.col(f"n_{s}_{i}").alias(f"n_{s}") for s in subsets],
        ))
    out = df.agg(*aggs).select(F.inline(F.array(*rows)))
    return out.withColumn("delta_r", F.abs(F.col("r_all") - F.col("r_original")))


def sensitivity_class(rows: DataFrame) -> DataFrame:
    m = rows.agg(F.max("delta_r").alias("max_delta"), F.avg("delta_r").alias("mean_delta"))
    return m.withColumn("impact", F.when(F.col("max_delta") < 0.1, "minimal").when(F.col("max_delta") < 0.2, "moderate").when(F.col("max_delta").isNotNull(), "strong"))


def compare_metric_types(corr: DataFrame, types: dict[str, str]) -> DataFrame:
    """Per metric type: count, mean and max |r|, significant results, best metric (the last by name on ties), rank by mean |r|."""
    kind = F.lit(None).cast("string")
    for metric, t in types.items():
        kind = F.when(F.col("feature") == metric, t).otherwise(kind)
    a = F.abs("pearson_r")
    g = corr.withColumn("type", kind).groupBy("type").agg(
        F.count("*").alias("n_metrics"), F.avg(a).alias("mean_abs_r"), F.max(a).alias("max_abs_r"),
        count_if(F.col("p_value") < 0.05).alias("n_significant"), F.max_by("feature", F.struct(a.alias("a"), "feature")).alias("best_metric"),
    )
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_r"), "type")))  # one row per type


def quartile_correlation(summary: DataFrame) -> DataFrame:
    """Correlation of baseline mean and mean decline over the quartiles with its p, given all four."""
    r = summary.agg(F.count("*").alias("n"), pearson("mean_decline", "baseline_mean").alias("r")).where("n >= 4")
    return with_p_values(r, "r", "n")


# --- leave-one-out ----------------------------------------------------------------

MODELS = {"linear": 1, "poly2": 2, "poly3": 3}
FLAT = 1e-10  # relative norm below which a power of x adds nothing to the lower ones


def leave_one_out(pairs: DataFrame, models: list[str] | None = None, at_least: int = 10) -> DataFrame:
    """Leave-one-out prediction of every row by linear and polynomial regression.

    With the hat value h of a row and its residual e under the full fit, the
    prediction without that row is y - e/(1-h), so nothing is refitted. Fits are
    written in polynomials orthogonal over the standardised feature; their
    coefficients follow from the power sums of one pass, a row per (feature, target),
    and the fits of degree 1 to 3 are partial sums of each other.
    """
    keys = ["feature", "target"]
    scale = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    scale = scale.where((F.col("n") >= at_least) & (F.col("sd") > 0))
    z = pairs.join(F.broadcast(scale), keys).withColumn("z", (F.col("x") - F.col("mean")) / F.col("sd"))  # a row per pair
    powers = {0: "1D", 1: "z", 2: "z*z", 3: "z*z*z", 4: "z*z*z*z", 5: "z*z*z*z*z", 6: "z*z*z*z*z*z"}
    m = z.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("sd").alias("sd"),
        *[F.expr(f"sum({powers[i]})").alias(f"m{i}") for i in (3, 4, 5, 6)], *[F.expr(f"sum(y*{powers[i]})").alias(f"t{i}") for i in range(4)],
    )
    # p1 = z, p2 = z^2 - a1 z - 1, p3 = (z - a2) p2 - b2 z; q = squared norms, w = products with y.
    m = m.withColumn("a1", F.expr("m3 / n")).withColumn("q2", F.expr("m4 - a1*m3 - n"))
    m = m.withColumns({
        "a2": F.expr("try_divide(m5 - 2*a1*m4 + (a1*a1 - 2)*m3 + 2*a1*n, q2)"), "b2": F.expr("q2 / n"), "w2": F.expr("t2 - a1*t1 - t0"),
    })
    m = m.withColumns({
        "q3": F.expr("m6 - (a1 + a2)*m5 + (a1*a2 - 1 - b2)*m4 + a2*m3"), "w3": F.expr("t3 - (a1 + a2)*t2 + (a1*a2 - 1 - b2)*t1 + a2*t0"),
    }).select(*keys, "n", "mean", "sd", "a1", "a2", "b2", "q2", "q3", "t0", "t1", "w2", "w3")
    j = pairs.join(F.broadcast(m), keys).withColumn("z", (F.col("x") - F.col("mean")) / F.col("sd"))
    j = j.withColumn("p2", F.expr("z*z - a1*z - 1")).withColumn("p3", F.expr("(z - a2)*p2 - b2*z"))
    j = j.withColumns({"fit1": F.expr("t0/n + t1/n*z"), "hat1": F.expr("1D/n + z*z/n")})
    j = j.withColumns({
        "fit2": F.expr(f"if(q2 > {FLAT}*n, fit1 + w2/q2*p2, null)"), "hat2": F.expr(f"if(q2 > {FLAT}*n, hat1 + p2*p2/q2, null)"),
    })
    j = j.withColumns({
        "fit3": F.expr(f"if(q3 > {FLAT}*n, fit2 + w3/q3*p3, null)"), "hat3": F.expr(f"if(q3 > {FLAT}*n, hat2 + p3*p3/q3, null)"),
    })
    rows = [
        F.struct(F.lit(k).alias("model"), F.expr(f"y - try_divide(y - fit{d}, 1 - hat{d})").alias("predicted"))
        for k, d in MODELS.items() if not models or k in models
    ]
    own = [c for c in pairs.columns if c not in ("feature", "target", "x", "y")]
    return j.select(*own, *keys, "n", "x", F.col("y").alias("actual"), F.inline(F.array(*rows))).where("predicted is not null")


def leave_one_out_linear(pairs: DataFrame, at_least: int = 10) -> DataFrame:
    """The linear case with closed-form moments; no Python at all."""
    keys = ["feature", "target"]
    m = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy")
    ).where((F.col("n") >= at_least) & (F.col("sxx") > 0))
    j = pairs.join(F.broadcast(m), keys)  # a row per (feature, target)
    dx = F.col("x") - F.col("mx")
    e = F.col("y") - F.col("my") - F.col("sxy") / F.col("sxx") * dx
    h = F.lit(1.0) / F.col("n") + dx * dx / F.col("sxx")
    return j.select(
        *[c for c in pairs.columns if c not in ("feature", "target", "x", "y")], "feature", "target", F.lit("linear").alias("model"), "n", "x",
        F.col("y").alias("actual"), (F.col("y") - ratio(e, 1 - h)).alias("predicted"),
    ).where("predicted is not null")


def error_metrics(pred: DataFrame, keys: list[str], percent_targets: list[str] = ()) -> DataFrame:
    """MSE, MAE, RMSE, R2, percentage error and r of predicted against actual.

    The percentage error skips zero actuals; targets not in ``percent_targets``
    report the mean absolute error there.
    """
    e = F.col("predicted") - F.col("actual")
    pct = F.when(F.col("target").isin(list(percent_targets)), F.try_divide(F.abs(e), F.col("actual")) * 100).otherwise(F.abs(e))
    return pred.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - ratio(F.sum(e * e), F.regr_syy("actual", "predicted"))).alias("r2"),
        F.avg(pct).alias("mape"), pearson("predicted", "actual").alias("pearson_r"),
    )


def with_rank_correlation(metrics: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """``metrics`` with the p of r, and Spearman's rho of predicted and actual with its p. ``pred`` is read three times: best a written table."""
    ranked = with_average_ranks(pred.select(*keys, "predicted", "actual"), keys, {"predicted": "rx", "actual": "ry"})
    rho = ranked.groupBy(*keys).agg(pearson("ry", "rx").alias("spearman_rho"))
    both = with_p_values(metrics.join(rho, keys), "pearson_r", "n", "pearson_p")
    return with_p_values(both, "spearman_rho", "n", "spearman_p")


def best_models(metrics: DataFrame) -> DataFrame:
    """Best R2 per (feature, target); on ties the simpler model."""
    order = F.when(F.col("model") == "linear", 1).when(F.col("model") == "poly2", 2).otherwise(3)
    others = [c for c in metrics.columns if c not in ("feature", "target")]
    return metrics.where("r2 is not null").groupBy("feature", "target").agg(
        F.min_by(F.struct(*others), F.struct(-F.col("r2"), order)).alias("b")
    ).select("feature", "target", "b.*")


def summary_table(metrics: DataFrame) -> DataFrame:
    """All models and the best per pair, marked, by target and falling R2."""
    return (
        metrics.withColumn("kind", F.lit("all")).unionByName(best_models(metrics).withColumn("kind", F.lit("best")))
        .orderBy("target", F.desc("r2"), "feature", "model")
    )


def feature_ranking(metrics: DataFrame, k: int = 5) -> DataFrame:
    """Features by mean R2, the first ``k``."""
    return metrics.groupBy("feature").agg(F.avg("r2").alias("mean_r2")).orderBy(F.desc("mean_r2"), "feature").limit(k)


def bland_altman(df: DataFrame, a: str, b: str, keys: list[str] = ()) -> DataFrame:
    """Bias, deviation (population) and 95% limits of agreement of a - b."""
    d = dbl(a) - dbl(b)
    s = df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("bias"), F.stddev_pop(d).alias("sd"))
    return s.withColumns({"lower": F.col("bias") - 1.96 * F.col("sd"), "upper": F.col("bias") + 1.96 * F.col("sd")})


def agreement_points(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumns({"mean": (dbl(a) + dbl(b)) / 2, "difference": dbl(a) - dbl(b)})


def quality_filter(targets: DataFrame, columns: list[str], allowed=("high", "medium")) -> DataFrame:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isin(*allowed)
    return targets.where(cond)


def cohort_statistics(df: DataFrame, columns: list[str], drop: str, limit: float = 5.0) -> DataFrame:
    """Mean and sample deviation per column, and the share and mean drop of progressors."""
    hit = F.col(drop) > limit
    aggs: list[Column] = [F.count("*").alias("n")]
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    aggs += [count_if(hit).alias("n_progressed"), F.avg(F.when(hit, F.col(drop))).alias("progressed_mean_drop")]
    return df.agg(*aggs).withColumn("progressed_share", ratio("n_progressed", "n") * 100)


def error_histogram(df: DataFrame, error: str, keys: list[str], bins: int = 20) -> DataFrame:
    """Equal bins between the smallest and the largest error per key; the top edge belongs to the last."""
    e = df.select(*keys, dbl(error).alias("e")).where("e is not null")
    span = e.groupBy(*keys).agg(F.min("e").alias("lo"), F.max("e").alias("hi"))
    pos = ratio(F.col("e") - F.col("lo"), F.col("hi") - F.col("lo")) * bins
    bin_ = F.least(F.coalesce(F.floor(pos), F.lit(bins // 2)), F.lit(bins - 1)).cast("int")
    return e.join(span, keys).groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))
