"""Column helpers shared by every module. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: Column | str) -> Column:
    return col(c).cast("double")


def clean(c: Column | str) -> Column:
    """NaN becomes NULL, the only missing value used past ingestion."""
    return F.nanvl(dbl(c), F.lit(None).cast("double"))


def ratio(num: Column | str, den: Column | str) -> Column:
    """num/den as double, NULL when the denominator is zero or missing."""
    return F.try_divide(dbl(num), dbl(den))


def ratio_or_zero(num: Column | str, den: Column | str) -> Column:
    """num/den where den > 0, else 0."""
    return F.when(dbl(den) > 0, ratio(num, den)).otherwise(F.lit(0.0))


def clip(c: Column | str, lo, hi) -> Column:
    """c held inside [lo, hi]; NULL stays NULL, which least and greatest alone would lose."""
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi)))


def between(c: Column | str, lo: float, hi: float) -> Column:
    return (col(c) >= F.lit(lo)) & (col(c) <= F.lit(hi))


def sum_if(cond: Column, value: Column | str) -> Column:
    return F.sum(F.when(cond, dbl(value)))


def count_if(cond: Column) -> Column:
    """Rows where cond holds; NULL counts as not holding."""
    return F.count(F.when(cond, F.lit(1)))


def pearson(y: Column | str, x: Column | str, where: Column | None = None) -> Column:
    """Pearson r as an aggregate, NULL on groups without variance.

    Built from the regression moments because the built-in correlation raises on
    degenerate groups under ANSI mode.
    """
    y, x = dbl(y), dbl(x)
    if where is not None:
        y, x = F.when(where, y), F.when(where, x)
    return ratio(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))


def slope(y: Column | str, x: Column | str) -> Column:
    y, x = dbl(y), dbl(x)
    return ratio(F.regr_sxy(y, x), F.regr_sxx(y, x))


def intercept(y: Column | str, x: Column | str) -> Column:
    y, x = dbl(y), dbl(x)
    return F.regr_avgy(y, x) - slope(y, x) * F.regr_avgx(y, x)
