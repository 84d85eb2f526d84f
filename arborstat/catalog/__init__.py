"""Registered queries with their SQL counterparts, one module per operator family.

A query takes a :class:`Tables` (the driver's parquet tables seen through the
binding views) and returns a DataFrame. Its SQL names the views it needs; the
matching view texts are put in front of it.
"""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arborstat.functions.numeric import dbl
from arborstat.sources.bindings import Tables, view_sql


def r6(c) -> Column:
    """Six decimals for comparison; a nudge settles ties the same way in both engines."""
    return F.round(dbl(c) + 1e-9, 6)


def r2(c) -> Column:
    return F.round(dbl(c) + 1e-7, 2)


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "sources", "rules", "scoring", "joins", "aggregates", "voxels",
    "ordered", "graphs", "statistics", "comparison",
)


def query(name: str, views: str = "", sql: str | None = None, macros: str = ""):
    """Register ``fn(t: Tables)``; ``views`` lists the binding views ``sql`` reads."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return register


def with_views(views: str, body: str) -> str:
    """Prefix ``body`` with the CTEs of ``views``; body may go on with ', x as (...) select'.

    Six-decimal rounding gets the nudge of :func:`r6`, so that both engines fall on
    the same side of a tie.
    """
    ctes = view_sql(views.split())
    body = body.strip().replace(",6)", "+1e-9,6)").replace(",2)#", "+1e-7,2)")
    if not ctes:
        return "with recursive " + body[1:].strip() if body.startswith(",") else body
    return "with recursive " + ",\n".join(ctes) + ("\n" if not body.startswith(",") else "") + body


def load() -> None:
    for m in MODULES:
        if importlib.util.find_spec(f"arborstat.catalog.{m}") is None:
            continue
        importlib.import_module(f"arborstat.catalog.{m}")


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {k: (lambda spark, sf, fn=fn: fn(Tables(spark, sf))) for k, fn in QUERIES.items()}


def oracles() -> dict[str, str]:
    load()
    return dict(ORACLES)
