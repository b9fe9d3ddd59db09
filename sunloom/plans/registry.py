"""Registered queries: name -> Spark plan, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.plans.views import with_views

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, uses: tuple[str, ...] = (), name: str | None = None):
    """Register a plan under its function name; `uses` lists the domain tables of the SQL."""
    def keep(plan: Plan) -> Plan:
        key = name or plan.__name__
        if key in PLANS:
            raise ValueError(f"query {key} is registered twice")
        PLANS[key] = plan
        if sql is not None:
            ORACLES[key] = with_views(uses, sql)
        return plan
    return keep


def r(value: Column | str, places: int = 4) -> Column:
    """Rounding both engines compute with the same floating-point steps; the twin of `views.r`."""
    value = F.col(value) if isinstance(value, str) else value
    scale = F.lit(float(10 ** places))
    return F.floor(value * scale + F.lit(0.4871)).cast("double") / scale


def rounded(*names: str, places: int = 4) -> list[Column]:
    return [r(n, places).alias(n) for n in names]
