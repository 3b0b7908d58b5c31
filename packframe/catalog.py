"""The library's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packframe.plans import adaptive, formulas, packing, scores, spans

PLANS = (packing, formulas, spans, scores, adaptive)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for plan in PLANS for name, run in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.SQL.items()}
