"""Registry of the queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from metaloom.plans import discovery, extraction, fusion, graphs, scalars, validation

_PLANS = [fusion, scalars, validation, discovery, graphs, extraction]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
