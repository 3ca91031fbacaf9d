"""All registered queries of the engine, by name, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from watchwell.plans import alerts, detection, profiles, records, reporting, services

_MODULES = (alerts, detection, profiles, records, reporting, services)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.REGISTRY.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.REGISTRY.oracles.items()}
