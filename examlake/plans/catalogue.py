"""Name -> query and name -> oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dashboards, events, gates, ingest, ledger, regions, rules, scopes, scoring, statistics

MODULES: tuple = (dashboards, rules, statistics, scoring, events, ingest, gates, scopes, regions, ledger)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
