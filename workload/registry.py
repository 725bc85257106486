"""Registered queries: a Spark function, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_ctes(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip().rstrip(',')}\n{select.strip()}"


def query(name: str, sql: str | None = None):
    """Register a query under a name; without SQL it is checked by tests alone."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add
