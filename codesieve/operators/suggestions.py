"""Improvement suggestions per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.text import sql_string

# Type, priority, description and category of each suggestion.
USE_ENVIRONMENT = ("security", "high", "Use environment variables or secure configuration files for secrets", "best_practices")
SPLIT_FUNCTIONS = ("refactoring", "medium",
                   "Consider breaking down complex functions into smaller, more manageable pieces", "maintainability")
MODERN_VARIABLES = ("modernization", "medium",
                    "Replace var with let/const for better scoping and immutability", "modern_syntax")
COMPLEX_ABOVE = 15


def _when(test: str, values) -> str:
    fields = ", ".join(
        f"'{name}', {sql_string(value)}" for name, value in zip(("type", "priority", "description", "category"), values))
    return f"CASE WHEN {test} THEN named_struct({fields}) END"


def suggestions() -> Column:
    """Array of suggestions of one file, from its ``issues``, ``cyclomatic_complexity`` and ``language``."""
    arms = ", ".join([
        _when("exists(issues, i -> i.type IN ('hardcoded_password', 'hardcoded_api_key'))", USE_ENVIRONMENT),
        _when(f"cyclomatic_complexity > {COMPLEX_ABOVE}", SPLIT_FUNCTIONS),
        _when("language IN ('javascript', 'typescript') AND exists(issues, i -> i.type = 'var_usage')", MODERN_VARIABLES),
    ])
    return F.expr(f"array_compact(array({arms}))")


def with_suggestions(results: DataFrame) -> DataFrame:
    return results.withColumn("suggestions", suggestions())


def suggestion_rows(results: DataFrame, type: str | None = None, priority: str | None = None) -> DataFrame:
    """One row per suggestion; ``order`` is its place in the file."""
    # outer, for the same reason as in scan.issues
    out = (
        results.select("repo", "path", F.posexplode_outer("suggestions").alias("order", "s"))
        .filter(F.col("s").isNotNull()).select("repo", "path", "order", "s.*")
    )
    if type is not None:
        out = out.filter(F.col("type") == type)
    if priority is not None:
        out = out.filter(F.col("priority") == priority)
    return out
