"""Severity maps, score marks and readable numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels of the external linters and the severities they mean.
ANSIBLE_LINT_SEVERITY = {
    "very_high": "high", "high": "high", "medium": "medium", "low": "low", "very_low": "low", "info": "low",
}
YAMLLINT_SEVERITY = {"error": "high", "warning": "medium", "info": "low"}


def _severity(mapping: dict[str, str], level: Column) -> Column:
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(level)), F.lit("medium"))


def ansible_lint_severity(level: Column) -> Column:
    return _severity(ANSIBLE_LINT_SEVERITY, level)


def yamllint_severity(level: Column) -> Column:
    return _severity(YAMLLINT_SEVERITY, level)


def indicator(score: Column) -> Column:
    return F.when(score >= 90, "✅").when(score >= 70, "⚠️").otherwise("❌")


def one_decimal(value: Column) -> Column:
    """``%.1f`` with ties to even, as Python prints it (Java's own rounding is half-up)."""
    return F.format_string("%.1f", F.bround(value.cast("double"), 1))


def readable_size(size: Column) -> Column:
    """``0 B``, ``17.0 B``, ``1.5 KB`` ... up to TB."""
    unit = 1024.0
    names = ["B", "KB", "MB", "GB", "TB"]
    out = F.when(size == 0, F.lit("0 B"))
    for n, name in enumerate(names):
        shown = F.concat(one_decimal(size / F.lit(unit**n)), F.lit(f" {name}"))
        out = out.otherwise(shown) if n == len(names) - 1 else out.when(size < unit ** (n + 1), shown)
    return out
