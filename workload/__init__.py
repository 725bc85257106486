"""Check and bench workload: a code corpus derived from the given tables, queries on it, SQL that checks them."""

from workload import scan_queries, table_queries  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
