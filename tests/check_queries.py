"""Run registered queries beside their SQL and compare the rows: ``python tests/check_queries.py SF [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return float(repr(round(v, 9)))
        return v

    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def compare(spark, connection, name, function, sql, sf_dir):
    """None if both sides agree, else a text that says how they differ."""
    df = function(spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    if not ours:
        return "no rows"
    if sql is None:
        return None
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    theirs = rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    wanted = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for column, kind in df.dtypes:
        if wanted.get(kind, kind) != types[column] and types[column] not in ("NULL", '"NULL"'):
            return f"type of {column}: {kind} against {types[column]}"
    if ours == theirs:
        return None
    extra, missing = [r for r in ours if r not in set(theirs)], [r for r in theirs if r not in set(ours)]
    return f"{len(ours)} rows against {len(theirs)}; only ours {extra[:3]}; only theirs {missing[:3]}"


def main() -> int:
    import __spark_entry__ as entry
    from tests.sessions import local_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = local_session()
    connection = duck(sf_dir)
    failed = 0
    for name, function in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, connection, name, function, entry.oracle_sql().get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        took = time.time() - start
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {took:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
