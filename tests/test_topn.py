"""Lists beside a rollup, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codesieve.operators.topn import grouped_with_lists
from codesieve.plans import digests, reports
from codesieve.plans.review import review


@pytest.mark.parametrize("salts", [1, 7])
def test_lists_beside_aggregates(spark, salts):
    rng = random.Random(4)
    # one repository has most files, one has no item at all, one only null numbers
    files = [("hot", f"d/{rng.randint(0, 99):03}/{i}", i, [rng.randint(0, 9) for _ in range(rng.randint(0, 6))]) for i in range(400)]
    files += [(f"r{i % 9}", f"f{i}", i, [i, i]) for i in range(40)] + [("empty", "a", 1, []), ("empty", "b", 2, None), ("none", "a", None, [3])]
    df = spark.createDataFrame(files, "repo string, path string, number int, items array<int>").repartition(6)
    n = 5
    lists = {
        "low": F.slice(F.array_sort(F.filter("items", lambda x: x < 5)), 1, n),
        "high": F.slice(F.array_sort(F.filter("items", lambda x: x >= 5)), 1, n)}
    lists = {name: F.coalesce(c, F.array().cast("array<int>")) for name, c in lists.items()}
    out = grouped_with_lists(df, [F.lit(1).alias("file"), F.col("number")], [F.count("file").alias("files"), F.sum("number").alias("total")], lists, n, salts)
    found = {r.repo: (r.files, r.total, [tuple(x) for x in r.low], [tuple(x) for x in r.high]) for r in out.collect()}

    def expected(repo):
        own = [f for f in files if f[0] == repo]
        numbers = [f[2] for f in own if f[2] is not None]
        items = sorted((f[1], x) for f in own for x in f[3] or [])
        return len(own), sum(numbers) if numbers else None, [x for x in items if x[1] < 5][:n], [x for x in items if x[1] >= 5][:n]

    assert found == {repo: expected(repo) for repo in {f[0] for f in files}}
    assert grouped_with_lists(df.limit(0), [F.lit(1).alias("file")], [F.count("file").alias("files")], {"items": F.col("items")}, n).collect() == []


def parser_stages(df) -> int:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("EvalPython")


@pytest.mark.parametrize("digest", [
    digests.review_digest, digests.improvement_digest, reports.analysis_report, lambda r: reports.category_sections(r, 3)])
def test_a_digest_parses_each_file_once(spark, corpus_of, digest):
    results = review(corpus_of({"a.py": "eval(x)\n", "b.js": "var a = 1\n"}))
    assert parser_stages(digest(results)) == parser_stages(results) > 0
