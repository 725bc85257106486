"""Pages of long lists, against plain Python."""

from __future__ import annotations

import random

from codesieve.operators.paging import paged


def test_pages(spark, tmp_path):
    rng = random.Random(6)
    rows = [("hot", None, f"v{rng.randint(0, 3000):05}") for _ in range(5000)] + [(f"g{i % 7}", i % 2, f"v{i}") for i in range(90)]
    rows += [("one", 1, "x"), (None, 1, "b"), (None, 1, "a"), ("null", 0, None), ("null", 0, "a"), ("equal", 0, "e")] + [("equal", 0, "e")] * 24
    df = spark.createDataFrame(rows, "name string, kind int, value string").repartition(5)
    found = {(r.name, r.kind, r.page): (r.first, r["values"], r.n) for r in paged(df, ["name", "kind"], "value", 10, str(tmp_path)).collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        own = sorted((r[2] for r in rows if r[:2] == key), key=lambda v: (v is not None, v or ""))
        want |= {(*key, at // 10 + 1): (at + 1, own[at:at + 10], len(own[at:at + 10])) for at in range(0, len(own), 10)}
    assert found == want
    assert paged(df.limit(0), ["name"], "value", 10, str(tmp_path)).collect() == []
