from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesieve.llm.mining import LEAST, MOST, Cells, codebook, hard_negatives, next_cells

SCHEMA = "vec_id bigint, label int, v array<bigint>, score int, cell string, block int, row string"


def brute(rows, anchor, positives=5, negatives=5, lower=80, upper=100):
    rows = [r for r in rows if None not in r]
    out = []
    for a_id, a_label, a in {(i, lab, tuple(v)) for i, lab, v in rows if anchor(i)}:
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i, lab) for i, lab, v in rows if i != a_id and len(v) == len(a))
        for s, p_id, _ in [x for x in scored if x[2] == a_label][:positives]:
            inside = [x for x in scored if x[2] != a_label and lower * -s <= 100 * -x[0] <= upper * -s][:negatives]
            out += [(a_id, p_id, rank + 1, n_id, -s, -n) for rank, (n, n_id, _) in enumerate(inside)]
    return sorted(out)


def ours(spark, rows, anchor, **parameters):
    df = spark.createDataFrame([(*r, 1, "c", 2, "r") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard_negatives(df, anchor, **parameters).collect())


def clustered(seed, n, dims=8, centres=12, spread=6, scale=300):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    middle *= scale / np.linalg.norm(middle, axis=1)[:, None]
    vectors = np.floor(middle[rng.integers(0, centres, n)] + rng.normal(scale=spread, size=(n, dims))).astype(int)
    return [(i, int(lab), v.tolist()) for i, (lab, v) in enumerate(zip(rng.integers(0, 4, n), vectors, strict=True))]


@pytest.mark.parametrize("index", [{}, {"codewords": 3, "block": 40, "sample": 50}])
def test_against_brute_force(spark, index):
    rows = clustered(1, 900)
    assert ours(spark, rows, F.col("vec_id") % 50 == 0, **index) == brute(rows, lambda i: i % 50 == 0)


def test_rounds_and_groups_of_questions(spark, monkeypatch):
    from codesieve.llm.mining import MultiIndex

    search = MultiIndex.search
    monkeypatch.setattr(MultiIndex, "search", lambda self, asked, k, same: search(self, asked, k, same, rows=20, growth=3, ask_block=4))
    rows = clustered(2, 400, spread=80)
    assert ours(spark, rows, F.col("vec_id") % 40 == 0, block=64) == brute(rows, lambda i: i % 40 == 0)


def test_awkward_rows(spark):
    rows = clustered(3, 120, dims=4)
    rows += [(None, 1, [1, 2, 3, 4]), (500, None, [1, 2, 3, 4]), (600, 1, None)]  # take no part
    rows += [(700 + i, i % 3, [7, 7, 7, 7]) for i in range(200)]  # a hot vector, all scores tie
    rows += [(0, 2, [7, 7, 7, 7]), (0, 2, [7, 7, 7, 7]), (0, 3, [-7, 7, 1, 0])]  # an id and a row that repeat
    rows += [(1000 + i, i % 2, [i, 1]) for i in range(8)] + [(1100, 0, []), (1101, 1, []), (1102, 0, []), (1200, 1, [3]), (1201, 1, [2]), (1203, 0, [2])]  # other lengths
    rows += [(1300, 0, [0, 0, 0, 0]), (1400, 1, [-300, -300, -300, -300])]
    anchor = lambda i: i % 100 == 0
    assert ours(spark, rows, F.col("vec_id") % 100 == 0, block=50, codewords=4) == brute(rows, anchor)
    assert ours(spark, rows, F.col("vec_id") % 100 == 0, sample=30, positives=3, negatives=2, lower=50, upper=120) == brute(rows, anchor, 3, 2, 50, 120)


def test_nothing_to_find(spark):
    assert ours(spark, [], F.col("vec_id") == 0) == []
    assert ours(spark, [(1, 0, [1]), (2, 1, [1])], F.col("vec_id") == 7) == []
    assert ours(spark, [(0, 0, [1]), (2, 1, [1])], F.col("vec_id") == 0) == []  # no positive


def test_long_components_are_not_rounded(spark):
    big = 2**30 + 1
    rows = [(0, 0, [big, 1]), (1, 0, [big, 3]), (2, 1, [big, 2]), (3, 1, [big, 3]), (4, 1, [big - 1, 4])]
    assert ours(spark, rows, F.col("vec_id") == 0) == brute(rows, lambda i: i == 0)


def cells_of(vectors, codewords=16):
    halves = np.split(vectors.astype(float), 2, axis=1)
    cells = Cells(0, tuple(codebook(h, codewords) for h in halves))
    own, *far = cells.of(vectors)
    cells.rows = np.bincount(own, minlength=cells.size)
    for i in range(2):
        np.maximum.at(cells.radii[i], own, far[i])
    return cells, own


def test_cells_come_in_order_of_bounds_that_hold():
    vectors = np.array([v for _, _, v in clustered(4, 500)])
    cells, own = cells_of(vectors)
    for q in vectors[:20]:
        visits = list(cells.visits(q))
        assert sorted(c for _, c, _, _ in visits) == list(range(cells.size))
        sums = [s for s, _, _, _ in visits]
        assert all(a >= b for a, b in zip(sums, sums[1:], strict=False))
        scores = vectors @ q
        for bound, cell, upper, lower in visits:
            inside = scores[own == cell]
            assert bound >= upper - 1e-6
            assert not len(inside) or lower <= inside.min() and inside.max() <= upper


def test_the_bounds_rule_cells_out_and_certify():
    vectors = np.array([v for _, _, v in clustered(5, 2000)])
    cells, own = cells_of(vectors)
    asked = 0
    for q in vectors[:50]:
        kth = int(np.sort(vectors @ q)[-6])
        found, _, certified = next_cells(cells, q, 0, 10**9, [(kth, MOST)])
        assert certified and set(own[vectors @ q >= kth]) <= set(found)
        asked += cells.rows[found].sum()
        low, high = int(0.8 * kth), kth - 1
        inside = set(own[(vectors @ q >= low) & (vectors @ q <= high)])
        assert inside <= set(next_cells(cells, q, 0, 10**9, [(low, high)])[0])
        assert next_cells(cells, q, 0, 10**9, [(1, 0)]) == ([], 0, True)
    assert asked < 0.3 * 50 * len(vectors)
    assert LEAST == -MOST - 1
