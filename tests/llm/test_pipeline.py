"""Every stage beside brute force over its own input, and the whole run."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline
from codesieve.llm.tiling import tokens

from tests.llm.conftest import prose
from tests.llm.test_mixing_chat import fill
from tests.llm.test_pairs import brute_lines, brute_near, brute_tile, edited

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, awkward, table):
    """Awkward rows, near copies in other lines (so that line dedup leaves them), benchmark passages."""
    rng = random.Random(21)
    passages = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in awkward if r[0] != 30] + [(30, prose(2, 500), "lo", "c")]
    for g in range(30):
        text = prose(300 + g, rng.choice([25, 80, 300]))
        for k in range(rng.choice([1, 2, 4])):  # in lines of another length each
            words = (edited(rng, text, k) if k else text).split()
            wrapped = "\n".join(" ".join(words[i:i + 40 - 9 * k]) for i in range(0, len(words), 40 - 9 * k))
            rows.append((1000 + 10 * g + k, wrapped, "ka", f"s{g % 4}"))
    for g, passage in enumerate(passages[:6]):
        rows.append((2000 + g, prose(700 + g, 40) + "\n" + passage.replace("\n", " ") + " " + prose(800 + g, 20).replace("\n", " "), "lo", "s1"))
    return table(rows).cache()


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def same(found, wanted):
    assert sorted(map(str, found)) == sorted(map(str, wanted))


def test_stages(spark, corpus, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs, seen = corpus, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.columns[:len(corpus.columns)] == corpus.columns or n == 4
        out.write.parquet(str(tmp_path / str(n)))
        seen[n] = (docs, spark.read.parquet(str(tmp_path / str(n))))
        docs = seen[n][1]

    before, after = seen[0]  # 8
    same(rows_of(after), [r for r in rows_of(before) if r[1] and any(c.isalpha() for c in r[1])])

    before, after = seen[1]  # 4
    rows = rows_of(before)
    left = []
    for (doc_id, text), gone in zip(rows, brute_lines(rows), strict=True):
        text = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in set(gone))
        if re.search(r"\S", text):
            left.append((doc_id, text))
    same(rows_of(after), left)
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = seen[2]  # 5
    rows = rows_of(before)
    same(rows_of(after), set((d, t) for (d, t), (_, c) in zip(rows, brute_near(rows, 5, 80), strict=True) if c == d))
    assert after.count() < before.count()

    before, after = seen[3]  # 10
    passages = [tokens(r.text).tolist() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [
        (d, t) for d, t in rows_of(before)
        if all(sum(k for *_, k in brute_tile(tokens(t).tolist()[:150], p, 5)) < 0.5 * len(p) for p in (passages if (d or 0) >= 2000 else []))]
    same(rows_of(after), clean)
    assert not any(d and d >= 2000 for d, _ in rows_of(after))

    before, after = seen[4]  # 1
    rows, sizes = before.collect(), {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.encode().split())
    want, taken, largest = fill(sizes), dict.fromkeys(sizes, 0), {}
    for r in after.collect():
        taken[r.source] += len(r.text.encode().split())
        assert 1 <= int(r.copy) <= 3
    for r in rows:
        largest[r.source] = max(largest.get(r.source, 0), len(r.text.encode().split()))
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in sizes)


def test_stages_of_an_empty_table(spark, corpus):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, corpus.limit(0), SF).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    assert corpus_pipeline.ORACLE_SQL is None and out.count() > 100


def test_stages_keep_batches_small(spark):
    """What a caller writes of a stage, too, gets to Python in batches of bounded rows."""
    from codesieve.llm.common import ARROW_ROWS

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, docs = spark.conf.get(key), spark.range(1).selectExpr("id AS doc_id", "'ka lo' AS text", "'ka' AS lang", "'a' AS source", "5L AS n_chars")
    try:
        for stage in (corpus_pipeline.identified, corpus_pipeline.without_repeated_lines):
            for rows in ("10000", "0"):
                spark.conf.set(key, rows)
                stage(spark, docs, "")
                assert int(spark.conf.get(key)) == ARROW_ROWS
        spark.conf.set(key, "10")
        corpus_pipeline.identified(spark, docs, "")
        assert spark.conf.get(key) == "10"
    finally:
        spark.conf.set(key, before)
