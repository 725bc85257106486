"""What is written and read again: configurations, result tables, and texts with invalid bytes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from codesieve.functions.text import decode_text
from codesieve.operators import catalog
from codesieve.operators.rollups import repository_rollup
from codesieve.plans.review import review
from codesieve.sources import repo_config
from codesieve.sources.repo_config import ChangedMeanwhileError, ConfigStore
from codesieve.sources.results import read_results, replace_file_results, replace_results
from codesieve.streaming.incremental import file_stream, rollup_stream


def configs(spark, *rows):
    return repo_config.with_defaults(spark.createDataFrame(
        [("o", name, f"o/{name}", "Python", "main", enabled, {"n": n}, None) for name, enabled, n in rows], repo_config.REPO_CONFIG))


def state(df):
    return sorted((r.full_name, r.enabled, r.analysis_config["n"]) for r in df.collect())


def test_configurations_are_saved_where_they_were_loaded(spark, tmp_path):
    store = ConfigStore(spark, str(tmp_path / "store"))
    assert store.version() == 0 and store.history().count() == 0
    assert store.save(configs(spark, ("a", True, "1"), ("b", True, "1"))) == 1
    for n in ("2", "3"):
        updates = spark.createDataFrame([("o/b", {"n": n}, n == "2")], "full_name string, settings map<string,string>, enabled boolean")
        version = store.version()
        assert store.save(catalog.override_configs(store.load(), updates), based_on=version) == version + 1
    assert state(store.load()) == [("o/a", True, "1"), ("o/b", False, "3")]
    assert state(store.load(1)) == [("o/a", True, "1"), ("o/b", True, "1")]
    assert [r.repositories for r in store.history().orderBy("version").collect()] == [2, 2, 2]
    with pytest.raises(ChangedMeanwhileError):
        store.save(configs(spark, ("c", True, "9")), based_on=2)
    with pytest.raises(ValueError):
        store.load(7)
    assert store.version() == 3
    repo_config.save(repo_config.load(spark, store.path).limit(0), store.path)
    assert state(store.load()) == []


def test_a_save_that_breaks_off_changes_nothing(spark, tmp_path):
    store = ConfigStore(spark, str(tmp_path))
    store.save(configs(spark, ("a", True, "1")))
    broken = store.load().withColumn("language", F.when(F.col("name") == "a", F.raise_error(F.lit("broken"))).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.save(broken)
    # a snapshot without its commit
    configs(spark, ("z", True, "0")).withColumn("last_analyzed", F.lit(None).cast("string")).write.json(f"{store.path}/snapshots/2-half")
    assert state(store.load()) == [("o/a", True, "1")] and store.version() == 1
    assert store.save(configs(spark, ("b", True, "2"))) == 2 and state(store.load()) == [("o/b", True, "2")]


def test_of_two_savers_one_counts(spark, tmp_path, monkeypatch):
    store = ConfigStore(spark, str(tmp_path))
    store.save(configs(spark, ("a", True, "1")))
    first, version = ConfigStore(spark, store.path), store.version
    # the other one saves between this one's look at the version and its commit
    monkeypatch.setattr(store, "version", lambda: (version(), first.save(configs(spark, ("first", True, "1"))))[0])
    with pytest.raises(ChangedMeanwhileError):
        store.save(configs(spark, ("second", True, "1")))
    monkeypatch.undo()
    assert state(store.load()) == [("o/first", True, "1")]


def test_plain_records_are_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"full_name": "o/a", "owner": "o", "name": "a", "analysis_config": {"n": "5"}}\n')
    assert state(repo_config.load(spark, str(tmp_path))) == [("o/a", True, "5")]


def rows_of(df):
    return sorted((r.repo, r.path, r.n) for r in df.collect())


def test_a_rescan_replaces_its_repositories(spark, tmp_path):
    path = str(tmp_path / "results")
    table = lambda *rows: spark.createDataFrame(list(rows), "repo string, path string, n int")
    assert read_results(spark, path) is None
    replace_results(table().limit(0), path, buckets=8)
    assert read_results(spark, path) is None
    first = [(f"r{i}", f"p{j}", 1) for i in range(40) for j in range(3)]
    replace_results(table(*first, (None, "x", 1)), path, buckets=8)
    assert rows_of(read_results(spark, path)) == sorted(first)
    again = [("r3", "p0", 2), ("r3", "new", 2), ("fresh", "p", 2)]
    for _ in range(2):  # the second time changes nothing
        replace_results(table(*again), path, buckets=8)
        assert rows_of(read_results(spark, path)) == sorted([r for r in first if r[0] != "r3"] + again)
    replace_results(table(("r5", "p1", 3)), path, keys=("repo", "path"), buckets=8)
    now = sorted([r for r in first if r[0] != "r3" and r[:2] != ("r5", "p1")] + again + [("r5", "p1", 3)])
    assert rows_of(read_results(spark, path)) == now
    replace_results(table().limit(0), path, gone=spark.createDataFrame([("r5",), ("never",)], "repo string"), buckets=8)
    assert rows_of(read_results(spark, path)) == [r for r in now if r[0] != "r5"]
    replace_results(table().limit(0), path, gone=read_results(spark, path).select("repo"), buckets=8)
    assert rows_of(read_results(spark, path)) == []


def test_untouched_buckets_are_not_written(spark, tmp_path):
    path = tmp_path / "results"
    rows = spark.createDataFrame([(f"r{i}", "p", 1) for i in range(50)], "repo string, path string, n int")
    replace_results(rows, str(path), buckets=16)
    before = {p.parent.name: p.name for p in path.rglob("*.parquet")}
    replace_results(rows.filter("repo = 'r7'"), str(path), buckets=16)
    after = {p.parent.name: p.name for p in path.rglob("*.parquet")}
    assert before.keys() == after.keys() and sum(before[b] != after[b] for b in before) == 1


def test_file_results_and_a_stream_of_changes(spark, corpus_of, tmp_path):
    one, two = corpus_of({"a.py": "eval(x)\n", "b.py": "x = 1\n"}, "one"), corpus_of({"a.js": "var a = 1\n"}, "two")
    path = str(tmp_path / "nested")
    replace_file_results(review(one.union(two)), path)
    replace_file_results(review(corpus_of({"a.py": "y = 2\n"}, "one")), path)
    nested = {(r.repo, r.file_path): len(r.issues) for r in read_results(spark, path).collect()}
    assert nested == {("one", "a.py"): 0, ("two", "a.js"): 1}

    source, results, rollups = (str(tmp_path / x) for x in ("in", "results", "rollups"))
    for batch in (one.union(two), corpus_of({"a.py": "y = 2\n"}, "one"), corpus_of({"c.py": "exec(x)\n"}, "three")):
        batch.write.mode("append").parquet(source)
        rollup_stream(file_stream(spark, source), results, rollups, str(tmp_path / "state")).awaitTermination()
    left = corpus_of({"a.py": "y = 2\n", "b.py": "x = 1\n"}, "one").union(two).union(corpus_of({"c.py": "exec(x)\n"}, "three"))
    columns = [c for c in repository_rollup(review(left)).columns if c != "languages"]
    got = sorted(map(tuple, read_results(spark, rollups).select(*columns).collect()))
    assert got == sorted(map(tuple, repository_rollup(review(left)).select(*columns).collect()))


def test_invalid_bytes_are_ignored_as_python_does(spark):
    rng = random.Random(9)
    parts = [b"a", b"\xef\xbf\xbd", b"\xff", b"\xc3\xa9", b"\xc3", b"\xed\xa0\x80", b"\xf0\x9f\x98\x80", b"\xf0\x9f", b"\xef\xa3\xbf", b"0", b"1", b"\xe2\x82", b"\xc0\x80", b"\xf4\x90\x80\x80", b"\x80", b"\xef\xbf"]
    texts = [b"a\xef\xbf\xbdb\xff", b"", b"\xff", b"\xef\xa3\xbf1\xff"]
    texts += [b"".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(3000)] + [rng.randbytes(rng.randint(1, 30)) for _ in range(3000)]
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "i int, raw binary")
    found = {r.i: r.text for r in df.select("i", decode_text(F.col("raw")).alias("text")).collect()}
    for i, t in enumerate(texts):
        assert found[i] == t.decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n"), t
