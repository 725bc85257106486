"""Checkouts on disk: what is listed and opened, and that no filter changes the rows."""

from __future__ import annotations

import builtins
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from codesieve.sources.checkouts import SCHEMA, CheckoutReader, discover_checkouts
from codesieve.sources.files import discover, read_checkouts

TREE = {
    "one/app.py": b"eval(x)\n", "one/sub/a.js": b"var a = 1\n", "one/sub/deep/b.py": b"x = 1\n", "one/.git/objects/00/ab": b"\x00\x01", "one/.git/HEAD": b"ref",
    "one/node_modules/left/pad.js": b"pad", "one/sub/node_modules/x.js": b"x", "one/build/out.txt": b"o", "one/sub/a.pyc": b"\x00", "one/run.log": b"log",
    "one/__init__.py": b"import a\n", "one/big.txt": b"y" * 5000, "one/empty.txt": b"", "two/b.py": b"x = 1\n", "two/env": b"a file of an excluded name", "two/environment/c.py": b"y\n",
    "two/we ird\n[1].txt": b"w", "two/\xff-name".encode("latin1").decode("utf-8", "surrogateescape") if False else "two/näme.txt": b"n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("checkouts")
    for name, raw in TREE.items():
        file = top / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(raw)
    (top / "loose.txt").write_text("not in a repository")
    (top / "one" / "loop").symlink_to(top / "one")
    (top / "empty").mkdir()
    return str(top)


def rows(df):
    return sorted((r.repo, r.path, r.size, bytes(r.raw)) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"patterns": ["*.py", "su?"], "directories": []}, {"patterns": [], "directories": ["node_modules", "two"]}])
def test_the_same_rows_as_reading_first(spark, root, options):
    found = rows(discover_checkouts(spark, root, **options))
    listed = [(*name.split("/", 1), len(raw), bytearray(raw)) for name, raw in TREE.items()]
    assert found == rows(discover(spark.createDataFrame(listed, SCHEMA), **options))


def test_what_the_plain_reader_passes_over(spark, root):
    """Spark's file sources see no empty files and no names that begin with a dot or an underscore."""
    plain = {(r[0], r[1]) for r in rows(read_checkouts(spark, root)) if not r[1].startswith("loop/") and r[1] != "loose.txt"}
    every = {tuple(name.split("/", 1)) for name in TREE}
    assert every - plain == {("one", "empty.txt"), ("one", "__init__.py"), ("one", ".git/HEAD"), ("one", ".git/objects/00/ab")}


def opened_by(monkeypatch, reader):
    opened, listed, read, scan = [], [], builtins.open, os.scandir
    monkeypatch.setattr(builtins, "open", lambda name, *a, **k: (opened.append(os.path.relpath(name, reader.root)), read(name, *a, **k))[1])
    monkeypatch.setattr(os, "scandir", lambda path: (listed.append(os.path.relpath(path, reader.root)), scan(path))[1])
    for partition in reader.partitions():
        for _ in reader.read(partition):
            pass
    monkeypatch.undo()
    return set(opened), set(listed)


def test_excluded_folders_are_not_listed_nor_files_opened(root, monkeypatch):
    opened, listed = opened_by(monkeypatch, CheckoutReader({"path": root}))
    assert not [p for p in opened | listed if ".git" in p or "node_modules" in p or "build" in p or p.endswith((".pyc", ".log", "/env"))]
    assert "one/app.py" in opened and "one/sub/deep/b.py" in opened and "one/loop" not in listed


def test_filters_are_tested_while_listing(root, monkeypatch):
    reader = CheckoutReader({"path": root})
    left = list(reader.pushFilters([
        EqualTo(("repo",), "one"), StringStartsWith(("path",), "sub/"), StringEndsWith(("path",), ".py"), LessThanOrEqual(("size",), 100), IsNotNull(("size",)),
        StringContains(("path",), "b"), EqualTo(("raw",), b"x"), EqualTo(("path",), None)]))
    assert [type(f) for f in left] == [StringContains, EqualTo, EqualTo]
    assert opened_by(monkeypatch, reader) == ({"one/sub/deep/b.py"}, {".", "one", "one/sub", "one/sub/deep"})
    reader = CheckoutReader({"path": root})
    assert list(reader.pushFilters([In(("path",), ("app.py", "sub/a.js", None)), GreaterThan(("size",), 8)])) == []
    assert opened_by(monkeypatch, reader)[0] == {"one/sub/a.js"}


def test_filters_change_no_rows(spark, root):
    files = discover_checkouts(spark, root)
    every = rows(files)
    for test, keep in [
        (F.col("size") <= 8, lambda r: r[2] <= 8), (F.col("repo") == "two", lambda r: r[0] == "two"), (F.col("path").startswith("sub/"), lambda r: r[1].startswith("sub/")),
        (F.col("path").isin("app.py", "b.py"), lambda r: r[1] in ("app.py", "b.py")), ((F.col("size") > 5) & F.col("path").contains("a"), lambda r: r[2] > 5 and "a" in r[1]),
        (F.col("raw") == F.lit(b"x = 1\n"), lambda r: r[3] == b"x = 1\n"), (F.lit(False), lambda r: False),
    ]:
        assert rows(files.filter(test)) == [r for r in every if keep(r)]
    assert files.select("path").count() == len(every)


def test_no_checkouts(spark, tmp_path):
    assert discover_checkouts(spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        CheckoutReader({})
