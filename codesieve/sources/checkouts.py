"""Checkouts on a file system as a Spark data source: folders that are excluded are never listed, files that filters rule out never opened."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
    StringStartsWith,
)

from codesieve.functions.paths import exclusion_patterns

SCHEMA = "repo string, path string, size bigint, raw binary"
_KINDS = [("repo", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("raw", pa.binary())]
_BYTES = 16 << 20  # of files that are handed on together

_TESTS = {
    EqualTo: lambda own, wanted: own == wanted, In: lambda own, wanted: own in wanted, StringStartsWith: str.startswith, StringEndsWith: str.endswith,
    LessThan: lambda own, wanted: own < wanted, LessThanOrEqual: lambda own, wanted: own <= wanted,
    GreaterThan: lambda own, wanted: own > wanted, GreaterThanOrEqual: lambda own, wanted: own >= wanted,
}
_KNOWN_UNREAD = ("repo", "path", "size")  # what is known of a file without opening it


class Folder(InputPartition):
    """A folder of a repository with all below it, or, with ``below`` false, the files right in it."""

    def __init__(self, repo: str, path: str, below: bool):
        super().__init__((repo, path, below))
        self.repo, self.path, self.below = repo, path, below


class CheckoutReader(DataSourceReader):
    """Reads files below ``root/<repository>/``. A task gets a repository's files at its top, or one of its folders; listing and reading happen there."""

    def __init__(self, options):
        self.root = options.get("root") or options.get("path")
        if not self.root:
            raise ValueError("checkouts need a path")
        # one a line: a pattern may hold a comma
        listed = lambda name: options[name].split("\n") if name in options else None
        self.patterns = exclusion_patterns(listed("excludepatterns"), listed("excludedirectories"))
        self.filters: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on repository, path and size are kept; Spark checks the others."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _KNOWN_UNREAD and f.value is not None:
                self.filters.append((f.attribute[0], type(f), f.value))
            elif not (isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] in _KNOWN_UNREAD):
                yield f

    def _passes(self, known: dict) -> bool:
        return all(_TESTS[test](known[name], value) for name, test, value in self.filters if name in known)

    def _may_hold(self, repo: str, folder: str) -> bool:
        """Whether a folder (its path, with a slash behind, or empty) may hold a file that the filters let pass."""
        if not self._passes({"repo": repo}):
            return False
        for name, test, value in self.filters:
            if name == "path" and test is StringStartsWith and not (folder.startswith(value) or value.startswith(folder)):
                return False
            if name == "path" and test is EqualTo and not value.startswith(folder):
                return False
            if name == "path" and test is In and not any(v is not None and v.startswith(folder) for v in value):
                return False
        return True

    def _excluded_folder(self, folder: str) -> bool:
        return self.patterns is not None and any(re.search(p, f"/{folder}") for p in self.patterns.folders)

    def _excluded(self, path: str) -> bool:
        return self.patterns is not None and any(re.search(p, f"/{path}") for p in self.patterns.files)

    def partitions(self) -> list[Folder]:
        out = []
        with os.scandir(self.root) as repos:
            names = sorted(e.name for e in repos if e.is_dir())
        for repo in names:
            if not self._may_hold(repo, ""):
                continue
            out.append(Folder(repo, "", False))
            with os.scandir(os.path.join(self.root, repo)) as top:
                folders = sorted(e.name for e in top if e.is_dir(follow_symlinks=False))
            out += [Folder(repo, f"{name}/", True) for name in folders if not self._excluded_folder(f"{name}/") and self._may_hold(repo, f"{name}/")]
        return out

    def _files(self, repo: str, folder: str, below: bool):
        with os.scandir(os.path.join(self.root, repo, folder)) as entries:
            ordered = sorted(entries, key=lambda e: e.name)
        for entry in ordered:
            path = folder + entry.name
            if entry.is_dir(follow_symlinks=False):
                if below and not self._excluded_folder(f"{path}/") and self._may_hold(repo, f"{path}/"):
                    yield from self._files(repo, f"{path}/", True)
            elif not self._excluded(path) and self._passes({"repo": repo, "path": path}) and entry.is_file():
                size = entry.stat().st_size
                if self._passes({"size": size}):
                    yield path, size, entry.path

    def read(self, partition: Folder | None):
        if partition is None:  # there are none
            return
        rows, held = [], 0
        for path, size, place in self._files(partition.repo, partition.path, partition.below):
            try:
                with open(place, "rb") as file:
                    raw = file.read()
            except OSError:
                raw = None  # an unreadable file is a row, too
            rows.append((partition.repo, path, size, raw))
            held += size
            if held >= _BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _KINDS, strict=True)], [n for n, _ in _KINDS])


class Checkouts(DataSource):
    """``spark.read.format("checkouts").load(root)`` after :func:`register`. Options ``excludePatterns`` and ``excludeDirectories``, one name a line."""

    @classmethod
    def name(cls) -> str:
        return "checkouts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CheckoutReader:
        return CheckoutReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Checkouts)


def discover_checkouts(spark: SparkSession, root: str, patterns: list[str] | None = None, directories: list[str] | None = None) -> DataFrame:
    """``files(repo, path, size, raw)`` below ``root/<repository>/``, without excluded ones: what ``discover(read_checkouts(...))`` gives, but an
    excluded folder is not listed, and an excluded file not opened. Filters on repo, path and size that follow are tested while listing, too.

    ``root`` is a folder that the driver and every executor have at the same path. Symbolic links to folders are not followed.
    """
    register(spark)
    reader = spark.read.format("checkouts")
    for name, given in (("excludePatterns", patterns), ("excludeDirectories", directories)):
        if given is not None:
            reader = reader.option(name, "\n".join(given))
    return reader.load(root)
