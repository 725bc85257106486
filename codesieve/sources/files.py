"""File corpora: ``files(repo, path, size, raw)`` with paths relative to the repository root."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.functions.paths import has_code_extension, is_binary, is_excluded, is_hidden, is_supported
from codesieve.functions.text import decode_text

_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:/+"


def read_checkouts(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root/<repository>/``, at any depth.

    Meant for moderate corpora in any store that Spark reads; for many small files write them to Parquet once and use that. Spark's file
    sources pass over empty files and names that begin with a dot or an underscore: where folders are mounted,
    :func:`codesieve.sources.checkouts.discover_checkouts` sees them all, and skips excluded folders.
    """
    prefix = re.sub(_SCHEME, "/", root if re.match(_SCHEME, root) else os.path.abspath(root)).rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.substring(F.regexp_replace("path", _SCHEME, "/"), len(prefix) + 2, 1 << 30)
    return read.select(
        F.substring_index(relative, "/", 1).alias("repo"),
        F.regexp_replace(relative, "^[^/]*/", "").alias("path"),
        F.col("length").alias("size"),
        F.col("content").alias("raw"),
    )


def from_table(df: DataFrame, repo: Column, path: Column, raw: Column) -> DataFrame:
    """Any table with a text or binary column as a corpus; null bytes mean the file was unreadable."""
    binary = raw.cast("binary")
    return df.select(
        repo.alias("repo"), path.alias("path"), F.octet_length(binary).cast("long").alias("size"), binary.alias("raw"))


def spread(table: DataFrame, partitions: int) -> DataFrame:
    """Deal out a table to so many tasks. It moves every text, so it is for tables that come in too few pieces."""
    return table.repartition(partitions)


def discover(files: DataFrame, patterns=None, directories=None) -> DataFrame:
    """Drop excluded files, by path alone."""
    return files.filter(~is_excluded(F.col("path"), patterns, directories))


def analyzable(max_size: int | None = None) -> Column:
    """Supported extension, readable, of at most ``max_size`` bytes if that is given, not binary; the cheap tests come first."""
    return (
        is_supported(F.col("path"))
        & F.col("raw").isNotNull()
        & (F.lit(True) if max_size is None else F.col("size") <= max_size)
        & ~is_binary(F.col("path"), F.col("raw"))
    )


def code_files(files: DataFrame, profile: str) -> DataFrame:
    """Corpus of the language-blind profiles, with ``analyzed`` set by their extension lists.

    The web profile alone skips hidden paths.
    """
    kept = files.filter(~is_hidden(F.col("path"))) if profile == "web" else files
    return kept.withColumn("analyzed", has_code_extension(F.col("path"), profile))


def with_text(files: DataFrame, when: Column | None = None) -> DataFrame:
    """Replace ``raw`` by ``content`` and ``hash``; ``content`` stays null where ``when`` is false."""
    text = decode_text(F.col("raw"))
    return files.withColumn("content", text if when is None else F.when(when, text)).withColumn(
        "hash", F.coalesce(F.sha2("raw", 256), F.lit(""))).drop("raw")
