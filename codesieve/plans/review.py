"""The repository review: files in, one result row per file out, rollups from there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.functions.paths import display_language, language
from codesieve.operators.dependencies import ROOT_MANIFESTS
from codesieve.operators.metrics import METRICS, with_metrics
from codesieve.operators.scan import with_issues
from codesieve.operators.scores import with_scores
from codesieve.operators.suggestions import with_suggestions
from codesieve.sources.files import analyzable, code_files, discover, with_text
from codesieve.sources.linters import add_findings

SCORES = ["security_score", "quality_score", "performance_score"]


def prepared_files(files: DataFrame, patterns=None, directories=None, max_size: int | None = None) -> DataFrame:
    """Discovered files with ``language``, ``analyzed``, ``hash`` and, where analysed, ``content``."""
    found = discover(files, patterns, directories)
    return with_text(
        found.withColumn("language", language(F.col("path"))).withColumn("analyzed", analyzable(max_size)),
        when=F.col("analyzed"))


def review(
    files: DataFrame,
    patterns=None,
    directories=None,
    max_size: int | None = None,
    findings: DataFrame | None = None,
    analysis_type: str = "full",
    per_node_long_lines: bool = False,
    profile: str = "core",
) -> DataFrame:
    """File results of ``files(repo, path, size, raw)``; ``max_size`` (such as ``paths.MAX_FILE_SIZE``) leaves larger files out.

    One row per discovered file; ``analyzed`` tells those that were scanned. Everything is computed on
    the file's own row: no shuffle, unless ``findings`` of external linters are joined in.
    """
    prepared = prepared_files(files, patterns, directories, max_size)
    scanned = with_issues(prepared, profile, analysis_type=analysis_type, per_node_long_lines=per_node_long_lines)
    # the texts end here, so a join with findings moves issues and metrics only
    measured = with_metrics(scanned).select("repo", "path", "language", "analyzed", "issues", *METRICS)
    if findings is not None:
        measured = add_findings(measured, findings)
    # a file that was not analysed has no scores
    return with_suggestions(with_scores(measured)).select(
        *measured.columns, "suggestions", *[F.when(F.col("analyzed"), F.col(c)).alias(c) for c in SCORES])


def manifest_files(files: DataFrame) -> DataFrame:
    """Text of the manifests at repository roots."""
    return with_text(files.filter(F.col("path").isin(ROOT_MANIFESTS)))


def profile_review(files: DataFrame, profile: str, analysis_type: str = "full") -> DataFrame:
    """File results of a language-blind profile: issues only, over that profile's file extensions."""
    chosen = code_files(files, profile)
    # the quick profile reports files that cannot be read, the others pass over them
    texts = with_text(chosen, when=F.col("analyzed"))
    scanned = with_issues(
        texts.withColumn("language", display_language(F.col("path"), profile)), profile, analysis_type=analysis_type)
    return scanned.select(
        "repo", "path", "language", "analyzed",
        F.when(F.col("analyzed"), F.col("issues")).otherwise(F.array().cast(scanned.schema["issues"].dataType)).alias("issues"))
