"""Result tables out: nested records, and tables in which a new scan takes the place of an old one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codesieve.operators.dependencies import SCOPES
from codesieve.operators.paging import sorted_pieces


def nested_file_results(results: DataFrame) -> DataFrame:
    """One record per analysed file: issues, metrics, suggestions, scores, time."""
    return results.filter("analyzed").select(
        "repo",
        F.col("path").alias("file_path"),
        "language",
        "issues",
        F.struct("lines_of_code", "blank_lines", "comment_lines", "cyclomatic_complexity", "functions", "classes",
                 "file_size", "file_hash").alias("metrics"),
        "suggestions",
        F.struct(
            F.col("security_score").alias("security"), F.col("quality_score").alias("quality"),
            F.col("performance_score").alias("performance")).alias("scores"),
        F.current_timestamp().alias("timestamp"),
    )


def write_file_results(results: DataFrame, path: str, format: str = "parquet") -> None:
    """Write nested file results.

    Not partitioned by repository: there may be millions, and each would become a folder. Sort by it
    instead, so that readers prune row groups.
    """
    nested_file_results(results).sortWithinPartitions("repo").write.mode("overwrite").format(format).save(path)


BUCKETS = 64  # folders of a result table; its repositories are dealt out to them
_BUCKET = "bucket"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("repo"), F.lit(buckets)).cast("int")


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that :func:`replace_results` keeps; None before the first write."""
    try:
        return spark.read.parquet(path).filter("repo IS NOT NULL").drop(_BUCKET)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # a first write of no rows leaves an empty folder
            raise
        return None


def replace_results(rows: DataFrame, path: str, keys: tuple[str, ...] = ("repo",), gone: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Put ``rows(repo, ...)`` into the table at ``path``: rows there with the same ``keys`` are replaced, others stay.

    The table has a folder for each bucket of repositories. Only buckets of the repositories in ``rows`` are read and written again, each
    as a whole, by dynamic partition overwrite; a large bucket is spread over several files. ``gone(repo[, ...])`` lists keys without rows any more, whose old rows
    go. Running it again changes nothing. ``buckets`` must stay the same for a table; a null repo takes no part.

    The keys are read off ``rows`` on their own, so what makes the other columns runs once.
    """
    spark = rows.sparkSession
    rows = rows.filter("repo IS NOT NULL")
    replaced = rows.select(*keys)
    if gone is not None:
        replaced = replaced.union(gone.select(*keys))
    out = rows.withColumn(_BUCKET, _bucket(buckets))
    if read_results(spark, path) is not None:
        old = spark.read.parquet(path).filter("repo IS NOT NULL")
        touched = replaced.select(_bucket(buckets).alias(_BUCKET)).distinct()
        kept = old.join(touched, _BUCKET, "left_semi").join(replaced.distinct(), list(keys), "left_anti")
        out = kept.unionByName(out, allowMissingColumns=True)
    if gone is not None:
        # a bucket of which nothing is left is written, too: with one row that readers pass over
        marks = gone.select(_bucket(buckets).alias(_BUCKET)).distinct()
        out = out.unionByName(marks, allowMissingColumns=True)
    out.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def replace_file_results(results: DataFrame, path: str, **options) -> None:
    """Nested file results of a scan take the place of those of the same repositories."""
    replace_results(nested_file_results(results), path, **options)


def nested_repository_results(rollup: DataFrame, dependencies: DataFrame, summaries: DataFrame) -> DataFrame:
    """One record per repository: counts, languages, scores, dependencies by scope, summary.

    File results stay in their own table, keyed by repository: a record that held them all would not
    be bounded. A repository's packages are one value of the record. They reach its task as sorted pieces, in Spark's compact
    arrays, and meet the repository's numbers in the aggregate that puts them together: no set of packages is held,
    and no join behind the aggregate copies the lists again.
    """
    # rows of one repository, should it come twice, are records of their own
    small = rollup.join(summaries, "repo", "left").withColumn("copy", F.row_number().over(Window.partitionBy("repo").orderBy(F.lit(1))))
    pieces = sorted_pieces(dependencies, ["repo", "scope"], "package").join(small.select("repo", "copy"), "repo")
    record = F.struct(*small.columns).alias("record")
    rows = small.select("repo", "copy", record).unionByName(pieces, allowMissingColumns=True)

    def packages(scope: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col("scope") == scope, F.struct("piece", "values"))))
        return F.flatten(F.transform(own, lambda p: p["values"])).alias(scope)

    return (
        rows.groupBy("repo", "copy").agg(F.first("record", ignorenulls=True).alias("r"), *[packages(s) for s in SCOPES])
        .select(
            F.col("repo").alias("repository"), "r.total_files", "r.analyzed_files", "r.languages",
            F.struct(F.col("r.security_score").alias("security"), F.col("r.quality_score").alias("quality"),
                     F.col("r.performance_score").alias("performance")).alias("overall_scores"),
            F.struct(*SCOPES).alias("dependencies"),
            "r.summary",
            F.current_timestamp().alias("timestamp"),
        )
    )
