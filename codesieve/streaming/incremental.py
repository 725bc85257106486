"""Review files as they arrive in a folder of Parquet files.

A review needs nothing but the file's own row, so it runs on a stream unchanged and keeps no state. What depends on whole repositories is
made again for those that a batch touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codesieve.operators.rollups import repository_rollup
from codesieve.plans.review import review
from codesieve.sources.results import read_results, replace_results

FILES = "repo string, path string, size bigint, raw binary"


def file_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def review_stream(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append file results of new files to ``out``, each exactly once."""
    return (
        review(files).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def keep_up(batch: DataFrame, results: str, rollups: str) -> None:
    """Put the changed files of a batch into the table of file results, and the rollups of their repositories into theirs.

    A file in ``results`` is replaced if its path comes again; if it comes twice in a batch, one of both counts, by size and bytes. A file without
    bytes (``raw`` null) is an unreadable one, as in a scan. Running a batch again changes nothing.
    """
    spark = batch.sparkSession
    latest = Window.partitionBy("repo", "path").orderBy(F.desc("size"), F.desc("raw"))
    files = batch.withColumn("latest", F.row_number().over(latest)).filter("latest = 1").drop("latest")
    replace_results(review(files), results, keys=("repo", "path"))
    touched = batch.select("repo").distinct()
    replace_results(repository_rollup(read_results(spark, results).join(touched, "repo", "left_semi")), rollups)


def rollup_stream(files: DataFrame, results: str, rollups: str, checkpoint: str) -> StreamingQuery:
    """Keep file results and repository rollups up to date with a stream of changed files."""
    return (
        files.writeStream.foreachBatch(lambda batch, _: keep_up(batch, results, rollups))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
