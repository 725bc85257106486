"""Structured run logs: NDJSON with one event per line.

Two wordings are known: that of whole-repository scans, and that of scans of one analysis type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fields of a log event, and the wording of start and completion messages.
LOG = """timestamp string, level string, logger string, message string, module string, function string,
    line int, exception string"""
STARTED = r"^Starting (?:repository analysis|(\w+) analysis for repository): (.*)$"
COMPLETED = r"(?:^Completed (\w+) analysis for (.*) in|completed in) ([0-9.]+)s"
FOUND = r"Found ([0-9]+) issues$"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path))


def parse_log(df: DataFrame, json: str) -> DataFrame:
    """Events from a JSON text column."""
    # behind a generator the text is parsed once, not once per field that is used
    parsed = df.select(F.explode(F.array(F.from_json(json, LOG))).alias("e"))
    return _typed(parsed.filter("e.logger is not null").select("e.*"))


def _typed(events: DataFrame) -> DataFrame:
    # log times have no zone
    return events.withColumn("ts", F.expr("try_cast(timestamp as timestamp_ntz)"))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("logger", "level").agg(F.count("*").alias("events"))


def _part(pattern: str, group: int) -> Column:
    text = F.regexp_extract("message", pattern, group)
    return F.when(text != "", text)


def runs(events: DataFrame, slice: str = "hour") -> DataFrame:
    """One row per completed run: repository, analysis type, start, end, reported seconds and issues.

    A completion belongs to the last start of its logger, unless it names its repository itself. Events are in order of (time, line,
    message); those without a readable time come first. The look-back works inside slices of time (``minute`` for very busy
    loggers), with the last start of every earlier slice handed on, so that a logger that writes most of the log is spread over
    many tasks. Both parts use the same exchange of the marks: the log is read once.
    """
    message = F.col("message")
    start = F.struct("ts", _part(STARTED, 2).alias("repo"), _part(STARTED, 1).alias("analysis_type"))
    marks = (
        events.filter(message.startswith("Starting ") | message.contains("ompleted "))
        .select(
            "logger", F.coalesce("logger", F.lit("")).alias("writer"), "ts", "line", "message",
            F.coalesce(F.date_trunc(slice, "ts"), F.to_timestamp_ntz(F.lit("0001-01-01"))).alias("slice"),
            F.when(message.rlike(STARTED), start).alias("start"),
            _part(COMPLETED, 1).alias("type"), _part(COMPLETED, 2).alias("named"),
            _part(COMPLETED, 3).cast("double").alias("seconds"), _part(FOUND, 1).cast("long").alias("issues"),
        )
        .repartition("writer", "slice")
    )
    order = ["ts", "line", "message"]
    others = ["logger", "type", "named", "seconds", "issues"]  # all columns, so that both parts share one exchange
    in_slice = Window.partitionBy("writer", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("writer").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    handed_on = (
        marks.groupBy("writer", "slice").agg(F.max(F.when(F.col("start").isNotNull(), F.struct(*order, "start", *others)))["start"].alias("last_start"))
        .withColumn("handed_on", F.last("last_start", ignorenulls=True).over(earlier))
        .select("writer", "slice", "handed_on")
    )
    return (
        marks.join(handed_on, ["writer", "slice"])
        .withColumn("run", F.coalesce(F.last("start", ignorenulls=True).over(in_slice), "handed_on"))
        .filter(F.col("seconds").isNotNull())
        .select(
            "logger", F.coalesce("named", "run.repo").alias("repo"),
            F.coalesce("type", "run.analysis_type").alias("analysis_type"), F.col("run.ts").alias("started"),
            F.col("ts").alias("completed"), "seconds", "issues")
    )


def run_durations(completed: DataFrame) -> DataFrame:
    """Runs and reported seconds per repository."""
    return completed.groupBy("repo").agg(
        F.count("*").alias("runs"), F.min("seconds").alias("fastest"), F.max("seconds").alias("slowest"),
        F.avg("seconds").alias("mean_seconds"))
