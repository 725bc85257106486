"""The table of configured repositories: numbered snapshots, and a row for each that counts."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a configured repository.
REPO_CONFIG = """owner string, name string, full_name string, language string, default_branch string,
    enabled boolean, analysis_config map<string, string>, last_analyzed string"""

_COMMITS = "version bigint, snapshot string, saved_at timestamp, repositories bigint"


class ChangedMeanwhileError(RuntimeError):
    """Another writer saved after the version that a save was based on."""


def with_defaults(records: DataFrame) -> DataFrame:
    """A missing switch means enabled; a missing override map is empty; an empty time is null."""
    return records.select(
        "owner", "name", "full_name", "language", "default_branch",
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.coalesce("analysis_config", F.create_map().cast("map<string,string>")).alias("analysis_config"),
        F.expr("try_cast(last_analyzed as timestamp_ntz)").alias("last_analyzed"),
    )


class ConfigStore:
    """Configurations in a folder that every executor reaches.

    A save writes a whole snapshot to a folder of its own, and then one row to the table of commits, which is a single
    file that appears at once. What is loaded is the snapshot of the highest version in that table, so a save that breaks off leaves
    the state before it, and rows that were loaded may be changed and saved to where they came from. Old snapshots stay, and can be loaded by
    version; a folder of plain JSON records without commits is read as it is.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def history(self) -> DataFrame:
        """(version, snapshot, saved_at, repositories) of every save."""
        try:
            return self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _COMMITS)

    def _head(self, version: int | None = None):
        known = self.history() if version is None else self.history().filter(F.col("version") == version)
        return known.orderBy(F.desc("version"), "saved_at", "snapshot").first()

    def version(self) -> int:
        """The newest version; 0 before the first save."""
        head = self._head()
        return head.version if head else 0

    def load(self, version: int | None = None) -> DataFrame:
        """The configurations of the newest version, or of another."""
        head = self._head(version)
        if head is None and version is not None:
            raise ValueError(f"no version {version}")
        return with_defaults(self.spark.read.schema(REPO_CONFIG).json(f"{self.path}/snapshots/{head.snapshot}" if head else self.path))

    def save(self, configs: DataFrame, based_on: int | None = None) -> int:
        """Save all configurations as the next version, and give its number. ``based_on`` is the version that they were made from: if another has been
        saved since, nothing changes and :class:`ChangedMeanwhileError` is raised. Of two savers at the same time the first one counts."""
        head = self.version()
        if based_on is not None and based_on != head:
            raise ChangedMeanwhileError(f"version {head} was saved after {based_on}")
        name = f"{head + 1}-{uuid.uuid4().hex}"
        snapshot = f"{self.path}/snapshots/{name}"
        configs.withColumn("last_analyzed", F.date_format("last_analyzed", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).write.json(snapshot)
        n = self.spark.read.schema(REPO_CONFIG).json(snapshot).count()
        row = self.spark.range(1).select(
            F.lit(head + 1).cast("long").alias("version"), F.lit(name).alias("snapshot"), F.current_timestamp().alias("saved_at"), F.lit(n).cast("long").alias("repositories"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        if self._head(head + 1).snapshot != name:
            raise ChangedMeanwhileError(f"version {head + 1} was saved at the same time")
        return head + 1


def load(spark: SparkSession, path: str) -> DataFrame:
    return ConfigStore(spark, path).load()


def save(configs: DataFrame, path: str) -> None:
    """Save to a folder, which may be the one that ``configs`` was loaded from."""
    ConfigStore(configs.sparkSession, path).save(configs)
