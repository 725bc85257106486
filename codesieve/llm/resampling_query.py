"""``op6_quality``: documents resampled towards those that are labelled as good."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm.resampling import resample

NAME = "op6_quality"
SQL = None  # a trained model; tests measure it on held-out labels


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many documents as the labels' share of good ones makes of all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality IS NOT NULL")
    share = labels.agg(F.avg((F.col("quality") == 1).cast("int"))).first()[0] or 0.0
    return resample(docs, labels.filter("quality = 1").select("doc_id"), share).select(
        "doc_id", "log_ratio", "gumbel_key", F.col("selected").alias("kept"))
