"""``op5_near_duplicates``: components of all documents whose sets of 3-word shingles are similar to 85 percent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codesieve.llm.forest import near_duplicates

NAME = "op5_near_duplicates"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


SQL = None  # components and all pairs of sets; tests compare with brute force over every pair
