"""``op10_decontamination``: every document against every benchmark passage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm.tiling import decontaminate

NAME = "op10_decontamination"
SQL = None  # tiles are marked one after the other; tests compare with a brute-force tiling


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate(docs, benchmark)
    return found.select("doc_id", (~F.col("contaminated")).alias("kept"), "contaminated", "coverage", "item_ids")
