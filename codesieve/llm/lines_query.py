"""``op4_line_dedup``: which lines of which documents are repeats of others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm.lines import line_decisions

NAME = "op4_line_dedup"
SQL = None  # fuzzy components; tests compare with brute force over every pair of lines


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", lines.alias("n_lines"))  # counted here, texts need not meet the decisions
    lost = F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped"))
    return line_decisions(docs).select("doc_id", "n_lines", (F.col("n_lines") - lost).alias("kept_lines"), "dropped")
