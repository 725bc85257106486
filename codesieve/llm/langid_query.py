"""``op8_langid``: the language of every document, learned from the labelled ones that aren't held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm.langid import identify

NAME = "op8_langid"
SQL = None  # a trained model; tests measure held-out accuracy


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    found = identify(docs.select("doc_id", "text"), docs.filter(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
