"""``op2_token_counts``: tokens of every document, before and after three edits of its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm.token_trees import TokenCounter, count_tokens

NAME = "op2_token_counts"
SQL = None  # SQL has no tokenizer; tests count whole texts with it


def three_edits(text: Column) -> Column:
    """An insertion after a quarter of the text, a deletion of up to 40 characters from its middle on, new last characters."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    quarter, middle = F.floor(n / 4), F.floor(n / 2)
    edit = lambda start, stop, new: F.struct(start.alias("start"), stop.alias("stop"), F.lit(new).alias("text"))
    return F.array(edit(quarter, quarter, " (see note 12) "), edit(middle, middle + 40, ""), edit(n - 35, n, " the end.\n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counter = TokenCounter(spark)
    counted = count_tokens(docs, counter)
    edited = counted.withColumn("edited", counter.edited(F.col("text"), F.col("tree"), three_edits(F.col("text"))))
    return edited.select(
        "doc_id", F.col("tree.chars")[1].alias("n_chars"), "n_tokens", F.col("edited.chars")[1].alias("edited_chars"),
        F.col("edited.tokens")[1].alias("edited_tokens"), F.col("edited.encoded").alias("encoded_again"))
