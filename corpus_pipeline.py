"""From raw documents to a training mix: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``documents``. Nulls, empty texts, repeated rows and empty tables are handled as the operators say;
further columns pass through. Stages whose result is computed by Python while its caller writes it keep the session's batches small
(:func:`codesieve.llm.common.small_batches`), also after them: by default a batch is all texts of a task, held several times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codesieve.llm.common import small_batches, stored
from codesieve.llm.forest import near_duplicates
from codesieve.llm.langid import identify
from codesieve.llm.langid_query import held_out
from codesieve.llm.lines import dedupe_lines
from codesieve.llm.mixing import mix, repeated
from codesieve.llm.mixing_query import word_count
from codesieve.llm.tiling import decontaminate


def _packed(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and the rest of the row beside them: no name of a column can get in an operator's way."""
    return docs.select("doc_id", "text", "source", "lang", F.struct(*[c for c in docs.columns if c != "text"]).alias("__row"))


def _unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    return rows.select(*[new.get(c, F.col("text") if c == "text" else F.col("__row")[c]).alias(c) for c in columns], *[v.alias(k) for k, v in new.items() if k not in columns])


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without a letter, and those that fit two languages alike, go."""
    small_batches(spark)
    return _unpacked(identify(_packed(docs), docs.filter(~held_out())).filter(~F.col("ambiguous")), docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal or similar lines the first stays. Documents all of whose lines are found elsewhere go; ``n_chars`` follows the text."""
    small_batches(spark)
    left = dedupe_lines(_packed(docs))
    changed = F.col("n_dropped") > 0
    left = left.filter(~(changed & ~F.col("text").rlike(r"\S")))
    return _unpacked(left, docs.columns, n_chars=F.when(changed, F.length("text").cast("long")).otherwise(F.col("__row.n_chars")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of 5 words, similarity 0.8. Of rows that agree in doc_id and text one stays."""
    kept = stored(near_duplicates(docs, width=5, percent=80).filter("kept").select("at").distinct(), "kept")
    rows = _packed(docs).withColumn("__at", F.xxhash64("doc_id", F.xxhash64("text"))).join(kept.withColumnRenamed("at", "__at"), "__at")
    first = Window.partitionBy("__at").orderBy("source", "lang")
    return _unpacked(rows.withColumn("__no", F.row_number().over(first)).filter("__no = 1"), docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, in whatever order."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _unpacked(decontaminate(_packed(docs), benchmark).filter("NOT contaminated"), docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as the source weights ask; ``copy`` counts from 1 and replaces a column of that name."""
    docs = docs.drop("copy")
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return _unpacked(repeated(mix(_packed(docs), stored(sizes, "mix-sizes"))), docs.columns, copy=F.col("copy"))


STAGES = [
    ("language identification", identified),
    ("line dedup", without_repeated_lines),
    ("near-duplicates", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed_sources),
]

#: Trained classifiers, fuzzy components and string tilings can't be said in SQL; tests run the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
