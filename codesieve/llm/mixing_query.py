"""``op1_mixing``: all documents mixed to source weights 1, 2, 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm.common import WORD, stored
from codesieve.llm.mixing import mix

NAME = "op1_mixing"


def word_count(text):
    """Words of a text, null counting as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', '17', doc_id)), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM docs GROUP BY source),
marked AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) * weight
            >= cap * (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS is_full
  FROM sources
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE weight *
           ((sum(source_size) OVER () - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::DOUBLE
            / (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ())::DOUBLE) END AS target
  FROM marked),
placed AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (times + CASE WHEN before + size / 2 < target - times * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
