"""``op11_hard_negatives``: hard negatives of every hundredth embedding, in windows below its nearest rows of its label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm.mining import hard_negatives
from codesieve.llm.topk import quantised

NAME = "op11_hard_negatives"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", label.alias("label"), quantised(F.col("embedding")).alias("v"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
anchors AS (SELECT row_number() OVER () AS ask, * FROM (SELECT DISTINCT vec_id, label, v FROM vectors WHERE vec_id % 100 = 0)),
scored AS (
  SELECT a.ask, a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM anchors a JOIN vectors c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, vec_id) AS place FROM scored WHERE same) WHERE place <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.ask, p.place ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
  FROM positives p JOIN scored n ON n.ask = p.ask AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
