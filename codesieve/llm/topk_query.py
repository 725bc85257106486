"""``op3_topk``: the 5 best other embeddings of every 50th one, by integer inner product."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm.topk import quantised, top_k

NAME = "op3_topk"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantised(F.col("embedding")).alias("v"))
    return top_k(rows, F.col("vec_id") % 50 == 0)


SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
queries AS (SELECT DISTINCT vec_id, v FROM vectors WHERE vec_id % 50 = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.v AS query, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM queries q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
