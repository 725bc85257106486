"""``op9_chat``: all conversations formatted, read back and digested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm.chat import format_conversations, read_loss, read_turns, text_part

NAME = "op9_chat"
TRICKY = r"\### Assistant: </turn> ok"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id bigint, turn bigint, role string, text string")
    return rows.unionByName(more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations(spark, sf_dir).withColumn("parts", F.array(text_part(F.coalesce("text", F.lit("")))))
    done = format_conversations(turns).withColumn("turns", read_turns(F.col("formatted"))).withColumn(
        "loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant'),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length('<|turn|>') + length(replace(replace(replace(role, '\', '\s'), '<', '\l'), chr(10), '\n')) + 1
             + length(replace(replace(text, '\', '\s'), '<', '\l')) + length('<|end|>') + 1) AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM joined
"""
