"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codesieve.llm import (
    chat_query,
    forest_query,
    langid_query,
    lines_query,
    lm_query,
    merkle_query,
    mining_query,
    mixing_query,
    packing_query,
    resampling_query,
    tiling_query,
    token_trees_query,
    topk_query,
)

MODULES = [mixing_query, token_trees_query, topk_query, lines_query, forest_query, resampling_query, lm_query, langid_query, chat_query, tiling_query, mining_query, merkle_query, packing_query]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {m.NAME: m.query for m in MODULES}
ORACLES: dict[str, str] = {m.NAME: m.SQL for m in MODULES if m.SQL is not None}
