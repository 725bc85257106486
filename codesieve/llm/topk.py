"""Exact top-k by inner product, with a pivot table that rules candidates out."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.common import stored


def quantised(vector: Column, scale: int = 256) -> Column:
    """Components to floor(scale * x), x as double; null where the vector or a component is null or not finite."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def choose_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Far-apart rows: each next one is the farthest from those chosen."""
    if not len(vectors):
        return vectors
    chosen = [0]
    nearest = np.linalg.norm(vectors - vectors[0], axis=1)
    while len(chosen) < min(n, len(vectors)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(vectors - vectors[chosen[-1]], axis=1))
    return vectors[chosen]


def exact_scores(block: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, exact: in doubles where no sum can pass 2**53, else in Python's integers."""
    if float(np.abs(block).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(len(query), 1) < 2.0**53:
        return (block.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    exact = block.astype(object) @ query.astype(object)
    return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in exact], np.int64)


def best_of_block(q: np.ndarray, q_table: np.ndarray, own: np.ndarray, ids: np.ndarray, block: np.ndarray, table: np.ndarray, norms: np.ndarray, k: int):
    """The k best rows of a block for one query, by bound: for a pivot p, |d(x, p) - d(q, p)| is a lower bound of d(x, q), and
    x.q = (|x|^2 + |q|^2 - d(x, q)^2) / 2, so the largest of these bounds limits the score from above. Rows are scored in
    falling order of that limit until the next limit is below the k-th best score; rows at that score are still scored, for
    ties go to the smaller id."""
    # distances are rounded in proportion to their own size
    bounds = np.abs(table - q_table) - (table + q_table) * 1e-12
    nearest = np.maximum(bounds.max(axis=1), 0) if table.shape[1] else np.zeros(len(ids))
    total = norms + float(q.astype(np.float64) @ q.astype(np.float64))
    limit = (total - nearest**2) / 2 + total * 1e-9 + 1  # the slack covers rounding of the norms
    order = np.argsort(-limit, kind="stable")
    order = order[~own[order]]
    scores, found, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, 256
    while at < len(order) and (len(scores) < k or limit[order[at]] >= scores[-1]):
        rows = order[at:at + step]
        at, step = at + step, step * 2
        scores, found = np.concatenate([scores, exact_scores(block[rows], q)]), np.concatenate([found, ids[rows]])
        keep = _ranked(scores, found)[:k]
        scores, found = scores[keep], found[keep]
    return scores, found


def _ranked(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, np.invert(scores)))  # ~s falls as s rises, over all of int64


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 24, sample: int = 512, block: int = 16384, query_block: int = 8192) -> DataFrame:
    """For each query of ``vectors(vec_id, v)``, ``v`` an array of bigint, its k best other rows by inner product:
    query_id, rank, vec_id, score; ties to the smaller vec_id.

    Pivots come from ``sample`` rows of a seeded order (bounded; they only decide how much is ruled out, never the result). Every
    row's distances to them, the pivot table, are computed once, where the row is read. Blocks of rows meet blocks of queries:
    a task holds one of each, and keeps k rows a query.

    Defined cases: rows with null vec_id or v take no part; vectors of different lengths are never compared; a row with the
    query's vec_id is the query's own and no candidate of it; repeated candidate rows are candidates each, a repeated query (same id and vector) is asked
    once; scores past 64 bits saturate. No queries or no candidates give no rows. Other columns are ignored.
    """
    rows = vectors.select("vec_id", "v", is_query.alias("asked")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    seen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    by_length: dict[int, list] = {}
    for r in seen:
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    chosen = {n: choose_pivots(np.array(v, np.float64).reshape(len(v), n), pivots) for n, v in by_length.items()}

    def distances(batches):
        for batch in batches:
            out = []
            for v in batch["v"]:
                p = chosen.get(len(v))
                out.append(np.linalg.norm(p - np.asarray(v, np.float64), axis=1) if p is not None else np.empty(0))
            yield batch.assign(distances=out)

    tabled = stored(rows.mapInPandas(distances, "vec_id bigint, v array<bigint>, asked boolean, distances array<double>"), "pivot-table")
    queries = tabled.filter("asked").dropDuplicates(["vec_id", "v"])
    blocks = max(1, math.ceil(tabled.count() / block))
    query_blocks = max(1, math.ceil(queries.count() / query_block))

    def spread(df, own, n, n_other):
        # names of their own: both sides come from one table
        return df.select(
            F.col("vec_id").alias(f"{own}_id"), F.col("v").alias(f"{own}_v"), F.col("distances").alias(f"{own}_d"), F.size("v").alias(f"{own}_length"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(f"{own}_no"),
            F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(f"{own}_with"))

    asked = spread(queries, "asked", query_blocks, blocks).groupBy("asked_length", "asked_no", "asked_with")
    against = spread(tabled, "block", blocks, query_blocks).groupBy("block_length", "block_with", "block_no")

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            ids, block_rows = c["block_id"].to_numpy(np.int64), np.array(c["block_v"].to_list(), np.int64).reshape(len(c), -1)
            table = np.array(c["block_d"].to_list(), np.float64).reshape(len(c), -1)
            norms = (block_rows.astype(np.float64) ** 2).sum(axis=1)
            for query_id, v, d in zip(q["asked_id"], q["asked_v"], q["asked_d"], strict=True):
                v = np.asarray(v, np.int64)
                scores, found = best_of_block(v, np.asarray(d, np.float64), ids == query_id, ids, block_rows, table, norms, k)
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": found, "score": scores, "query": pd.Series([v] * len(found), dtype=object)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "vec_id", "score", "query"], dtype=object)

    found = asked.cogroup(against).applyInPandas(search, "query_id bigint, vec_id bigint, score bigint, query array<bigint>")
    order = Window.partitionBy("query_id", F.xxhash64("query")).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
