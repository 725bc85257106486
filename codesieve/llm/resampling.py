"""Quality by importance resampling: how much likelier a text is under the target's n-grams than under all texts', and a
Gumbel top-k sample by it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from codesieve.llm.common import mixed, shingle_hashes, stored, summed_vectors, word_hashes, words

_BITS = 16
BUCKETS = 1 << _BITS
_BINS = 4096


def gram_counts(text: str | None) -> np.ndarray:
    """Words and pairs of words of a whole text, by hash bucket."""
    hashes = word_hashes(words(text))
    grams = np.concatenate([mixed(hashes), shingle_hashes(hashes, 2)]) >> np.uint64(64 - _BITS)
    return np.bincount(grams.astype(np.int64), minlength=BUCKETS)


def log_ratios(docs: DataFrame, target_ids: DataFrame, key: str = "doc_id", limit: int = 20000):
    """The natural logarithm of target over raw probability of each bucket.

    The raw model counts all of ``docs(key, text)``; the target model those whose key is in ``target_ids``, of which a seeded share is
    taken so that ``limit`` are expected at most: that bounds what is sent to every task.
    """
    ids = target_ids.select(F.col(key).alias("_target")).filter("_target IS NOT NULL").distinct()
    share = min(1.0, limit / max(ids.count(), 1))
    taken = stored(ids.filter(F.pmod(F.xxhash64("_target"), F.lit(1 << 20)) < share * (1 << 20)), "target-ids")
    small = F.broadcast(taken) if taken.count() <= 2 * limit else taken
    read = docs.join(small, docs[key] == small["_target"], "left").select(F.col("_target").isNotNull().alias("of_target"), "text")
    sums = summed_vectors(read, "of_target", gram_counts, BUCKETS)
    target = sums.get(True, np.zeros(BUCKETS, np.int64))
    raw = target + sums.get(False, np.zeros(BUCKETS, np.int64))
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def _kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column without nulls, exactly: counts in 4096 bins, again within the bin that holds it, until
    few values are left. The driver sees counts of bins, and at the end 4096 values at most."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    inside, left = rows, k
    while low < high:
        bins = inside.groupBy(F.least(F.floor((F.col(column) - low) / (high - low) * _BINS), F.lit(_BINS - 1)).alias("bin")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for b in bins:
            if left <= b["n"]:
                break
            left -= b["n"]
        low, high = b["low"], b["high"]
        inside = rows.filter(F.col(column).between(low, high))
        if b["n"] <= _BINS:
            return sorted((r[0] for r in inside.select(column).collect()), reverse=True)[left - 1]
    return low


def resample(docs: DataFrame, target_ids: DataFrame, share: float, key: str = "doc_id", length: float = 256.0, seed: int = 5, limit: int = 20000) -> DataFrame:
    """``docs`` (but for ``text``, which need not be written) plus ``log_ratio``, ``gumbel_key`` and ``selected``: a sample without replacement of ``share`` of the documents that
    have words, by importance.

    ``log_ratio`` is the mean over a text's n-grams (words and pairs of words, hashed) of the logarithm of target over raw probability;
    the weight is that of ``length`` such n-grams, so that long texts don't win or lose by their length. A document's key adds Gumbel
    noise seeded by its key and text; the largest keys are selected.

    Defined cases: null texts and texts without words have null ``log_ratio`` and are not selected; rows that agree in key and text have
    equal keys and are decided alike, so that ties at the cut are all taken; without targets all weights are about equal and the
    sample is uniform; empty tables give empty results; whole texts of any length are read; other columns pass through, the three
    are replaced.
    """
    weights = docs.sparkSession.sparkContext.broadcast(log_ratios(docs.select(key, "text"), target_ids, key, limit))

    @pandas_udf(T.DoubleType())
    def mean(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            counts = gram_counts(text)
            used = np.flatnonzero(counts)
            out.append(float(counts[used] @ weights.value[used] / counts.sum()) if len(used) else None)
        return pd.Series(out, dtype="float64")

    uniform = (F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), key, "text"), F.lit(11)) + 0.5) / float(1 << 53)
    scored = docs.drop("log_ratio", "gumbel_key", "selected").withColumn("log_ratio", mean("text")).withColumn("log_ratio", F.nanvl("log_ratio", F.lit(None).cast("double")))
    scored = scored.withColumn("gumbel_key", F.col("log_ratio") * length - F.log(-F.log(uniform)))
    scored = stored(scored.drop("text"), "resampled")
    able = scored.select("gumbel_key").filter("gumbel_key IS NOT NULL")
    k = round(share * able.count())
    cut = _kth_largest(able, "gumbel_key", k) if k else float("inf")
    return scored.withColumn("selected", F.coalesce(F.col("gumbel_key") >= cut, F.lit(False)))
