"""Language identification by error-correcting output codes over hashed byte n-grams."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from codesieve.llm.common import summed_vectors

BUCKETS = 1 << 13
UNKNOWN = "und"
_BLOCK = 1 << 20  # bytes of a text looked at together


def has_letter(text: str) -> bool:
    return next(filter(str.isalpha, text), None) is not None


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket gets a run of 2 or 3 bytes of the whole lower-cased text, a space at either end."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(raw), _BLOCK):
        b = raw[start:start + _BLOCK + 2].astype(np.uint32)
        two = (b[:-1] << np.uint32(8) | b[1:])
        three = two[:-1] << np.uint32(8) | b[2:]
        for grams, salt in ((two[:_BLOCK], 0x51ED), (three[:_BLOCK], 0)):
            hashed = (grams + np.uint32(salt << 16)) * np.uint32(2654435761)
            counts += np.bincount(hashed >> np.uint32(32 - 13), minlength=BUCKETS)
    return counts


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """One row of +1 and -1 per class. Up to 7 classes: every way to part them in two; beyond, the best of 64 seeded random
    codes of 10 bits for each doubling of the classes, measured by the smallest distance of two rows."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        columns = [c for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]
        return np.array([(1, *c) for c in columns]).T.astype(float)
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    tried = [rng.choice((-1.0, 1.0), (n, width)) for _ in range(64)]
    return max(tried, key=lambda c: (width - (c @ c.T - 2 * width * np.eye(n)).max()) / 2)


class Model:
    """Binary classifiers, one per bit of the codewords, and the decoding."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if len(languages) else counts
        weights, used = [], []
        for bit in self.code.T:
            w = np.log(share[bit > 0].mean(axis=0)) - np.log(share[bit < 0].mean(axis=0))
            margins = share @ w  # of a typical text of each language
            middle = (margins[bit > 0].min() + margins[bit < 0].max()) / 2
            scale = np.abs(margins - middle).mean()
            weights.append((w - middle) / max(scale, 1e-9))
            used.append(scale)
        self.weights = np.array(weights).T.reshape(BUCKETS, -1)
        # a bit whose two sides lie far apart is trusted more
        self.trust = np.array(used) / max(np.mean(used), 1e-9) if used else np.zeros(0)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        counts = gram_counts(text)
        margins = counts @ self.weights / max(counts.sum(), 1)
        losses = np.log1p(np.exp(np.clip(-2 * self.code * margins, -50, 50))) @ self.trust
        order = np.argsort(losses, kind="stable")
        best, second = order[:2]
        score = 1 / np.exp(losses[best] - losses).sum()
        return self.languages[best], float(score), bool(losses[second] - losses[best] < 0.1)


def train(rows: DataFrame) -> Model:
    """Learn from all of ``rows(lang, text)``; rows with a null in either teach nothing."""
    sums = summed_vectors(rows, "lang", gram_counts, BUCKETS)
    languages = sorted(sums)
    return Model(languages, np.array([sums[x] for x in languages]).reshape(-1, BUCKETS))


def predict(spark, model: Model, text: Column) -> Column:
    """A struct of ``lang`` (``und`` for null, for texts without a letter, and if nothing was learned), ``score`` (0 to 1)
    and ``ambiguous``: two languages fit about as well."""
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers a bit

    @pandas_udf("lang string, score double, ambiguous boolean")
    def decide(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score", "ambiguous"])

    return decide(text)


def identify(docs: DataFrame, training: DataFrame) -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` and ``ambiguous``, learned from ``training(lang, text)``.

    Whole texts are read, of any length. Null texts and texts without a letter are ``und``, score 0, ambiguous. With a single
    learned language every text with a letter gets it. Ties go to the first language by code point and are ambiguous.
    Repeated rows get the same answer; empty tables give empty results; columns of the three names are replaced, others
    pass through and are never looked at.
    """
    found = predict(docs.sparkSession, train(training), F.col("text"))
    out = docs.drop("lang_pred", "score", "ambiguous").withColumn("__found", found)
    return out.withColumns({"lang_pred": F.col("__found.lang"), "score": F.col("__found.score"), "ambiguous": F.col("__found.ambiguous")}).drop("__found")
