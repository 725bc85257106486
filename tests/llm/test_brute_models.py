"""Resampling and language identification beside versions in plain Python, gram by gram."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from codesieve.llm.langid import identify
from codesieve.llm.resampling import resample

from tests.llm.conftest import prose

M64 = (1 << 64) - 1


def mixed(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def word_grams(text: str | None) -> list[int]:
    """Buckets of the words and pairs of words of a text."""
    lowered = re.sub(r"[A-Z]", lambda m: m.group().lower(), text or "")
    hashes = [xxhash.xxh3_64_intdigest(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", lowered)]
    pairs = [mixed((mixed(a) * 0x9E3779B97F4A7C15 + b) & M64) for a, b in itertools.pairwise(hashes)]
    return [x >> 48 for x in [*map(mixed, hashes), *pairs]]


def test_importance_and_sample(spark):
    rows = [(i, prose(i, 30 + 7 * i) if i % 9 else prose(i, 20).upper()) for i in range(60)]
    rows += [(60, None), (61, " \n"), (62, "one"), (63, "One one ONE"), (63, "One one ONE"), (None, "no id at all"), (64, "中文 é \U0001f600")]
    targets, share = list(range(0, 64, 3)), 0.4
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, kept string").repartition(3)
    found = resample(docs, spark.createDataFrame([(t,) for t in [*targets, targets[0], 999]], "doc_id bigint"), share).collect()

    target, raw = Counter(), Counter()
    for doc_id, text in rows:
        raw.update(word_grams(text))
        if doc_id in targets:
            target.update(word_grams(text))
    size = 1 << 16

    def weight(bucket):
        return math.log((target[bucket] + 1) / (target.total() + size)) - math.log((raw[bucket] + 1) / (raw.total() + size))

    # the seeded noise is Spark's hash of key and text
    noise = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64(F.lit(5), "doc_id", "text").alias("h")).collect()}
    keys = {}
    for doc_id, text in rows:
        if grams := word_grams(text):
            ratio = sum(map(weight, grams)) / len(grams)
            uniform = ((noise[doc_id, text] % (1 << 64) >> 11) + 0.5) / (1 << 53)
            keys.setdefault((doc_id, text), []).append((ratio, 256 * ratio - math.log(-math.log(uniform))))
    every = sorted((k for own in keys.values() for _, k in own), reverse=True)
    cut = every[round(share * len(every)) - 1]
    by_id = {doc_id: (doc_id, text) for doc_id, text in rows}
    assert len(found) == len(rows)
    for r in found:
        own = keys.get(by_id[r.doc_id])
        if own is None:
            assert r.log_ratio is None and not r.selected
        else:
            assert (r.log_ratio, r.gumbel_key) == pytest.approx(own[0], abs=1e-8)
            assert r.selected == (r.gumbel_key >= cut - 1e-7)


def byte_grams(text: str) -> list[int]:
    """Buckets of the runs of two and three bytes of a text."""
    raw = f" {text.lower()} ".encode()
    two = [(raw[i] << 8 | raw[i + 1]) + (0x51ED << 16) for i in range(len(raw) - 1)]
    three = [raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)]
    return [(g * 2654435761 % (1 << 32)) >> 19 for g in two + three]


def brute_language(training: list[tuple[str, str]], text: str | None) -> tuple[str, float]:
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, learned in training:
        if lang is not None and learned is not None:
            counts[lang].update(byte_grams(learned))
    if text is None or not any(c.isalpha() for c in text) or not counts:
        return "und", 0.0
    names, size = sorted(counts), 1 << 13
    share = {n: [(counts[n][b] + 0.5) / (counts[n].total() + 0.5 * size) for b in range(size)] for n in names}
    own = Counter(byte_grams(text))
    losses, scales, margins = [0.0] * len(names), [], []
    codes = [(1, *rest) for rest in itertools.product((1, -1), repeat=len(names) - 1)]  # the first class is on the plus side
    for code in codes:
        if -1 not in code:
            continue
        plus, minus = ([n for n, c in zip(names, code, strict=True) if c == side] for side in (1, -1))
        w = [math.log(sum(share[n][b] for n in plus) / len(plus)) - math.log(sum(share[n][b] for n in minus) / len(minus)) for b in range(size)]
        typical = {n: sum(x * y for x, y in zip(share[n], w, strict=True)) for n in names}
        middle = (min(typical[n] for n in plus) + max(typical[n] for n in minus)) / 2
        scales.append(sum(abs(typical[n] - middle) for n in names) / len(names))
        margins.append((code, sum(n * (w[b] - middle) for b, n in own.items()) / scales[-1] / own.total()))
    mean = sum(scales) / len(scales)
    for scale, (code, margin) in zip(scales, margins, strict=True):
        for i, c in enumerate(code):
            losses[i] += scale / mean * math.log1p(math.exp(-2 * c * margin))
    best = min(range(len(names)), key=lambda i: (losses[i], i))
    return names[best], 1 / sum(math.exp(losses[best] - x) for x in losses)


def test_codes_and_decoding(spark):
    words = {"ka": "kala mata sata pala", "en": "the and of water", "zu": "ngi uku zwe lwa", "ru": "вода и небо дом"}
    rng_rows = [(lang, " ".join(w[(i * 7 + j * 3) % 4:] + w[: j % 3] for j, w in enumerate(text.split() * 4))) for i in range(6) for lang, text in words.items()]
    training = [*rng_rows, (None, "ignored text"), ("en", None)]
    texts = [t for _, t in rng_rows[:8]] + ["water", "KALA the", "вода and", "ngi 12", None, "", "12 !", "é"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string").repartition(2)
    found = {r.doc_id: (r.lang_pred, r.score) for r in identify(df, spark.createDataFrame(training, "lang string, text string")).collect()}
    for i, text in enumerate(texts):
        lang, score = brute_language(training, text)
        assert found[i][0] == lang and found[i][1] == pytest.approx(score, abs=1e-9)
