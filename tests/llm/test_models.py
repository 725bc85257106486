"""Token trees, language identification, resampling and language-model scores."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from codesieve.llm import attention, lm, token_trees
from codesieve.llm.langid import UNKNOWN, Model, codewords, gram_counts, identify, train
from codesieve.llm.lm import score_texts
from codesieve.llm.resampling import _kth_largest, log_ratios, resample
from codesieve.llm.token_trees import TokenCounter, TokenTree, apply_edits, count_tokens, leaves

from tests.llm.conftest import prose

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def encode():
    with open(token_trees.VOCABULARY, "rb") as f:
        return token_trees.encoding(f.read(), token_trees.PATTERN)


def test_trees_count_as_the_whole_text(encode):
    rng = random.Random(1)
    letters = "ab c  \n\t'st're 12é.,!\x1c\x85  中\U0001f600"
    for trial in range(600):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 60, 400, 2000])))
        if trial % 3 == 0:
            text = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 400)))
        tree = TokenTree(encode, leaves(text, rng.choice([3, 20, 128])))
        for _ in range(5):
            assert (tree.chars[1], tree.tokens[1]) == (len(text), len(encode.encode_ordinary(text)))
            half = len(tree.chars) // 2
            assert all((sums[1:half] == sums[2:2 * half:2] + sums[3:2 * half:2]).all() for sums in (tree.chars, tree.tokens))
            start = rng.randint(-2, len(text) + 2)
            stop = start + rng.choice([-1, 0, 0, 1, 5, 50, 700])
            new = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 30, 900])))
            a = min(max(start, 0), len(text))
            text = text[:a] + new + text[min(max(stop, a), len(text)):]
            tree = TokenTree.load(encode, tree.text, tree.chars, tree.tokens)
            tree.edit(start, stop, new)
            assert tree.text == text


def test_an_edit_encodes_little(encode):
    text = prose(5, 20000).replace("\n", " ")
    tree = TokenTree(encode, leaves(text))
    assert tree.encoded == len(text)
    tree.encoded = 0
    tree.edit(50000, 50010, "new words ")
    assert 0 < tree.encoded < 1000 and tree.tokens[1] == len(encode.encode_ordinary(tree.text))


def test_counts_and_edits(spark, awkward, table, encode):
    counter = TokenCounter(spark)
    docs = table(awkward).withColumn("tree", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    counted = count_tokens(docs, counter)
    rows = counted.collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(encode.encode_ordinary(r[1] or "")) for r in awkward) and set(docs.columns) <= set(counted.columns)
    edits = spark.createDataFrame([
        (10, 2, 0, 3, "XY"), (10, 1, 5, 9, ""), (30, 1, 100, 2000, "z"), (20, 1, 0, 9, "was null"), (None, 1, 0, 1, "no"), (777, 1, 0, 1, "no"), (40, None, None, None, None),
    ], "doc_id bigint, seq int, start bigint, stop bigint, text string")
    edited = apply_edits(counted, edits, counter)
    for r in edited.collect():
        old = next(x[1] for x in awkward if x[0] == r.doc_id)
        want = old
        if r.doc_id == 10:
            want = old[:5] + old[9:]
            want = "XY" + want[3:]
        elif r.doc_id == 30:
            want = old[:100] + "z" + old[2000:]
        elif r.doc_id == 20:
            want = "was null"
        assert r.doc_id is None or r.text == want
        assert r.n_tokens == len(encode.encode_ordinary(r.text or "")) == r.tree.tokens[1]
    assert count_tokens(docs.limit(0), counter).count() == 0
    with pytest.raises(ValueError):
        TokenCounter(spark, most_bytes=10)


def test_token_query(spark, encode):
    from codesieve.llm.token_trees_query import query

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in query(spark, SF).collect():
        text = texts[r.doc_id] or ""
        n = len(text)
        assert (r.n_chars, r.n_tokens) == (n, len(encode.encode_ordinary(text)))
        text = text[:n // 4] + " (see note 12) " + text[n // 4:]
        text = text[:n // 2] + text[n // 2 + 40:]
        text = text[:max(0, n - 35)] + " the end.\n" + text[n:] if n <= len(text) else text[:max(0, n - 35)] + " the end.\n"
        assert (r.edited_chars, r.edited_tokens) == (len(text), len(encode.encode_ordinary(text)))


def test_codewords():
    assert codewords(4).shape == (4, 7) and codewords(1).shape == (1, 0) and codewords(0).shape == (0, 0)
    for n in (2, 3, 5, 7, 12, 40):
        code = codewords(n)
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert apart >= (2 ** (n - 2) if n <= 7 else code.shape[1] // 4)
    # decoding stands a classifier that is always wrong
    rng = np.random.default_rng(0)
    model = Model(list("abcd"), rng.integers(0, 50, (4, 1 << 13)))
    share = (rng.random(1 << 13) < 0.5)
    assert model.weights.shape == (1 << 13, 7) and share.any()


def test_gram_counts():
    text = "Ab é " * 3
    raw = f" {text.lower()} ".encode()
    assert gram_counts(text).sum() == 2 * len(raw) - 3
    long = "xyz " * 600000
    assert gram_counts(long).sum() == 2 * (len(long) + 2) - 3


def test_langid_edges(spark, awkward, table):
    docs = table(awkward)
    found = {(r.doc_id, r.text): r for r in identify(docs.withColumn("lang_pred", F.lit("x")), docs).collect()}
    assert len(found) == len(set((r[0], r[1]) for r in awkward))
    for (doc_id, text), r in found.items():
        if text is None or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.ambiguous) == (UNKNOWN, True) and r.score == 0
        else:
            assert r.lang_pred in ("ka", "lo") and 0 <= r.score <= 1
    assert identify(docs, docs.limit(0)).filter(f"lang_pred <> '{UNKNOWN}'").count() == 0
    only = identify(docs, docs.filter("lang = 'ka'")).filter("text rlike '[a-z]'").select("lang_pred", "score").distinct().collect()
    assert [(r.lang_pred, r.score) for r in only] == [("ka", 1.0)]
    assert identify(docs.limit(0), docs).count() == 0
    assert train(docs.limit(0)).languages == []


def test_langid_on_held_out(spark):
    from codesieve.llm.langid_query import query

    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = query(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != UNKNOWN]
    assert len(held) > 100 and np.mean([langs[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_kth_largest(spark):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) ** 5 for _ in range(9000)] + [0.25] * 6000 + [1e12, -1e12]
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 3000, 9000, 12000, len(values)):
        assert _kth_largest(rows, "v", k) == ordered[k - 1]


def test_resampling_edges(spark, awkward, table):
    docs = table(awkward)
    targets = spark.createDataFrame([(30,), (30,), (None,), (99,)], "doc_id bigint")
    rows = resample(docs.withColumn("selected", F.lit(1)), targets, 0.5).collect()
    assert len(rows) == len(awkward)
    empty = [r for r in rows if r.log_ratio is None]
    assert len(empty) == 4 and not any(r.selected for r in empty)
    able = sorted((r.gumbel_key for r in rows if r.log_ratio is not None), reverse=True)
    cut = able[round(0.5 * len(able)) - 1]
    assert all(r.selected == (r.gumbel_key >= cut) for r in rows if r.log_ratio is not None)
    assert resample(docs, targets, 0.0).filter("selected").count() == 0
    assert resample(docs, targets, 1.0).filter("selected").count() == len(able)
    assert resample(docs, targets.limit(0), 0.5).filter("selected").count() > 0
    assert resample(docs.limit(0), targets, 0.5).count() == 0
    assert not np.isnan(log_ratios(docs.select("doc_id", "text"), targets)).any()


def test_resampling_prefers_the_target(spark):
    from codesieve.llm.resampling_query import query

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == 1000
    kept = {q: np.mean([r.kept for r in rows if labels.get(r.doc_id) == q]) for q in (0, 1)}
    assert kept[1] > 0.95 and kept[0] < 0.1


def test_resampling_on_held_out(spark):
    """Targets are half of the good documents; the other half is judged."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = resample(docs, labels.filter("quality = 1 AND crc32(cast(cast(doc_id AS string) AS binary)) % 2 = 0").select("doc_id"), 0.85)
    judged = rows.join(labels.filter("crc32(cast(cast(doc_id AS string) AS binary)) % 2 = 1"), "doc_id").collect()
    good, bad = ([r.log_ratio for r in judged if r.quality == q and r.log_ratio is not None] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


@pytest.fixture(scope="module")
def small_model():
    rng = np.random.default_rng(1)
    vocabulary = attention.Vocabulary(rng.integers(0, 100, 500), np.arange(500) % 2 == 0)
    return attention.initial(vocabulary), vocabulary


def test_each_token_is_scored_once_with_its_past(small_model):
    p, vocabulary = small_model
    rng = np.random.default_rng(2)
    for n in (1, 23, 24, 25, 48, 400):
        ids = rng.integers(0, 500, n)
        inputs, targets, mask = attention.windows(ids, 500)
        assert np.array_equal(targets[mask], ids) and mask.sum() == n
        values = attention.log_probabilities(p, vocabulary, inputs, targets)[mask[:, attention.CONTEXT:]]
        # one token at a time, from its window's past alone
        for t in range(0, n, 7):
            first = t // attention.STRIDE * attention.STRIDE - attention.CONTEXT
            past = np.array([500 if i < 0 else ids[i] for i in range(first - 1, t)])
            x = p["embedding"][past]
            q, k, v = x[-1] @ p["query"], x @ p["key"], x @ p["value"]
            scores = k @ q / math.sqrt(attention.WIDTH) + p["distance"][len(past) - 1 - np.arange(len(past))]
            share = np.exp(scores - scores.max())
            hidden = np.tanh(share / share.sum() @ v + x[-1] @ p["skip"] + p["hidden"])
            logits = hidden @ p["out"] + p["bias"]
            want = logits[vocabulary.classes[ids[t]]] - np.log(np.exp(logits - logits.max()).sum()) - logits.max() + vocabulary.in_class[ids[t]]
            assert values[t] == pytest.approx(want, abs=1e-3)


def test_probabilities_sum_to_one(small_model):
    p, vocabulary = small_model
    inputs = np.tile(np.random.default_rng(3).integers(0, 501, attention.WINDOW), (500, 1))
    targets = np.tile(np.arange(500)[:, None], (1, attention.WINDOW))
    total = np.exp(attention.log_probabilities(p, vocabulary, inputs, targets).astype(np.float64)).sum(axis=0)
    assert np.allclose(total, 1, atol=1e-4)


def test_gradients(small_model):
    p, vocabulary = small_model
    p = {k: v.astype(np.float64) for k, v in p.items()}
    rng = np.random.default_rng(4)
    inputs, targets, mask = attention.windows(rng.integers(0, 500, 60), 500)
    _, g, d_x = attention.gradients(p, vocabulary, inputs, targets, mask)
    for name in g:
        at = tuple(rng.integers(0, s) for s in p[name].shape)
        losses = []
        for step in (1e-5, -1e-5):
            moved = {k: v.copy() for k, v in p.items()}
            moved[name][at] += step
            losses.append(attention.gradients(moved, vocabulary, inputs, targets, mask)[0])
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(g[name][at], abs=1e-6)


def test_all_subwords_are_trained_on(encode, monkeypatch):
    """Each subword of each training text, and each text's end, is a target of one training step."""
    seen = Counter()
    monkeypatch.setattr(attention.Trainer, "step", lambda self, inputs, targets, mask: seen.update(targets[mask].tolist()))
    texts = ["", "one", "two three", prose(11, 200), prose(12, 3000), "the " * 140000, None]
    want = Counter(i for t in texts for w in (t or "").lower().encode().split() for i in encode._encode_single_piece(b" " + w))
    want[encode.n_vocab] = len(texts)
    with open(token_trees.VOCABULARY, "rb") as f:
        held = SimpleNamespace(value=f.read())
    vocabulary = attention.Vocabulary(np.ones(encode.n_vocab + 1, np.int64), np.arange(encode.n_vocab + 1) % 2 == 0)
    parameters = SimpleNamespace(value=attention.initial(vocabulary))
    monkeypatch.setattr(lm.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    list(lm._train_task(held, parameters, SimpleNamespace(value=vocabulary))([pd.DataFrame({"text": texts[:3]}), pd.DataFrame({"text": texts[3:]})]))
    assert seen == want


def test_training_reads_the_ids_of_the_first_pass(encode, monkeypatch):
    """The first pass cuts each training text into subwords once and keeps them; training sees the windows that the texts themselves give."""
    monkeypatch.setattr(lm, "_CACHE", 300)  # so that counts outlive the words they belong to
    monkeypatch.setattr(lm, "_UNIT_WORDS", 2000)
    monkeypatch.setattr(lm.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    texts = ["", "one", "two three", prose(11, 200), None, prose(12, 3000), "the " * 5000, prose(13, 900)]
    with open(token_trees.VOCABULARY, "rb") as f:
        held = SimpleNamespace(value=f.read())
    batches = [pd.DataFrame({"at": [(1 << 62) + n for n in range(k, k + 4)], "text": texts[k:k + 4]}) for k in (0, 4)]
    found = pd.concat(lm._learn(held, 3)(iter(batches)))
    kept, kind = found[found["kind"] == 2], lm._id_kind(lm.subwords(held.value))
    words = [(t or "").lower().encode().split() for t in texts]
    want = [[i for w in own for i in encode._encode_single_piece(b" " + w)] + [encode.n_vocab] for own in words]
    assert kept["at"].tolist() == [(1 << 62) + n for n in range(len(texts))] and [np.frombuffer(x, kind).tolist() for x in kept["ids"]] == want

    def counted(kind, key):
        out = Counter()
        for r in found[found["kind"] == kind].itertuples():
            out.update(dict(zip(np.frombuffer(r.a, key).tolist(), np.frombuffer(r.b, np.int64).tolist(), strict=True)))
        return out

    assert counted(1, np.int64) == Counter(i for ids in want for i in ids) and found[found["kind"] == 3]["n"].tolist() == [len(texts)]
    assert counted(0, np.uint64) == Counter(xxhash.xxh3_64_intdigest(w) for own in words for w in own)
    vocabulary = SimpleNamespace(value=attention.Vocabulary(np.ones(encode.n_vocab + 1, np.int64), np.arange(encode.n_vocab + 1) % 2 == 0))
    parameters, steps = SimpleNamespace(value=attention.initial(vocabulary.value)), []
    monkeypatch.setattr(attention.Trainer, "step", lambda self, *given: steps.append([x.tolist() for x in given]))
    for batch in (kept[["ids"]], pd.DataFrame({"text": texts})):
        list(lm._train_task(held, parameters, vocabulary)([batch]))
    assert steps[:len(steps) // 2] == steps[len(steps) // 2:] and steps


def test_steps_spend_nothing_on_positions_without_a_target(small_model):
    """Only scored positions have hidden values; a step changes the parameters as the gradients say."""
    p, vocabulary = small_model
    inputs, targets, mask = attention.windows(np.random.default_rng(6).integers(0, 500, 200), 500)
    assert attention._forward(p, inputs)[-1].shape == (len(inputs), attention.STRIDE, attention.WIDTH)
    loss, g, d_x = attention.gradients(p, vocabulary, inputs, targets, mask)
    assert loss == pytest.approx(-attention.log_probabilities(p, vocabulary, inputs, targets)[mask[:, attention.CONTEXT:]].mean()
                                 + vocabulary.in_class[targets[mask]].mean(), rel=1e-5)
    trainer = attention.Trainer(p, vocabulary)
    trainer.step(inputs, targets, mask)
    rows = np.zeros(p["embedding"].shape)
    np.add.at(rows, inputs.ravel(), d_x.reshape(-1, attention.WIDTH))
    for name, d in {**g, "embedding": rows}.items():
        assert np.allclose(trainer.p[name], p[name] - 0.3 * d / np.sqrt(1e-4 + d * d), atol=1e-4), name
    assert np.array_equal(trainer.used, np.bincount(inputs.ravel(), minlength=501))


def brute_base(rows):
    tokens = {i: (text or "").encode().lower().split() + [None] for i, (_, text, _) in enumerate(rows)}
    counts = Counter(t for i, (_, _, training) in enumerate(rows) if training for t in tokens[i])
    n, v = sum(counts.values()), len(counts)
    return {i: (len(t), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)) for i, t in tokens.items()}


def test_lm_edges(spark, awkward):
    rows = [(r[0], r[1], None if r[0] == 50 else r[0] is not None and r[0] % 3 != 0) for r in awkward] + [(None, "the " * 70000, True)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, training boolean, at int, unit string").repartition(3)
    found = score_texts(docs, F.col("training")).collect()
    want = brute_base(rows)
    key = lambda n, k, t, b: (n, k, t, round(b, 3))
    assert sorted(key(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found) == sorted(key(*w) for w in want.values())
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)
    none = score_texts(docs, F.lit(False)).collect()
    assert len(none) == len(rows) and {(r.n_known, r.train_tokens, r.base_score) for r in none} == {(0, 0, 0.0)}
    assert score_texts(docs.limit(0), F.lit(True)).count() == 0


def test_lm_on_held_out(spark):
    from codesieve.llm.lm_query import query

    texts = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {texts[i][0]: w for i, w in brute_base(texts).items()}
    rows = query(spark, SF).collect()
    for r in rows:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base)
    with open(token_trees.VOCABULARY, "rb") as f:
        encode = token_trees.encoding(f.read(), token_trees.PATTERN)
    ids = {i: [x for w in (t or "").encode().lower().split() for x in encode._encode_single_piece(b" " + w)] + [encode.n_vocab] for i, t, _ in texts}
    counts = np.bincount([x for i, _, training in texts if training for x in ids[i]], minlength=encode.n_vocab + 1) + 0.5
    unigram = np.log10(counts / counts.sum())
    held = [r for r in rows if r.held_out]
    # context helps: well above the subword frequencies alone
    assert sum(r.score for r in held) > 0.9 * sum(unigram[ids[r.doc_id]].sum() for r in held)
