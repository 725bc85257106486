"""Mixing against its definition; chat texts and their spans, read back."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codesieve.llm.chat import PART_TYPE, PartVisitor, format_conversations, read_loss, read_turns
from codesieve.llm.mixing import mix, repeated
from codesieve.llm.mixing_query import word_count


def fill(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    """Capped shares, by rounds."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(sizes), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not over:
            target.update({s: weight[s] * level for s in free})
            break
        target.update({s: most * sizes[s] for s in over})
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return target


def check_mix(rows):
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    want = fill(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] * 2
    return sizes


def test_mix(spark, awkward, table):
    docs = table(awkward).withColumn("size", word_count(F.col("text")))
    rows = mix(docs).collect()
    assert len(rows) == len(awkward)
    assert {r.doc_id: r.size for r in rows}[22] == 0 and {r.doc_id: r.size for r in rows}[41] == 2
    assert [r.size for r in rows if r.text] == [len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows if r.text]
    check_mix(rows)
    assert sorted(map(str, mix(docs.repartition(3)).collect())) == sorted(map(str, rows))
    assert mix(docs.limit(0)).count() == 0
    assert set(docs.columns) <= set(mix(docs).columns)


def test_mix_of_many(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), (F.col("id") % 50).alias("size"))
    mixed = mix(docs)
    sizes = check_mix(mixed.collect())
    assert len(sizes) == 8
    assert repeated(mixed).count() == mixed.agg(F.sum("copies")).first()[0]
    other = mix(docs, seed=18)
    assert other.agg(F.sum("taken")).first()[0] == pytest.approx(sum(sizes.values()), rel=0.01)
    assert other.join(mixed.select("doc_id", F.col("taken").alias("t")), "doc_id").filter("t <> taken").count() > 100


CONTROLS = ["<|turn|>user\n", "<|end|>\n", "\\s", "\\l", "\\n", "\\", "<", "<<", "|", "<|image:1|>", "\\\\<|", ""]


def turns(spark, rows):
    """rows: (conv_id, turn, role, [(kind, text, ref, units)])"""
    return spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{PART_TYPE}>")


def test_round_trip(spark):
    rows, n = [], 0
    for a in CONTROLS:
        for b in CONTROLS:
            rows += [(n, 0, "user", [("text", a, None, None), ("text", b, None, None)]), (n, 1, "assistant", [("text", b + a, None, None)]), (n, 2, "a\n\\n<", [("text", a, None, None)])]
            n += 1
    done = format_conversations(turns(spark, rows)).withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    for r in done.collect():
        mine = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(role, "".join(p[1] for p in parts)) for _, _, role, parts in mine]
        assert r.loss == mine[1][3][0][1] and r.n_turns == 3
        raw = r.formatted.encode()
        assert r.formatted.count("<|end|>") == 3 and "".join(raw[s.start:s.start + s.length].decode() for s in r.loss_spans).count("<") == 0


def test_parts_and_edges(spark):
    rows = [
        (1, 1, "assistant", [("text", "see é ", None, None), ("image", None, "a.png", 4), ("text", " and ", None, None), ("audio", "x", "b.wav", None)]),
        (1, 0, "user", [("document", None, "c.pdf", -1), (None, "plain", None, None), ("video", "film", None, None)]),
        (1, 2, "assistant", None), (1, 3, None, []), (None, 0, "user", [("text", None, None, None)]), (2, None, "user", [("text", "b", None, None)]),
        (2, None, "user", [("text", "b", None, None)]), (2, None, "user", [("text", "a", None, None)]), (3, 0, "assistant", [("text", "long " * 100000, None, None)]),
    ]
    done = {r.conv_id: r for r in format_conversations(turns(spark, rows).withColumn("formatted", F.lit(1))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    one = done[1]
    assert one.formatted == (
        "<|turn|>user\n<|document:1|>plainfilm<|end|>\n<|turn|>assistant\nsee é <|image:2|> and <|audio:3|><|end|>\n<|turn|>assistant\n<|end|>\n<|turn|>\n<|end|>\n")
    assert [(a.number, a.kind, a.ref, a.tokens) for a in one.attachments] == [(1, "document", "c.pdf", 0), (2, "image", "a.png", 1024), (3, "audio", "b.wav", 25)]
    assert one.expanded_tokens == 1049 and one.loss == "see é  and " and one.n_turns == 4
    assert done[2].formatted == "".join(f"<|turn|>user\n{x}<|end|>\n" for x in "abb")
    assert done[None].n_turns == 1 and done[3].loss == "long " * 100000
    assert format_conversations(turns(spark, rows).limit(0)).count() == 0
    few = PartVisitor({"image": 10})
    assert {r.conv_id: r.expanded_tokens for r in format_conversations(turns(spark, rows), few).collect()}[1] == 40


def test_chat_query(spark):
    from codesieve.llm.chat_query import TRICKY, query

    row = query(spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    assert row.n_turns == 2 and row.loss_chars == len(TRICKY)
    assert row.turns_sha256 == hashlib.sha256(f"user\n{TRICKY}\nassistant\n{TRICKY}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(TRICKY.encode()).hexdigest()
