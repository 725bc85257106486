from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from codesieve.llm.packing import VOCABULARY, Packer, encoder, pack

TOKENIZER = Tokenizer.from_file(VOCABULARY)


def reference_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def check(pieces, texts, size=1024):
    """Every document's ids once each, sequences gapless and free of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        by_doc[p["doc_id"]].append((p["start"], ids, p["doc_tokens"]))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == size or at < size and at & (at - 1) == 0
    assert by_doc.keys() == texts.keys()
    for doc_id, copies in texts.items():
        ids = reference_ids(copies[0])
        held = np.zeros(len(ids), int)
        for start, part, n in by_doc[doc_id]:
            assert n == len(ids) and part == ids[start:start + len(part)]
            held[start:start + len(part)] += 1
        assert (held == len(copies)).all()
    return by_sequence


def test_pieces_are_the_documents(spark, awkward, table):
    rows = [r for r in awkward if r[0] is not None] + [(60, "a <|endoftext|> b<|endoftext|>", "ka", "a"), (None, None, None, None)]
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1])
    for parts in (1, 3):
        check(pack(table(rows).repartition(parts)).collect(), texts)
    assert pack(table(rows).limit(0)).collect() == []
    with pytest.raises(ValueError):
        pack(table(rows), size=1000)


def test_small_windows_and_reruns(spark, awkward, table):
    rows = [r for r in awkward if r[0] is not None and r[0] != 30]
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1])
    packed = pack(table(rows).coalesce(2), size=16, most_open=3)
    assert sorted(packed.collect()) == sorted(packed.collect())
    check(packed.collect(), texts, 16)


def test_ids_are_the_library_s():
    encode, rng = encoder(open(VOCABULARY, encoding="utf-8").read()), random.Random(5)
    alphabet = "ab Z19'st.,\n\t\r\x0b\x00\xa0 é中文\U0001f600̀﻿Åٔ١ǅ"
    texts = ["", "x" * 20000, "<|endoftext|>", "it's  we'LL\n\n  x ", *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(3000))]
    for text in texts:
        assert encode.ids(text).tolist() == reference_ids(text)[:-1]


def brute_level(counts: dict[int, int], length: int, size: int) -> int:
    """The level that gives the least sum of squares, the fullest of several."""
    best = None
    for level in range(size - length + 1):
        if level and not counts.get(level):
            continue
        after = dict(counts)
        if level:
            after[level] -= 1
        if level + length < size:
            after[level + length] = after.get(level + length, 0) + 1
        key = (sum(n * n for n in after.values()), -level)
        best = min(best, (key, level)) if best else (key, level)
    return best[1]


def test_placement_against_brute_force():
    rng, packer = random.Random(1), Packer(64, 10**9)
    for n in range(1500):
        length = rng.choice([rng.randint(1, 63), 40, 24, 8])
        counts = {h: int(c) for h, c in enumerate(packer.counts) if c}
        assert packer.level_for(length) == brute_level(counts, length, 64)
        packer.add(n, np.zeros(length, np.uint32))
        assert packer.counts[1:64].tolist() == [len(packer.open[h]) for h in range(1, 64)]


def test_open_windows_are_bounded_and_cuts_are_few():
    rng, packer = random.Random(2), Packer(1024, 64)
    most = total = 0
    for n in range(4000):  # no two fit into one window
        length = rng.randint(520, 1000)
        total += length
        packer.add(n, np.zeros(length, np.uint32))
        most = max(most, packer.n_open)
    assert most <= 64
    packer.end()
    sizes = [sum(len(ids) for _, _, ids in w) for w in packer.done]
    assert sum(sizes) == total and all(s == 1024 or s & (s - 1) == 0 for s in sizes)
    assert sum(s < 1024 for s in sizes) <= 10 and packer.n_open == 0

    packer = Packer()
    for n in range(20000):
        packer.add(n, np.zeros(rng.randint(1, 1023), np.uint32))
    packer.end()
    assert sum(map(len, packer.done)) < 20000 * 1.15  # only windows that are open at the end are cut, some two a level
