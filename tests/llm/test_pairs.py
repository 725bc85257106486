"""Near duplicates, lines, tilings, components and top-k beside brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesieve.llm import lines as line_module
from codesieve.llm.components import components
from codesieve.llm.forest import near_duplicates, shingle_set, signature
from codesieve.llm.lines import dedupe_lines, line_decisions
from codesieve.llm.tiling import decontaminate, tile
from codesieve.llm.topk import quantised, top_k

from tests.llm.conftest import prose


class Union(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(5)
    ids = [rng.randint(-2**63, 2**63 - 1) for _ in range(600)]
    pairs = [(ids[i], ids[i + 1]) for i in range(299)] + [(rng.choice(ids[300:]), rng.choice(ids[300:])) for _ in range(150)]
    pairs += [(ids[0], ids[0]), pairs[0], pairs[0]] + [(ids[599], i) for i in ids[400:500]]
    u = Union()
    for a, b in pairs:
        u.join(a, b)
    want = {x: u.root(x) for p in pairs for x in p if p[0] != p[1]}
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    for df in (links, links.repartition(50)):
        rows = components(df).collect()
        assert len(rows) == len(want) and {r.node: r.component for r in rows} == want
    assert components(links.limit(0)).count() == 0
    assert components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).count() == 0


def test_components_of_many_tasks(spark, monkeypatch):
    """As many links as several tasks get: a long way, a hot node, and pieces."""
    from codesieve.llm import components as module

    monkeypatch.setattr(module, "_LINKS", 40)
    rng = random.Random(6)
    ids = rng.sample(range(-10**6, 10**6), 500)
    pairs = [(ids[i], ids[i + 1]) for i in range(199)] + [(ids[300], i) for i in ids[301:400]] + [(rng.choice(ids[400:]), rng.choice(ids[400:])) for _ in range(60)]
    u = Union()
    for a, b in pairs:
        u.join(a, b)
    rows = components(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(12)).collect()
    want = {x: u.root(x) for p in pairs for x in p if p[0] != p[1]}
    assert len(rows) == len(want) and {r.node: r.component for r in rows} == want


def brute_near(rows, width, percent):
    """{row number: (number of shingles, component's smallest id)}"""
    sets = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    u = Union()
    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if common and 100 * common >= percent * len(x | sets[j]):
                u.join(i, j)
    smallest = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[u.root(i)].append(doc_id)
    return [(len(x), min(smallest[u.root(i)], default=None)) for i, x in enumerate(sets)]


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates(spark, awkward, table):
    rng = random.Random(7)
    rows = [(r[0], r[1]) for r in awkward]
    for g in range(40):  # families around the threshold, some in chains
        text = prose(100 + g, rng.choice([12, 60, 200]))
        for _ in range(rng.choice([1, 3, 12])):
            text = edited(rng, text, rng.randint(0, 6)) if rng.random() < 0.5 else text
            rows.append((1000 + len(rows), text if rng.random() < 0.8 else edited(rng, text, 3)))
    more = [(*r, "ka", "a") for r in rows]
    for width, percent in ((3, 85), (5, 80)):
        want = brute_near(rows, width, percent)
        found = near_duplicates(table(more), width, percent).collect()
        assert len(found) == len(rows)
        of = lambda d, n, c, k: (str(d), n, str(c), k)
        assert sorted(of(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == sorted(of(d, n, c, d == c) for (d, _), (n, c) in zip(rows, want, strict=True))
    assert near_duplicates(table(awkward).limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    """A family in which most pairs are not similar, but each has a similar one: one component, whatever its size."""
    rng, rows = random.Random(9), []
    text = prose(77, 150)
    for i in range(400):
        text = edited(rng, text, 1)
        rows.append((i, text))
    want = brute_near(rows, 3, 85)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    found = {r.doc_id: r.component_id for r in near_duplicates(docs, 3, 85).collect()}
    assert found == {i: c for (i, _), (_, c) in zip(rows, want, strict=True)}


def test_near_copies_below_the_similarity(spark, monkeypatch):
    """Copies of one text, each with words of its own: all share most shingles, hardly any two are similar. Few pairs
    are looked at, of the 28680 that there are."""
    from codesieve.llm import forest

    rng, rows = random.Random(10), []
    base = prose(78, 150).split()
    for i in range(240):
        text = list(base)
        for at in rng.sample(range(2, 148), 3):
            text[at] = f"w{i}x{at}"
        rows.append((i, " ".join(text)))
    looked_at, confirmed = [], forest.confirmed
    monkeypatch.setattr(forest, "confirmed", lambda pairs, *rest: (looked_at.append(pairs.count()), confirmed(pairs, *rest))[1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    found = {r.doc_id: r.component_id for r in near_duplicates(docs, 3, 85).collect()}
    want = brute_near(rows, 3, 85)
    assert found == {i: c for (i, _), (_, c) in zip(rows, want, strict=True)} and len(set(found.values())) > 100
    assert sum(looked_at) < len(rows) ** 2 / 15


def test_signatures():
    a = shingle_set(prose(1, 400), 3)
    assert len(a) == len(np.unique(a)) and np.array_equal(signature(a, 72), signature(a[::-1].copy(), 72))
    long = np.arange(5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert np.array_equal(signature(long, 9), np.minimum(signature(long[:2600], 9), signature(long[2600:], 9)))


def brute_lines(rows, width=8, percent=80):
    """For each row, the numbers of the lines dropped; rows that agree in id and text share one place."""
    places, shingles, u = {}, {}, Union()
    for doc_id, text in rows:
        for n, raw in enumerate((text or "").split("\n")):
            if own := raw.strip().lower():
                places.setdefault(own, set()).add((doc_id is None, doc_id or 0, 0 if doc_id is not None else text, n))
                shingles[own] = {own[i:i + width] for i in range(len(own) - width + 1)} or {own}
    known = list(shingles)
    for i, x in enumerate(known):
        for y in known[:i]:
            a, b = shingles[x], shingles[y]
            if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                if min(len(x), len(y)) >= width:
                    u.join(x, y)
    first = defaultdict(list)
    for own, where in places.items():
        first[u.root(own)] += where
    first = {k: min(v) for k, v in first.items()}
    out = []
    for doc_id, text in rows:
        gone = []
        for n, raw in enumerate((text or "").split("\n")):
            if own := raw.strip().lower():
                if first[u.root(own)] != (doc_id is None, doc_id or 0, 0 if doc_id is not None else text, n):
                    gone.append(n)
        out.append(gone)
    return out


def test_lines(spark, awkward, table):
    rng = random.Random(3)
    rows = [(r[0], r[1]) for r in awkward if r[0] != 30] + [(30, prose(2, 900))]
    pool = [prose(500 + i, 10) for i in range(60)] + ["All rights reserved.", "short", "a"]
    for i in range(150):
        own = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(pool)
            if rng.random() < 0.3 and len(line) > 20:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice(["", "q", " and "]) + line[at + 1:]
            own.append(line.upper() if rng.random() < 0.2 else f"  {line}\t" if rng.random() < 0.2 else line)
        rows.append((2000 + i, "\n".join(own)))
    want = brute_lines(rows)
    docs = table([(*r, "ka", "a") for r in rows]).repartition(5)
    found = line_decisions(docs).collect()
    assert sorted((str(r.doc_id), str(r.text), r.dropped or []) for r in found) == sorted((str(d), str(t), w) for (d, t), w in zip(rows, want, strict=True))
    shorter = dedupe_lines(docs).collect()
    expected = sorted((str(d), str(t if not w else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in set(w))), len(w)) for (d, t), w in zip(rows, want, strict=True))
    assert sorted((str(r.doc_id), str(r.text), r.n_dropped) for r in shorter) == expected
    assert line_decisions(docs.limit(0)).count() == 0


def test_template_lines(spark):
    """Lines of one template crowd the same keys: each is similar to one other only, and has many neighbours that are not."""
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(105))
    own = []
    for i in range(200):
        code = "".join(chr(0x4E00 + 5 * i + j) for j in range(5))
        line = f"x{base[:50]}{code}{base[50:]}x"
        own += [line, f"{line[:90]}{chr(0x6000 + i)}{line[91:]}"]
    rng.shuffle(own)
    rows = [(i, "\n".join(own[i * 8:i * 8 + 8])) for i in range(50)]
    want = brute_lines(rows)
    assert sum(map(len, want)) == 200
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert {r.doc_id: r.dropped or [] for r in line_decisions(docs).collect()} == {i: w for (i, _), w in zip(rows, want, strict=True)}


def test_line_shingles():
    own = ["abcdefghij", "ab", "x" * 100, "ünï çödé 中文字符测试 \U0001f600 end"]
    for line in own:
        n = max(len(line) - 7, 1)
        assert len(line_module.shingles(line)) == len({line[i:i + 8] for i in range(n)})
    together = line_module.band_keys(own)
    assert all(np.array_equal(together[i], line_module.band_keys([x])[0]) for i, x in enumerate(own))


def brute_tile(text, passage, least):
    marked_text, marked_passage, tiles = set(), set(), []
    while True:
        best = None
        for p in range(len(passage)):
            for t in range(len(text)):
                k = 0
                while p + k < len(passage) and t + k < len(text) and passage[p + k] == text[t + k] and p + k not in marked_passage and t + k not in marked_text:
                    k += 1
                if k >= least and (best is None or k > best[2]):
                    best = (t, p, k)
        if best is None:
            return sorted(tiles)
        t, p, k = best
        tiles.append(best)
        marked_text |= set(range(t, t + k))
        marked_passage |= set(range(p, p + k))


def test_tiles():
    rng = random.Random(4)
    for _ in range(150):
        letters = rng.choice([2, 4, 30])
        text = np.array([rng.randrange(letters) for _ in range(rng.randint(0, 40))], np.uint64)
        passage = np.array([rng.randrange(letters) for _ in range(rng.randint(1, 25))], np.uint64)
        least = rng.randint(1, 5)
        got = sorted(tile(text, passage, least))
        want = brute_tile(text.tolist(), passage.tolist(), least)
        assert sorted(k for *_, k in got) == sorted(k for *_, k in want)
        for t, p, k in got:
            assert np.array_equal(text[t:t + k], passage[p:p + k])


def test_decontamination(spark, awkward, table):
    passages = [(1, prose(900, 40)), (2, prose(901, 24)), (2, prose(901, 24)), (3, "too short"), (4, None), (None, prose(902, 30)), (5, "")]
    one, two = passages[0][1].split(), passages[1][1].split()
    planted = [
        (101, prose(950, 50) + " " + " ".join(one) + " " + prose(951, 50)),  # whole
        (102, " ".join(one[20:] + ["and", "so"] + one[:20]).upper() + "!"),  # in another order and case
        (103, " ".join(one[:18])),  # less than half
        (104, " - ".join([" ".join(one[:22]), prose(952, 3), ", ".join(two)])),  # two passages
        (105, " ".join(one[:4] + ["x"] + one[4:8] + ["x"] + one[8:12])),  # pieces too short
        (106, passages[5][1]), (107, "too short"),
    ]
    rows = awkward + [(*p, "ka", "a") for p in planted]
    benchmark = spark.createDataFrame(passages, "item_id bigint, text string")
    found = decontaminate(table(rows), benchmark).collect()
    assert len(found) == len(rows)
    bad = {r.doc_id: (r.item_ids, r.coverage) for r in found if r.contaminated}
    assert {k: v[0] for k, v in bad.items()} == {101: [1], 102: [1], 104: [1, 2], 106: [], 107: [3]} and bad[101][1] == 1.0 and bad[104][1] == 1.0
    assert decontaminate(table(rows), benchmark.limit(0)).filter("contaminated").count() == 0
    assert decontaminate(table(rows).limit(0), benchmark).count() == 0


def test_short_passages_and_scripts_without_spaces(spark, table):
    chinese, thai = "今天的天气很好我们去公园散步吧", "วันนี้อากาศดีมากไปเดินเล่นกัน"
    passages = [(1, "the answer is blue"), (2, "Yes."), (3, chinese), (4, thai), (5, "北京"), (6, "!?"), (7, "mixed 中文字 text")]
    docs = {
        1: ("the answer is blue", [1]), 2: (prose(1, 20) + "\n  - The ANSWER is blue!\nmore", [1]), 3: ("I say the answer is blue today", []), 4: ("yes\nno", [2]),
        5: ("yes and no", []), 6: (f"昨天他说：“{chinese}。”然后走了", [3]), 7: (chinese[:6] + "完全不同的一句话", []), 8: (f"x {thai} y", [4]), 9: ("北京", [5]),
        10: ("我在北京住", []), 11: (chinese[8:] + "。" + chinese[:8], [3]), 12: ("he said: mixed 中文字 text, it is", [7]), 13: ("", []), 14: ("answer the is blue", []),
    }
    found = decontaminate(table([(k, t, "ka", "a") for k, (t, _) in docs.items()]), spark.createDataFrame(passages, "item_id bigint, text string")).collect()
    assert {r.doc_id: r.item_ids or [] for r in found} == {k: ids for k, (_, ids) in docs.items()}
    assert all(r.contaminated == bool(r.item_ids) and (r.coverage is not None) == r.contaminated for r in found)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in rng.standard_normal(12)]) for i in range(400)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(60)]  # one common vector
    vectors += [(50, vectors[50][1]), (7, vectors[7][1])]  # repeated rows
    vectors += [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (None, vectors[0][1]),
                (3000, [1.0, 2.0]), (3001, [2.0, 2.0]), (3050, []), (4000, [1e16] * 12)]
    table = spark.createDataFrame([(*v, "q") for v in vectors], "vec_id bigint, embedding array<double>, score string")
    rows = table.select("vec_id", quantised(F.col("embedding")).alias("v"), "score")
    want = []
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in {(i, tuple(v)) for i, v in usable if i % 50 == 0}:
        scored = sorted((-max(min(sum(a * b for a, b in zip(v, w, strict=True)), 2**63 - 1), -2**63), i) for i, w in usable if i != q and len(w) == len(v))
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:5], 1)]
    for size in (16384, 64):
        got = top_k(rows, F.col("vec_id") % 50 == 0, block=size, query_block=5, pivots=4).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert top_k(rows.limit(0), F.lit(True)).count() == 0
    assert top_k(rows, F.lit(False)).count() == 0


def test_pivots_rule_out():
    """Rows far from the query are never scored: clusters, of which the query's holds the best ones."""
    from codesieve.llm import topk

    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (20, 16))
    block = np.concatenate([c + rng.integers(-5, 5, (500, 16)) for c in centres])
    # equal norms, so that the score falls with the distance
    norms = (block.astype(float) ** 2).sum(axis=1)
    pivots = centres.astype(float)
    table = np.stack([np.linalg.norm(block - p, axis=1) for p in pivots], axis=1)
    q = centres[np.argmax((centres.astype(float) ** 2).sum(axis=1))].astype(np.int64)
    scored = []
    original = topk.exact_scores
    topk.exact_scores = lambda b, x: (scored.append(len(b)), original(b, x))[1]
    try:
        scores, ids = topk.best_of_block(q, np.linalg.norm(pivots - q, axis=1), np.zeros(len(block), bool), np.arange(len(block)), block, table, norms, 5)
    finally:
        topk.exact_scores = original
    exact = block.astype(np.int64) @ q
    assert list(ids) == sorted(range(len(block)), key=lambda i: (-exact[i], i))[:5] and sum(scored) < len(block) / 2


@pytest.mark.parametrize("n", [0, 1])
def test_no_rows_in_a_bucket(n):
    keys = np.arange(n, dtype=np.uint64)
    a, b, k, i = line_module._in_bands(keys, keys)
    assert len(a) == len(b) == 0 and len(k) == len(i) == n


def test_template_lines_of_several_texts(spark):
    """A family of lines made from several texts: copies of each with words of their own, most of them below the similarity, and lines between the texts.
    Links are whole, and few of the 10224 pairs of copies of a text are looked at."""
    from codesieve.llm import forest

    rng = random.Random(12)
    texts = [prose(600 + i, 30).replace("\n", " ").split() for i in range(4)]
    own = []
    for i in range(4):
        for k in range(72):
            line = list(texts[i])
            for at in rng.sample(range(3, 27), rng.choice([1, 2, 3, 3])):
                line[at] = f"w{i}x{k}x{at}"
            own += [" ".join(line)]
        own += [" ".join(texts[i][:15] + texts[(i + 1) % 4][15:])]
    rng.shuffle(own)
    lines = spark.createDataFrame([(n, x) for n, x in enumerate(own)], "set_id bigint, shingles string").repartition(3)
    seen, similar = [], {}
    sets = [set(line_module.shingles(x).tolist()) for x in own]
    for i, x in enumerate(sets):
        for j in range(i):
            similar[j, i] = 100 * len(x & sets[j]) >= 80 * len(x | sets[j])

    def confirm(pairs):
        found = [(r.a, r.b) for r in pairs.collect()]
        seen.extend(found)
        return spark.createDataFrame([p for p in found if similar[p]], "a bigint, b bigint")

    known = Union()
    for i, j in rng.sample(sorted(p for p, yes in similar.items() if yes), 30):
        known.join(i, j)
    families = spark.createDataFrame([(n, 7, known.root(n)) for n in range(len(own))], "node bigint, family bigint, part bigint")
    read = lambda some: list(map(line_module._shingle_sets(some, 8).__getitem__, some))
    links = [(r.a, r.b) for r in forest.links_between(families, lines, 80, confirm, read).collect()]
    assert all(similar[min(p), max(p)] for p in links)
    want = Union(known)
    for (i, j), yes in similar.items():
        if yes:
            want.join(i, j)
    for a, b in links:
        known.join(a, b)
    assert [known.root(n) for n in range(len(own))] == [want.root(n) for n in range(len(own))]
    assert len({want.root(n) for n in range(len(own))}) > 20
    assert len(seen) < 1000 and not any(want.root(i) == want.root(j) and known.root(i) != known.root(j) for i, j in seen)


def test_links_of_small_families(spark, monkeypatch):
    """All pairs of a family are compared where it stands, whatever batches and pieces it is read in."""
    from codesieve.llm import forest

    monkeypatch.setattr(forest, "_COUNTED", 1 << 10)
    rng = np.random.default_rng(21)
    rows, want = [], Union()
    for family, size in enumerate([1, 2, 2, 3, 7, 40, forest.TOGETHER, 1, 5] + [2] * 600):
        base, sets = rng.integers(0, 2**63, 60).astype(np.uint64), []
        for _ in range(size):
            own = base.copy()
            at = rng.choice(60, rng.integers(0, 12), replace=False)
            own[at] = rng.integers(0, 2**63, len(at))
            sets.append(np.unique(own))
            rows.append((family, len(rows), bytearray(sets[-1].tobytes())))
        for i in range(size):
            for j in range(i):
                shared = len(np.intersect1d(sets[i], sets[j]))
                if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                    want.join(len(rows) - size + i, len(rows) - size + j)
    table = spark.createDataFrame(rows, "family bigint, node bigint, shingles binary").repartition(5)
    links, found = [(r.a, r.b) for r in forest.links_together(table, 80).collect()], Union()
    for a, b in links:
        found.join(a, b)
    assert [found.root(n) for n in range(len(rows))] == [want.root(n) for n in range(len(rows))]
    assert len(links) == len(rows) - len({want.root(n) for n in range(len(rows))})
    assert forest.links_together(table.limit(0), 80).count() == 0


def test_small_families_move_once(spark, monkeypatch):
    """No pair of a small family is looked up in the table of sets."""
    from codesieve.llm import forest

    looked_at, confirmed = [], forest.confirmed
    monkeypatch.setattr(forest, "confirmed", lambda pairs, *rest: (looked_at.append(pairs.count()), confirmed(pairs, *rest))[1])
    rng, base, rows = random.Random(5), prose(77, 200).split(), []
    for i in range(40):
        own = list(base)
        for at in rng.sample(range(10, 190, 9), rng.randint(3, 7)):
            own[at] = f"w{at}"
        rows.append((i, " ".join(own)))
    found = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()}
    assert [found[i] for i in range(40)] == [c for _, c in brute_near(rows, 3, 85)] and len(set(found.values())) < 40 and sum(looked_at) == 0


def test_line_dedup_moves_no_texts(spark, tmp_path):
    """The query joins decisions to ids and line counts, not to texts."""
    from codesieve.llm import lines_query

    spark.createDataFrame([(1, "a line of text\nanother line"), (2, "a line of text"), (3, None), (4, "")], "doc_id bigint, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    found = lines_query.query(spark, str(tmp_path))
    assert [tuple(r) for r in found.orderBy("doc_id").collect()] == [(1, 2, 2, None), (2, 1, 0, [0]), (3, 0, 0, None), (4, 1, 1, None)]
    plan = found._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    assert not any(plan.output().apply(i).name() == "text" for i in range(plan.output().size()))


def test_shingles_are_dealt_in_few_rows():
    """What a large family asks for travels packed, a row for each batch and bucket; shingles that many hold are dealt out, and no pair is lost."""
    from types import SimpleNamespace

    import pandas as pd

    from codesieve.llm import forest

    rng, percent = random.Random(12), 80
    core = [rng.getrandbits(63) for _ in range(60)]
    sets = [np.array(sorted({*rng.sample(core, rng.randint(45, 60)), *(rng.getrandbits(63) for _ in range(rng.randint(0, 9)))}), np.uint64) for _ in range(90)]
    sizes = np.array([len(x) for x in sets])
    excess = (100 + percent) * sizes - (100 - percent) * sizes  # told from an empty centre
    rows = pd.DataFrame({
        "family": 7, "node": np.arange(90), "part": np.arange(90) // 2, "home": True, "excess": excess, "lost": sizes * (100 - percent) // 100,
        "delta": [x.tobytes() for x in sets], "middle": np.arange(90) < 10, "of_all": excess.min(), "of_asked": excess[10:].min()})
    common = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    similar = 100 * common >= percent * (sizes[:, None] + sizes - common)
    want = {(i, j) for i, j in zip(*np.nonzero(similar), strict=True) if i < j and j >= 10 and i // 2 != j // 2}
    assert len(want) > 50
    frequencies = SimpleNamespace(value=np.bincount(forest._cells(np.concatenate(sets)), minlength=forest._CELLS))
    found = []
    for hot in (1 << 13, 16, 1):
        dealt = list(forest._prefixes(frequencies, percent, 3, hot)([rows.iloc[:50], rows.iloc[50:], rows.iloc[:0]]))
        assert [len(x) for x in dealt] == [3, 3, 0]
        pairs = [forest._asking_pairs(percent)(group) for _, group in pd.concat(dealt).groupby("bucket")]
        found.append({(r.a, r.b) for part in pairs for r in part.itertuples()})
    assert found[0] == found[1] == found[2] >= want
    assert all(i // 2 != j // 2 and j >= 10 for i, j in found[0])
