"""Hard negatives from an inverted multi-index: two half-space codebooks form cells, which a heap visits in order of their bounds."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.common import stored
from codesieve.llm.topk import exact_scores

LEAST, MOST = -(2**63), 2**63 - 1
_TOGETHER = 64  # questions scored together


def _unpacked(vectors, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<i8").reshape(len(vectors), length)


def _halves(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = rows.shape[1] // 2
    return rows[:, :half], rows[:, half:]


def _nearest(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(axis=1) - 2 * rows @ words.T).argmin(axis=1)


def codebook(rows: np.ndarray, n: int, turns: int = 8) -> np.ndarray:
    """Up to n codewords of the rows, by k-means from n evenly spaced rows in the order of their first codes."""
    words = np.unique(rows, axis=0)
    words = words[np.linspace(0, len(words) - 1, min(n, len(words))).astype(int)]
    for _ in range(turns):
        near = _nearest(rows, words)
        sums = np.zeros_like(words)
        np.add.at(sums, near, rows)
        counts = np.bincount(near, minlength=len(words))[:, None]
        words = np.where(counts > 0, sums / np.maximum(counts, 1), words)
    return words


class Cells:
    """The cells of all vectors of one length: codeword of the first half times codeword of the second, numbered from ``first``. Of each cell: its rows, the
    largest distance of a row's half to its codeword (a radius a half), and the blocks that its rows are in."""

    def __init__(self, first: int, words: tuple[np.ndarray, np.ndarray]):
        self.first, self.words, self.shape = first, words, (len(words[0]), len(words[1]))
        self.size = self.shape[0] * self.shape[1]
        self.rows, self.block, self.splits = (np.zeros(self.size, np.int64) for _ in range(3))
        self.radii = np.zeros((2, self.size))

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's cell, and the distances of its halves to their codewords."""
        near, far = [], []
        for half, words in zip(_halves(rows.astype(np.float64)), self.words, strict=True):
            own = _nearest(half, words)
            near.append(own)
            far.append(np.linalg.norm(half - words[own], axis=1))
        return self.first + near[0] * self.shape[1] + near[1], *far

    def visits(self, question: np.ndarray):
        """All cells in falling order of the sum of two bounds, one of either half: (sum, cell, upper and lower bound of a score in it).

        A half's bound for a codeword is its inner product with the question, plus the question's length times the codeword's largest radius. Both lists
        are sorted; a heap holds the pairs of places that may come next.
        """
        q = [x[0] for x in _halves(question[None].astype(np.float64))]
        long = [float(np.linalg.norm(x)) for x in q]
        scores = [w @ x for w, x in zip(self.words, q, strict=True)]
        radii = [r.reshape(self.shape) for r in self.radii]
        size = sum(float(np.abs(w).max(initial=0) * np.abs(x).sum()) for w, x in zip(self.words, q, strict=True)) + sum(n * r.max() for n, r in zip(long, radii, strict=True))
        slack = 1 + 1e-9 * size  # for the rounding of all that follows
        most = [scores[0] + long[0] * radii[0].max(axis=1), scores[1] + long[1] * radii[1].max(axis=0)]
        order = [np.argsort(-m, kind="stable") for m in most]
        a, b = (m[o].tolist() for m, o in zip(most, order, strict=True))
        heap, seen = [(-(a[0] + b[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            first, second = order[0][i], order[1][j]
            middle = scores[0][first] + scores[1][second]
            around = long[0] * radii[0][first, second] + long[1] * radii[1][first, second] + slack
            yield slack - bound, int(first * self.shape[1] + second), middle + around, middle - around
            for i, j in ((i + 1, j), (i, j + 1)):  # noqa: B020, PLW2901
                if i < len(a) and j < len(b) and (i, j) not in seen:
                    seen.add((i, j))
                    heapq.heappush(heap, (-(a[i] + b[j]), i, j))


def next_cells(cells: Cells, question: np.ndarray, at: int, rows: int, windows: list[tuple[int, int]]) -> tuple[list[int], int, bool]:
    """The cells to visit after the first ``at`` of the order, until they hold ``rows`` rows; the place reached; whether all windows are certified: no
    later cell can hold a score of ``windows``, each (the least score that would still count, the largest)."""
    windows = [(low, high) for low, high in windows if low <= high]
    least = min((low for low, _ in windows), default=MOST + 1)
    out, held = [], 0
    for place, (bound, cell, upper, lower) in enumerate(cells.visits(question)):
        if bound < least:
            return out, place, True
        if place < at:
            continue
        if held >= rows:
            return out, place, False
        if cells.rows[cell] and any(upper >= low and lower <= high for low, high in windows):
            out.append(cell)
            held += cells.rows[cell]
    return out, cells.size, True


class MultiIndex:
    """An inverted multi-index over ``rows(vec_id, label, v)``, ``v`` an array of bigint.

    Codebooks of ``codewords`` words a half are fitted to ``sample`` rows of a seeded order (bounded; they only decide how much is
    ruled out). Every row is in the index: in the cell of its halves' nearest codewords, or, if its length is not in the sample, in cell 0, which is always
    visited. Cells are dealt out in blocks of some ``block`` rows; a larger cell has several blocks. The driver holds a row a cell.
    """

    def __init__(self, rows: DataFrame, codewords: int = 16, sample: int = 4096, block: int = 32768):
        spark = rows.sparkSession
        seen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
        by_length: dict[int, list] = {}
        for r in seen:
            by_length.setdefault(len(r["v"]), []).append(r["v"])
        self.cells: dict[int, Cells] = {}
        first = 1
        for n, own in sorted(by_length.items()):
            self.cells[n] = Cells(first, tuple(codebook(h, codewords) for h in _halves(np.array(own, np.float64).reshape(len(own), n))))
            first += self.cells[n].size
        known = self.cells

        def assign(batches):
            for batch in batches:
                vectors = batch.column("v")
                lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
                ends = np.cumsum(lengths)
                flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("<i8")
                cell, radii = np.zeros(len(lengths), np.int64), np.zeros((2, len(lengths)))
                for n in np.unique(lengths):
                    if int(n) in known:
                        own = np.flatnonzero(lengths == n)
                        rows = flat[(ends[own] - n)[:, None] + np.arange(n)]
                        cell[own], radii[0, own], radii[1, own] = known[int(n)].of(rows)
                packed = [flat[e - n:e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), pa.array(packed, pa.binary()), pa.array(cell), pa.array(radii[0]), pa.array(radii[1])],
                    ["vec_id", "label", "vector", "cell", "far_first", "far_second"])

        indexed = rows.select("vec_id", F.col("label").cast("long").alias("label"), "v").mapInArrow(
            assign, "vec_id bigint, label bigint, vector binary, cell bigint, far_first double, far_second double")
        self.indexed = stored(indexed.withColumn("row", F.monotonically_increasing_id()), "multi-index")
        counted = self.indexed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far_first").alias("r1"), F.max("far_second").alias("r2")).orderBy("cell").collect()
        of = {c: (cells, c - cells.first) for cells in self.cells.values() for c in range(cells.first, cells.first + cells.size)}
        places, block_no, held = [], -1, block
        self.others: list[int] = []
        for r in counted:
            splits = -(-r["n"] // block)
            if r["cell"] == 0 or splits > 1 or held + r["n"] > block:
                block_no, held = block_no + 1, 0
            places.append((r["cell"], block_no, splits))
            if r["cell"] == 0:
                self.others = list(range(block_no, block_no + splits))
            else:
                cells, own = of[r["cell"]]
                cells.rows[own], cells.block[own], cells.splits[own] = r["n"], block_no, splits
                cells.radii[:, own] = r["r1"], r["r2"]
            block_no, held = block_no + splits - 1, block if splits > 1 or r["cell"] == 0 else held + r["n"]
        # a row a cell: its size is bounded by the codebooks
        table = F.broadcast(spark.createDataFrame(places, "cell bigint, block bigint, splits bigint"))
        self.blocks = self.indexed.join(table, "cell").select(
            "vec_id", "label", "vector", "cell", (F.col("block") + F.pmod("row", "splits")).alias("block"))

    def _plan(self, rows: int):
        """For each question its next cells by block, its place in the order, and whether all windows are certified."""
        cells, others = self.cells, self.others

        def run(batches):
            for batch in batches:
                out = []
                for vector, at, low, high in zip(batch["vector"], batch["at"], batch["low"], batch["high"], strict=True):
                    question = np.frombuffer(vector, "<i8")
                    blocks: dict[int, list[int]] = {}
                    place, certified = 0, True
                    if len(question) in cells:
                        own = cells[len(question)]
                        found, place, certified = next_cells(own, question, int(at), rows, list(zip(map(int, low), map(int, high), strict=True)))
                        for c in found:
                            for block in range(own.block[c], own.block[c] + own.splits[c]):
                                blocks.setdefault(int(block), []).append(own.first + c)
                    elif any(a <= b for a, b in zip(low, high, strict=True)):
                        blocks = {b: [0] for b in others}
                    out.append(([{"block": b, "cells": c} for b, c in blocks.items()], place, certified))
                yield pd.DataFrame({"ask": batch["ask"], "blocks": [x[0] for x in out], "at": [x[1] for x in out], "certified": [x[2] for x in out]})

        return run

    def search(self, asked: DataFrame, k: int, same: bool, rows: int = 4096, growth: int = 8, ask_block: int = 8192) -> DataFrame:
        """For each window of ``asked(ask, own, label, vector, low, high)`` (arrays of scores, both ends included) the k best rows: (ask, window, vec_id, score), higher
        scores first, ties to the smaller vec_id. Rows have the label (``same``) or another one, not the vec_id ``own``, and the question's length.

        In each round a question visits its next cells, ``rows`` rows at first, ``growth`` times as many each time; the k-th score of
        a window is handed on and rules out later cells. A question ends when all of its windows are certified. Blocks of rows meet blocks of questions.
        """
        asked = stored(asked, "mining-questions")
        groups = max(1, -(-asked.count() // ask_block))
        state = asked.withColumns({"at": F.lit(0).cast("long"), "needed": F.col("low")})
        order = Window.partitionBy("ask", "window").orderBy(F.desc("score"), "vec_id")
        best = None
        while True:
            open_ = state.select("ask", "vector", "at", F.col("needed").alias("low"), "high")
            plan = stored(open_.mapInPandas(self._plan(rows), "ask bigint, blocks array<struct<block: bigint, cells: array<bigint>>>, at bigint, certified boolean"), "mining-plan")
            wanted = plan.select("ask", F.explode("blocks").alias("to")).select("ask", "to.block", "to.cells", F.pmod(F.xxhash64("ask"), F.lit(groups)).alias("group"))
            questions = wanted.join(state.select("ask", "own", F.col("label").alias("of"), "vector", "needed", "high"), "ask")
            there = self.blocks.join(wanted.select("block", "group").distinct(), "block").withColumnsRenamed({"block": "block_no", "group": "group_no"})
            found = questions.groupBy("block", "group").cogroup(there.groupBy("block_no", "group_no")).applyInPandas(_search(k, same), "ask bigint, window int, vec_id bigint, score bigint")
            found = found if best is None else found.union(best)
            best = stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"), "mining-best")
            left = plan.filter("NOT certified").select("ask", "at")
            if left.isEmpty():
                return best
            full = best.groupBy("ask", "window").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k)
            kths = full.groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("kths"))
            needed = F.transform("low", lambda low, i: F.greatest(low, F.coalesce(F.try_element_at("kths", i), low)))
            state = asked.join(left, "ask").join(kths, "ask", "left").withColumn("needed", needed).drop("kths")
            rows *= growth


def _search(k: int, same: bool):
    """Scores of a block of questions against a block of rows; of each window the k best rows of this block."""

    def best_of(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if len(scores) > 4 * k:
            near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[-k])
            return near[np.lexsort((ids[near], np.invert(scores[near])))[:k]]
        return np.lexsort((ids, np.invert(scores)))[:k]

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [[], [], [], []]
        lengths, asked_lengths = c["vector"].map(len).to_numpy(), q["vector"].map(len).to_numpy()
        for n in np.unique(asked_lengths):
            rows, asked = c[lengths == n], q[asked_lengths == n]
            if not len(rows):
                continue
            ids, labels, cells = (rows[x].to_numpy() for x in ("vec_id", "label", "cell"))
            block = _unpacked(rows["vector"].to_list(), n // 8)
            as_doubles, most = block.astype(np.float64), float(np.abs(block).max(initial=0))
            numbers, cell_of = np.unique(cells, return_inverse=True)
            for at in range(0, len(asked), _TOGETHER):
                part = asked.iloc[at:at + _TOGETHER]
                vectors = _unpacked(part["vector"].to_list(), n // 8)
                if most * float(np.abs(vectors).max(initial=0)) * max(n // 8, 1) < 2.0**53:  # no sum of products is rounded
                    all_scores = (as_doubles @ vectors.T.astype(np.float64)).astype(np.int64).T
                else:
                    all_scores = [exact_scores(block, v) for v in vectors]
                for scores, ask, own, of, visited, low, high in zip(
                        all_scores, part["ask"], part["own"], part["of"], part["cells"], part["needed"], part["high"], strict=True):
                    fits = np.isin(numbers, visited)[cell_of] & ((labels == of) == same) & (ids != own)
                    fits = np.flatnonzero(fits)
                    there, names = scores[fits], ids[fits]
                    for window, (a, b) in enumerate(zip(low, high, strict=True)):
                        hit = np.flatnonzero((there >= a) & (there <= b))
                        hit = hit[best_of(there[hit], names[hit])]
                        out[0] += [ask] * len(hit)
                        out[1] += [window] * len(hit)
                        out[2] += names[hit].tolist()
                        out[3] += there[hit].tolist()
        return pd.DataFrame(dict(zip(["ask", "window", "vec_id", "score"], out, strict=True)), dtype="int64").astype({"window": "int32"})

    return run


def hard_negatives(
        vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, lower: int = 80, upper: int = 100, **index) -> DataFrame:
    """For each anchor of ``vectors(vec_id, label, v)`` and each of its ``positives``, the first ``negatives`` rows of another label whose score is from ``lower`` to
    ``upper`` percent of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the integer inner product with the anchor; higher scores come first, ties by vec_id. An anchor's positives are its
    best other rows of the same label. Both are searches in one :class:`MultiIndex`, exact: cells are left out only where bounds show that
    they hold nothing that counts.

    Defined cases: rows with a null vec_id, label or v take no part; vectors of different lengths are never compared; rows with the anchor's vec_id are
    never its positives or negatives; repeated rows are rows each, a repeated anchor (same id, label and vector) is asked once; a positive with a score below zero
    has an empty window for percentages as given; scores past 64 bits saturate. No anchors, positives or rows give no rows. Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<bigint>").alias("v"), is_anchor.alias("asked"))
    rows = stored(rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL"), "mining-rows")
    multi = MultiIndex(rows.select("vec_id", "label", "v"), **index)

    def packed(batches):
        for batch in batches:
            yield batch.assign(vector=[np.asarray(v, "<i8").tobytes() for v in batch["v"]]).drop(columns="v")

    anchors = rows.filter("asked").dropDuplicates(["vec_id", "label", "v"]).select(F.col("vec_id").alias("own"), "label", "v")
    anchors = stored(anchors.mapInPandas(packed, "own bigint, label bigint, vector binary").withColumn("ask", F.monotonically_increasing_id()), "mining-anchors")
    bound = lambda x: F.array(F.lit(x).cast("long"))
    nearest = multi.search(anchors.withColumns({"low": bound(LEAST), "high": bound(MOST)}), positives, same=True)
    ranked = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))
    wide = F.col("score").cast("decimal(38,0)")
    ends = {
        "low": F.ceil(wide * lower / 100).cast("decimal(38,0)"), "high": F.floor(wide * upper / 100).cast("decimal(38,0)")}
    ends = {name: F.least(F.greatest(end, F.lit(LEAST).cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long") for name, end in ends.items()}
    found = nearest.select("ask", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (ranked - 1).alias("window"), *[e.alias(n) for n, e in ends.items()])
    found = stored(found, "mining-positives")
    windows = found.groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("window", "low", "high"))).alias("w")).select("ask", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    closest = multi.search(anchors.join(windows, "ask"), negatives, same=False)
    out = closest.join(found, ["ask", "window"]).join(anchors.select("ask", F.col("own").alias("anchor_id")), "ask")
    order = Window.partitionBy("ask", "window").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
