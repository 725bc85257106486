"""Benchmark decontamination by greedy string tiling: how much of a test passage a document holds, in any order."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from codesieve.llm.common import bitmap, in_bitmap, shingle_hashes, stored, word_hashes

# Blocks of scripts that put no spaces between words.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_ASCII_TOKEN = re.compile(r"\w+")
_TOKEN = re.compile(rf"(?=\w)[{_UNSPACED}]|[^\W{_UNSPACED}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a whole text, without case and punctuation; in scripts without spaces, of the characters."""
    if not text:
        return np.empty(0, np.uint64)
    return word_hashes((_ASCII_TOKEN if text.isascii() else _TOKEN).findall(text.lower()))


def line_key(line: str, least: int) -> int | None:
    """One hash of all tokens of a line that has some, but fewer than ``least``."""
    found = [m.group() for m in itertools.islice(_TOKEN.finditer(line.lower()), least)]
    return int(shingle_hashes(word_hashes(found), len(found))[0].view(np.int64)) if 0 < len(found) < least else None


class _Windows:
    """Karp-Rabin hashes of the windows of a token sequence, for any window length."""

    def __init__(self, sequence: np.ndarray, marked: np.ndarray):
        self.n = len(sequence)
        self.marked = marked
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.n, _BASE)]), dtype=np.uint64)
        terms = sequence * self.power[:-1][::-1]  # falling powers, so that windows compare after one multiplication
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])

    def open_at(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows without a marked token, and their hashes."""
        if length > self.n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(self.marked)])
        starts = np.flatnonzero(taken[length:] == taken[:-length])
        # sums[s + length] - sums[s] holds the factor base ** (n - s - length); all get base ** n
        return starts, (self.sums[starts + length] - self.sums[starts]) * self.power[starts + length]


def tile(text: np.ndarray, passage: np.ndarray, least: int, gaps: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (start in text, start in passage, length): the longest match of unmarked tokens is marked on both sides, leftmost in
    the passage and then in the text first, until no match has ``least`` tokens. ``gaps`` are tokens of the text that match nothing.

    Whether a match of a length exists is asked with rolling hashes of all unmarked windows; that answer is monotone in the
    length, so a binary search finds the longest. Matches are compared token by token before they count.
    """
    marked_text = np.zeros(len(text), bool) if gaps is None else gaps.copy()
    marked_passage = np.zeros(len(passage), bool)
    # powers depend on the length of a sequence, so both get the same one
    n = max(len(text), len(passage))
    pad = lambda x, fill: np.concatenate([x, np.full(n - len(x), fill, x.dtype)])
    left = _Windows(pad(text, np.uint64(0)), pad(marked_text, True))
    right = _Windows(pad(passage, np.uint64(0)), pad(marked_passage, True))
    tiles = []
    most = min(len(text), len(passage))

    def shared(length):
        (a, ha), (b, hb) = left.open_at(length), right.open_at(length)
        return a, ha, b, hb, np.isin(hb, ha)

    while most >= least:
        low, high = least - 1, most
        while low < high:  # the longest length with a common open window
            middle = (low + high + 1) // 2
            if shared(middle)[4].any():
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        a, ha, b, hb, both = shared(low)
        order = np.argsort(ha, kind="stable")
        marked = False
        for start, h in zip(b[both], hb[both], strict=True):
            if right.marked[start:start + low].any():
                continue
            at = np.searchsorted(ha[order], h)
            while at < len(order) and ha[order[at]] == h:
                begin = a[order[at]]
                if not left.marked[begin:begin + low].any() and np.array_equal(text[begin:begin + low], passage[start:start + low]):
                    left.marked[begin:begin + low] = right.marked[start:start + low] = True
                    tiles.append((int(begin), int(start), low))
                    marked = True
                    break
                at += 1
        most = low if marked else low - 1
    return tiles


def _shared_runs(docs: DataFrame, bits, width: int) -> DataFrame:
    """For each text: the runs of tokens that may match a passage somewhere, with the hashes of their windows.

    Any match of ``width`` tokens or more lies inside one run: all its windows pass the filter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def scan(batches):
        for batch in batches:
            out = []
            for digest, text in zip(batch["digest"], batch["text"], strict=True):
                sequence = tokens(text)
                windows = shingle_hashes(sequence, width)
                hits = np.flatnonzero(in_bitmap(shared.value, windows)) if len(windows) else windows
                if len(hits):
                    for run, at in enumerate(np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1)):
                        out.append((digest, run, sequence[at[0]:at[-1] + width].view(np.int64), np.unique(windows[at]).view(np.int64)))
            yield pd.DataFrame(out, columns=["digest", "run", "sequence", "windows"])

    return docs.mapInPandas(scan, "digest string, run int, sequence array<bigint>, windows array<bigint>")


def _short_lines(docs: DataFrame, bits, least: int) -> DataFrame:
    """(digest, key) of the lines with fewer than ``least`` tokens that may be a passage."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def scan(batches):
        for batch in batches:
            out = []
            for digest, text in zip(batch["digest"], batch["text"], strict=True):
                keys = np.array(list({k for line in text.split("\n") if (k := line_key(line, least)) is not None}), np.int64)
                out += [(digest, k) for k in keys[in_bitmap(shared.value, keys)].tolist()]
            yield pd.DataFrame(out, columns=["digest", "key"])

    return docs.mapInPandas(scan, "digest string, key bigint")


@pandas_udf(T.DoubleType())
def _coverage(runs: pd.Series, passages: pd.Series, least: pd.Series) -> pd.Series:
    """Part of the passage's tokens that tiles mark."""
    out = []
    for pieces, passage, width in zip(runs, passages, least, strict=True):
        parts, gaps = [], []
        for piece in sorted(pieces, key=lambda x: x["run"]):  # a run, then a gap that no tile may span
            parts += [np.asarray(piece["sequence"], np.int64), np.zeros(1, np.int64)]
            gaps += [np.zeros(len(parts[-2]), bool), np.ones(1, bool)]
        passage = np.ascontiguousarray(passage, np.int64).view(np.uint64)
        tiles = tile(np.concatenate(parts).view(np.uint64), passage, int(width), np.concatenate(gaps))
        out.append(sum(length for _, _, length in tiles) / len(passage))
    return pd.Series(out, dtype=float)


def passage_hits(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5) -> DataFrame:
    """(digest, item_id, coverage) for each pair of a text of ``docs(digest, text)`` and a passage of ``benchmark(item_id, text)``
    where tiles of ``least`` tokens or more cover ``threshold`` of the passage, or a shorter passage is all of a line. A text is
    decided once, however often it occurs.

    Texts are read once. A bitmap of fixed size keeps what can't match out of the shuffles, a join on the window hashes finds
    the passages of the rest, and only the runs of tokens around matches travel, never whole texts.
    """
    spark = docs.sparkSession

    @pandas_udf("struct<tokens: array<bigint>, windows: array<bigint>, whole: bigint>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        found = [tokens(t) for t in texts]
        whole = [int(shingle_hashes(t, len(t))[0].view(np.int64)) if 0 < len(t) < least else None for t in found]
        return pd.DataFrame({
            "tokens": [t.view(np.int64) for t in found], "windows": [np.unique(shingle_hashes(t, least)).view(np.int64) for t in found],
            "whole": pd.Series(whole, dtype="Int64")})

    known = stored(benchmark.select("item_id", cut("text").alias("cut")).select("item_id", "cut.tokens", "cut.windows", "cut.whole").filter(
        F.size("tokens") > 0).dropDuplicates(["item_id", "tokens"]).withColumn("passage", F.xxhash64("item_id", "tokens")), "passages")
    passages, short = known.filter(F.size("windows") > 0), known.filter("whole IS NOT NULL").select("item_id", F.col("whole").alias("key"))
    seeds = passages.select("passage", F.explode("windows").alias("seed"))
    runs = stored(_shared_runs(docs, bitmap(seeds, "seed"), least).dropDuplicates(["digest", "run"]), "runs")
    matched = (
        runs.select("digest", "run", F.explode("windows").alias("seed")).join(seeds, "seed")
        .select("digest", "run", "passage").distinct())
    pieces = matched.join(runs.select("digest", "run", "sequence"), ["digest", "run"]).groupBy("digest", "passage").agg(
        F.collect_list(F.struct("run", "sequence")).alias("pieces"))
    tiled = (
        pieces.join(passages.select("passage", "item_id", "tokens"), "passage")
        .withColumn("coverage", _coverage("pieces", "tokens", F.lit(least)))
        .filter(F.col("coverage") >= threshold).select("digest", "item_id", "coverage"))
    if short.isEmpty():
        return tiled
    lines = _short_lines(docs, bitmap(short, "key"), least).distinct().join(short, "key")
    return tiled.union(lines.select("digest", "item_id", F.lit(1.0).alias("coverage")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5) -> DataFrame:
    """``docs`` plus ``coverage`` (the largest part of a passage found; null if none reaches ``threshold``), ``item_ids`` (the
    passages found, sorted) and ``contaminated``.

    Tokens are runs of word characters, without case. Reordered passages are found as long as pieces of ``least`` tokens stay
    together. In scripts without spaces every character is a token. A passage of fewer than ``least`` tokens, which running text may hold by chance, is found
    where its tokens are all of a line. Defined cases: null and empty texts are clean; passages without a token flag nothing; null or repeated item_ids are passages each; repeated documents are decided alike; with an empty
    benchmark all are clean. Columns of the three names are replaced, others pass through.
    """
    rows = docs.drop("coverage", "item_ids", "contaminated").withColumn("__digest", F.md5("text"))
    found = passage_hits(
        rows.filter("text IS NOT NULL").select(F.col("__digest").alias("digest"), "text"), benchmark, least, threshold)
    found = stored(found.groupBy(F.col("digest").alias("__digest")).agg(
        F.max("coverage").alias("coverage"), F.array_sort(F.collect_set("item_id")).alias("item_ids")), "contaminated")
    out = rows.join(found, "__digest", "left").drop("__digest")
    return out.withColumn("contaminated", F.col("coverage").isNotNull())
