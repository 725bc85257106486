"""Rules as data: a table of any number of patterns, joined to the lines that may match them.

A pattern names literals of which every match holds one. A window of such a literal, its anchor, is the rule's key: two, four or
eight bytes as a number. A line's keys are those of its own windows that are anchors of some rule; which ones may be, a bitmap of fixed size
tells. So a line is read once, however many rules there are, and meets the rules that share a key with it in a join. Only there the patterns
themselves are tried, by the JVM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesieve.rules.literals import FOLDED, needed_literals

_BITS = 1 << 22  # cells of the bitmap, whatever the number of rules
_WIDTHS = (8, 4, 2)  # bytes of a window
_EVERY = 0  # the key of rules without a usable literal: every line has it

_LOWER = np.array([FOLDED.get(b, b) for b in range(256)], np.uint8)
_FOREIGN = {c: l for c, l in FOLDED.items() if c > 255}
_FOREIGN_BYTES = [chr(c).encode() for c in _FOREIGN]


def anchors(pattern: str | None) -> list[int]:
    """The keys of a pattern; a line that matches has one of them at least."""
    keys = {_anchor(literal.encode()) for literal in needed_literals(pattern or "")}
    return [_EVERY] if _EVERY in keys or not keys else sorted(keys)


def _anchor(literal: bytes) -> int:
    width = next((w for w in _WIDTHS if len(literal) >= w), None)
    # literals of one kind more often begin than end alike
    return _EVERY if width is None else int.from_bytes(literal[-width:], "little", signed=True)


def _cells(keys: np.ndarray) -> np.ndarray:
    x = keys.view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - (_BITS.bit_length() - 1))).astype(np.int64)


def _windows(text: np.ndarray, width: int) -> np.ndarray:
    """Each window of ``width`` bytes as a little-endian number."""
    out, had = text.astype(np.uint64), 1
    while had < width and len(out) > had:
        out = out[:-had] | (out[had:] << np.uint64(8 * had))
        had *= 2
    return out if had == width else out[:0]


def line_keys(lines: pa.Array, bits: np.ndarray) -> pa.Array:
    """For each line its keys that the bitmap lets through, as a list; null for a null."""
    if not len(lines):
        return pa.array([], pa.list_(pa.int64()))
    ends, text = _bytes_of(lines)
    together = text.tobytes()
    if any(letter in together for letter in _FOREIGN_BYTES):
        lines = pa.array([None if x is None else x.translate(_FOREIGN) for x in lines.to_pylist()], pa.string())
        ends, text = _bytes_of(lines)
    text = _LOWER[text]
    rows, keys = [], []
    if bits[_cells(np.array([_EVERY], np.int64))[0]]:
        rows.append(np.arange(len(lines))), keys.append(np.full(len(lines), _EVERY, np.int64))
    for width in _WIDTHS:
        own = _windows(text, width)
        if width < 8:
            own = _signed(own, width)
        own = own.view(np.int64)
        at = np.flatnonzero(bits[_cells(own)])
        row = np.searchsorted(ends, at, "right")
        inside = at + width <= ends[row]  # windows do not reach into the next line
        rows.append(row[inside]), keys.append(own[at[inside]])
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])]) if len(row) else np.empty(0, bool)
    row, key = row[fresh], key[fresh]
    starts = np.searchsorted(row, np.arange(len(lines) + 1))
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(key, pa.int64()), mask=lines.is_null())


def _signed(windows: np.ndarray, width: int) -> np.ndarray:
    """Windows of fewer than eight bytes as signed numbers, as :func:`_anchor` writes them."""
    top = np.uint64(1 << (8 * width - 1))
    return (windows ^ top) - top


def _bytes_of(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each line ends in the bytes of all lines, and these."""
    large = pa.types.is_large_string(lines.type)
    _, offsets, data = lines.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[lines.offset:lines.offset + len(lines) + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(offsets) else np.empty(0, np.uint8)
    return offsets[1:] - offsets[0], text


def scan_with_rule_table(lines: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Rules as data: ``rule_table(rule_id, language, pattern, ...)``; language null means every language.

    One row per line of ``lines(line, language, ...)`` and matching row of the table, with the columns of both (of the table without its
    language). Ids may repeat; a null pattern matches nothing, nor does anything match a null line. A pattern that is none fails where it is tried.

    The table is never gathered: its anchors are joined to those of the lines, and Spark decides by its size how. What a line costs
    depends on the rules that share an anchor with it; a pattern without two literal characters in a row is tried on every line of its language.
    """
    spark = lines.sparkSession

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def anchors_of(patterns: pd.Series) -> pd.Series:
        return patterns.map(anchors)

    rules = rule_table.filter("pattern IS NOT NULL").select(F.struct("*").alias("rule"), anchors_of("pattern").alias("anchors"))
    rules = rules.select("rule", "anchors", F.posexplode("anchors").alias("nth", "key"))
    @F.pandas_udf(T.LongType())
    def cell_of(keys: pd.Series) -> pd.Series:
        return pd.Series(_cells(keys.to_numpy(np.int64)))

    # what goes to the tasks has a fixed size: a cell for each anchor, 64 of them a row
    cell = F.col("cell")
    words = rules.select(cell_of("key").alias("cell")).groupBy(F.shiftright(cell, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toPandas()
    bits = np.zeros((_BITS // 64, 64), bool)
    bits[words["word"].to_numpy(np.int64)] = np.unpackbits(words["bits"].to_numpy("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    shared = spark.sparkContext.broadcast(bits.ravel())

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def keys_of(text: pa.Array) -> pa.Array:
        return line_keys(text, shared.value)

    found = lines.select(F.struct("*").alias("row"), keys_of("line").alias("keys"))
    found = found.select("row", "keys", F.explode("keys").alias("key")).join(rules, "key")
    language, wanted = F.col("row.language"), F.col("rule.language")
    # a line that has several anchors of a rule meets it at the first one
    first = ~F.arrays_overlap(F.slice("anchors", F.lit(1), F.col("nth")), "keys")
    hits = found.filter((wanted.isNull() | (wanted == language)) & first).filter(F.rlike(F.col("row.line"), F.col("rule.pattern")))
    return hits.select("row.*", *[F.col("rule")[c].alias(c) for c in rule_table.columns if c != "language"])
