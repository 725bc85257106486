from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, at int, digest string, size string, kept string, dropped string, score string, copy string, bucket int"


def prose(seed: int, n: int) -> str:
    """Words of no language, in lines of some ten."""
    rng = random.Random(seed)
    made = ["".join(rng.choice(["ka", "lo", "mi", "ren", "su", "ta", "vor", "ze"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return "\n".join(" ".join(made[i:i + 10]) for i in range(0, n, 10))


@pytest.fixture(scope="session")
def awkward():
    """Rows that documents may hold: (doc_id, text, lang, source)."""
    base, long = prose(1, 300), prose(2, 30000)
    near = base.replace(base.split()[150], "other", 1)
    return [
        (10, base, "ka", "a"), (11, base, "ka", None), (12, near, "ka", "b"), (12, near, "ka", "b"), (9, near + " end", None, "b"),
        (20, None, "ka", "a"), (21, "", None, "a"), (22, " \t\n\r\x0b\x0c ", "ka", ""), (23, "!!! 12 ?", "ka", "b"),
        (30, long, "lo", "c"), (31, "x" * 50000, "lo", "c"), (None, prose(3, 80), "lo", "c"), (None, None, None, None), (40, "one", "ka", "a"),
        (41, "one two", "ka", "a"), (42, "ONE two", "ka", "a"), (50, prose(4, 60) + "\nnaïve café 中文 \U0001f600 x y", "lo", "d"), (0, "-1 -1 -1 -1 -1 -1", "lo", "d"),
    ]


@pytest.fixture(scope="session")
def table(spark):
    """documents with more columns, named as operators name theirs."""

    def build(rows):
        return spark.createDataFrame([(*r, len(r[1] or ""), 1, "d", "s", "k", "x", "y", "z", 2) for r in rows], SCHEMA)

    return build
