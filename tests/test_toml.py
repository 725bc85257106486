"""Package names of TOML manifests, against the standard library's parser."""

from __future__ import annotations

import random
import tomllib

from pyspark.sql import functions as F

from codesieve.operators.dependencies import CARGO_SECTIONS, POETRY_SECTIONS, toml_packages

STRINGS = ['"1"', "'x'", '"a # b = {"', '"\\" = \\\\"', "'\\'", '""', "''", '"""\n[dependencies]\nz = 1\n"""', '"""a""b\\""""', "'''\ny = 2\n\\'''", '""""q""""', '"""\\\n  w = 3"""']
PLAIN = ["1", "-1.5e3", "true", "1979-05-27T07:32:00Z", "0xFF", "[]", "{}"]


def value(rng: random.Random, depth: int = 0) -> str:
    roll = rng.random()
    if depth < 3 and roll < 0.15:
        gap = rng.choice(["", "\n  ", " # c ] }\n"]) if depth == 0 else ""
        return "[" + gap + f",{gap}".join(value(rng, depth + 1).replace("\n", " ") for _ in range(rng.randint(0, 3))) + gap + "]"
    if depth < 3 and roll < 0.35:
        keys = rng.sample(NAMES, rng.randint(0, 3))
        return "{" + ", ".join(f"{key(rng, k)} = {value(rng, depth + 1)}".replace("\n", " ") for k in keys) + "}"
    return rng.choice(STRINGS if depth == 0 else [s for s in STRINGS if "\n" not in s]) if roll < 0.7 else rng.choice(PLAIN)


NAMES = ["a", "b-c", "d_e", "version", "dependencies", "dev-dependencies", "poetry", "python", "q r", "f.g", "1"]


def key(rng: random.Random, *parts: str) -> str:
    def one(part):
        if all(c.isalnum() or c in "_-" for c in part):
            return rng.choice([part, part, f'"{part}"', f"'{part}'"])
        return rng.choice([f'"{part}"', f"'{part}'"])

    return rng.choice([".", ".", " . "]).join(map(one, parts))


def document(rng: random.Random, sections: list[str]) -> str:
    lines = []
    for _ in range(rng.randint(1, 8)):
        path = rng.choice([*sections, sections[0], "tool.poetry", "tool", "notes", "package"]).split(".")
        if rng.random() < 0.2:
            path = [*path, rng.choice(NAMES)]
        if lines or rng.random() < 0.8:
            brackets = ("[[", "]]") if rng.random() < 0.1 else ("[", "]")
            path = [*path, f"list{len(lines)}"] if brackets[0] == "[[" else path
            lines.append(f"{rng.choice(['', '  '])}{brackets[0]}{rng.choice(['', ' '])}{key(rng, *path)}{brackets[1]}{rng.choice(['', ' # [x]', ''])}")
        for name in rng.sample(NAMES, rng.randint(0, 4)):
            parts = [name, rng.choice(NAMES)] if rng.random() < 0.2 else [name]
            lines.append(f"{rng.choice(['', chr(9)])}{key(rng, *parts)} {rng.choice(['=', ' = '])}{value(rng)}{rng.choice(['', ' # = 1'])}")
        if rng.random() < 0.3:
            lines.append(rng.choice(["", "# [dependencies]", "#x = \"\"\"", "   "]))
    return "\n".join(lines) + rng.choice(["", "\n"])


def expected(text: str, sections: dict[str, str]) -> set:
    out = set()
    for section, scope in sections.items():
        at = tomllib.loads(text)
        for part in section.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if isinstance(at, dict):
            out |= {(scope, name) for name in at}
    return out


def valid(text: str) -> bool:
    try:
        tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return False
    return True


def found(spark, texts, sections):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, content string").repartition(4)
    rows = df.select("n", toml_packages(F.col("content"), sections)[0].alias("p")).collect()
    return {r.n: [tuple(p) for p in r.p or []] for r in rows}


def test_generated_documents(spark):
    for seed, sections in enumerate((CARGO_SECTIONS, POETRY_SECTIONS)):
        rng = random.Random(seed)
        texts = [t for t in (document(rng, list(sections)) for _ in range(9000)) if valid(t)]
        assert len(texts) > 1500 and sum(bool(expected(t, sections)) for t in texts) > 300
        out = found(spark, texts, sections)
        for n, text in enumerate(texts):
            assert set(out[n]) == expected(text, sections), text
            assert len(out[n]) == len(set(out[n]))


def test_texts_that_are_no_documents(spark):
    texts = {
        "[dependencies\nx = 1\n[dependencies]\ny = 1\n": {"y"},  # a header that does not close has no entries
        "[dependencies]\nx = \"open\n y = 1\n": {"x", "y"},  # a string ends with its line
        "[dependencies]\nx = [1,\ny = 2\n": {"x"},  # an open bracket does not
        "[dependencies]\n= 1\n.. = 2\n]}\nx = }1\ny=2": {"x", "y"}, "[dependencies]\na = \'\'\'\nb = 1\n": {"a"}, "[dependencies]\n'c = 1\nd = 1": {"d"},
        "[[dependencies]]\nx = 1\n": set(), "dependencies = [{x = 1}]": set(),
        "": set(), "dependencies": set(), "﻿[dependencies]\n": set(),
    }
    out = found(spark, list(texts), CARGO_SECTIONS)
    for n, (text, names) in enumerate(texts.items()):
        assert {name for _, name in out[n]} == names, text


def test_long_texts(spark):
    inside = "x = 1 # \\\" \n" * 20000
    texts = [f'[dependencies]\na = """{inside}"""\nb = 1', "[dependencies]\n" + "\n".join(f"p{i} = 1" for i in range(3000)), '[dependencies]\nc = "' + "\\\"" * 50000 + '"\nd = 1']
    out = found(spark, texts, CARGO_SECTIONS)
    assert [name for _, name in out[0]] == ["a", "b"] and len(out[1]) == 3000 and [name for _, name in out[2]] == ["c", "d"]
