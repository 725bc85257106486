from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from codesieve.llm.merkle import field_hash, folded, manifest, proof_digest
from tests.llm.conftest import SCHEMA


def h(*parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute_tree(leaves: list[str], fanout: int):
    """The root, and for each leaf the (before, after) of every run on its way."""
    ways, nodes, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            first = i - i % fanout
            ways[leaf].append(("".join(nodes[first:i]), "".join(nodes[i + 1:first + fanout])))
        nodes = [h(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], ways


def brute_manifest(rows, fanout: int):
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, source, text)."""
    groups: dict = {}
    for doc_id, source, text in rows:
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, brute_leaf((doc_id, source, text)), doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fanout) for s in order}
    root, above = brute_tree([trees[s][0] for s in order], fanout) if order else ("", [])
    out = []
    for s, up in zip(order, above, strict=True):
        for (_, _, leaf, doc_id), way in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            out.append((doc_id, leaf, trees[s][0], root, tuple(way + up)))
    return sorted(out, key=repr)


def ours(df, **parameters):
    rows = manifest(df, field_hash(F.col("doc_id"), F.col("source"), F.col("text")), F.col("source"), F.col("doc_id"), ["doc_id"], **parameters).collect()
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, tuple(map(tuple, r.path))) for r in rows], key=repr)


@pytest.mark.parametrize("fanout,levels", [(2, 1), (3, 2), (16, 1), (16, 3)])
def test_every_shape_of_tree(spark, fanout, levels):
    sizes = [1, 2, 3, 4, 5, 16, 17, 18, 33, 127]  # short last runs on every level, and a group with half of all rows
    rows = [(n * 1000 + i * 7, f"s{n}", f"text {i} é") for n in sizes for i in range(n)] + [(5, None, "x"), (4, None, None), (None, "", ""), (3, "S", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(5)
    assert ours(df, fanout=fanout, levels=levels) == brute_manifest(rows, fanout)


def test_many_groups(spark):
    rows = [(i, f"{i % 40:x}é" if i % 3 else chr(0x10000 + i % 7), "t") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    assert ours(df, fanout=2, levels=2) == brute_manifest(rows, 2)


def test_awkward_rows_and_clashing_names(spark, awkward, table):
    df = table(awkward)
    assert ours(df) == brute_manifest([(r[0], r[3], r[1]) for r in awkward], 16)
    more = [c for c in df.columns if c not in ("text",)] + ["hash", "group", "part", "total", "position"]
    wide = df.select("*", *[F.lit(1).alias(c) for c in ("hash", "group", "part", "total", "position")])
    assert manifest(wide, field_hash(F.col("doc_id")), F.col("source"), F.col("doc_id"), more).columns == [*more, "leaf", "subroot", "root", "path"]


def test_repeated_rows_and_one_row(spark):
    rows = [(1, "a", "x")] * 40 + [(None, "a", None)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    assert ours(df) == brute_manifest(rows, 16)
    one = df.limit(1)
    assert [r[1] == r[2] == r[3] and r[4] == () for r in ours(one)] == [True]
    assert ours(df.limit(0)) == []


def test_proofs_fold_to_the_root_and_give_changes_away(spark):
    rows = [(i, "ab"[i % 2], "Text" if i % 5 else "text") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    own, lower = (field_hash(F.col("doc_id"), F.col("source"), t) for t in (F.col("text"), F.lower("text")))
    out = manifest(df.withColumn("changed", lower), own, F.col("source"), F.col("doc_id"), ["text", "changed"], fanout=4, levels=1)
    for r in out.select("*", folded(F.col("leaf"), F.col("path")).alias("same"), folded(F.col("changed"), F.col("path")).alias("other"), proof_digest(F.col("path")).alias("digest")).collect():
        assert r.same == r.root
        assert (r.other == r.root) == (r.text == "text")
        assert r.digest == h(*[before + after for before, after in r.path])
