"""``op12_merkle``: leaf, roots and proof of every document, and which documents a change of their text gives away."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm.merkle import field_hash, folded, manifest, proof_digest

NAME = "op12_merkle"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hashed = lambda text: field_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, hashed(lowered))
    rows = docs.select("doc_id", "source", hashed(F.col("text")).alias("own"), changed.alias("changed"))
    out = manifest(rows, F.col("own"), F.col("source"), F.col("doc_id"), ["doc_id", "changed"])
    out = out.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return out.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_LEVELS = 6  # of runs of 16: 16,777,216 leaves a source, and as many sources


def _field(column: str) -> str:
    return f"COALESCE(octet_length(encode({column}::VARCHAR))::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(first: str, name: str) -> str:
    """Levels of nodes (grp, pos, h), each with what stands beside it in its run; a level is made while a group has more than one node."""
    out = [f"{name}0 AS ({first})"]
    for k in range(_LEVELS):
        out.append(
            f"{name}{k + 1} AS (SELECT grp, pos // 16 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h, "
            f"CASE WHEN any_value(n) > 1 THEN (any_value(n) + 15) // 16 ELSE 1 END AS n FROM {name}{k} GROUP BY grp, pos // 16)")
        beside = "COALESCE(string_agg(h, '') OVER (PARTITION BY grp, pos // 16 ORDER BY pos ROWS BETWEEN {} AND {}), '')"
        out.append(f"{name}_side{k} AS (SELECT grp, pos, n, {beside.format('UNBOUNDED PRECEDING', '1 PRECEDING')} AS b, {beside.format('1 FOLLOWING', 'UNBOUNDED FOLLOWING')} AS a FROM {name}{k})")
    return ",\n".join(out)


def _joins(name: str, group: str, pos: str) -> str:
    return "\n".join(f"JOIN {name}_side{k} {name}{k}s ON {name}{k}s.grp = {group} AND {name}{k}s.pos = {pos} // {16**k}" for k in range(_LEVELS))


#: The bits of crc32, one after the other (fixed value: its polynomial).
_CRC = ("xor(list_reduce(list_prepend(4294967295, list_transform(generate_series(1, length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i::INTEGER, 1))::BIGINT)), "
        "lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)")

def _folds(which: str) -> str:
    """Folding level by level, a column each: nested in one expression it would double at every level."""
    out, last = [], which
    for name in "ds":
        for k in range(_LEVELS):
            out.append(f"CASE WHEN {name}{k}n > 1 THEN sha256({name}{k}b || {last} || {name}{k}a) ELSE {last} END AS f_{name}{k}")
            last = f"f_{name}{k}"
    return ", ".join(out)


SQL = f"""
WITH leaves AS (
  SELECT doc_id, COALESCE('=' || source, '') AS grp, {_leaf('text')} AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
{_tree('SELECT grp, pos, leaf AS h, n FROM placed', 'd')},
subroots AS (SELECT grp AS of_grp, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM d{_LEVELS}),
{_tree("SELECT '' AS grp, pos, h, n FROM subroots", 's')},
joined AS (
  SELECT p.doc_id, p.leaf, COALESCE(p.changed, p.leaf) AS start, r.h AS subroot, top.h AS root,
    {", ".join(f"{name}{k}s.n AS {name}{k}n, {name}{k}s.b AS {name}{k}b, {name}{k}s.a AS {name}{k}a" for name in "ds" for k in range(_LEVELS))}
  FROM placed p JOIN subroots r ON r.of_grp = p.grp CROSS JOIN s{_LEVELS} top
  {_joins('d', 'p.grp', 'p.pos')}
  {_joins('s', "''", 'r.pos')}),
folds AS (SELECT *, {_folds('start')} FROM joined)
SELECT doc_id, leaf, subroot, root,
  sha256({" || ".join(f"{name}{k}b || {name}{k}a" for name in "ds" for k in range(_LEVELS))}) AS proof_sha256,
  f_s{_LEVELS - 1} AS folded_root, f_s{_LEVELS - 1} = root AS verified
FROM folds
"""
