"""Connected components of links between 64-bit ids: a union-find spread over tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.common import stored

_BATCH = 1 << 20
_LINKS = 1 << 19  # links, about, that a task contracts once tables are written


def _contract(batches):
    """Union-find over up to _BATCH links at a time: the same components with a link per node, to its smallest one."""

    def flush(pairs):
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in pairs.tolist():
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = [(x, r) for x in parent if (r := root(x)) != x]
        return pd.DataFrame(nodes, columns=["a", "b"], dtype="int64")

    held: list[np.ndarray] = []
    for batch in batches:
        held.append(batch[["a", "b"]].to_numpy(np.int64))
        if sum(map(len, held)) >= _BATCH:
            yield flush(np.concatenate(held))
            held = []
    if held:
        yield flush(np.concatenate(held))


def _hooked(links: DataFrame) -> DataFrame:
    """One round over links (a > b): first the larger neighbours of each node move to the smallest one around it, then each
    node and its smaller neighbours do. Both keep components as they are and shorten the ways through them."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    wide = links.join(least, links["b"] == least["n"]).select("a", F.col("m").alias("b")).distinct()
    wide = stored(wide, "links")
    small = wide.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    moved = wide.join(small, wide["a"] == small["n"]).filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(small.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether each node has one link, to a node that has none itself."""
    ends = links.select(F.col("a").alias("n"), F.lit(1).alias("up")).union(links.select("b", F.lit(0)))
    return ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).filter("ups > 1 OR (ups = 1 AND least = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``, two bigints; the component is its smallest node.

    Tasks first contract the links they read. What is left is dealt to tasks of some _LINKS each, however many partitions shuffles have: as many as
    the links ask for, and for few links one, which sees them all and is done. Several contract again, then those of the same nodes. Then rounds of
    minima and joins, each a written table, until every node has one link, to a root: about as many as the logarithm of the longest
    way. No node's links are ever gathered: minima are combined before the shuffle, and the joins split hot nodes. Links of a
    node to itself and repeated links count for nothing more; no links give no rows.
    """
    schema = "a bigint, b bigint"
    own = stored(links.filter("a <> b").select("a", "b").mapInPandas(_contract, schema), "links")
    tasks = max(1, -(-own.count() // _LINKS))
    current = own.coalesce(tasks).mapInPandas(_contract, schema)
    if tasks > 1:  # a node that several tasks have linked to roots of theirs comes to one task: there the roots are linked, and the node keeps one link
        current = current.repartition("a").mapInPandas(_contract, schema).distinct()
    current = stored(current, "links")
    while tasks > 1 and not _settled(current):
        current = stored(_hooked(current), "links")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
