"""Mixing sources to target weights: capped water-filling, then whole and seeded fractional repetitions. Columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.common import stored

#: The seeded hash has 60 bits; its 8 upper bits are the slice in which a document is ordered.
SLICES = 256


def seeded_order(key: Column, seed: int) -> Column:
    """A hash of ``key`` that any SQL engine can repeat: the first 15 hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 15), 16, 10).cast("long")


def cycled_weights(sizes: DataFrame, weights=(1, 2, 3)) -> DataFrame:
    """Give the sources of ``sizes`` (one row each) the weights in turn, by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    return sizes.withColumn("weight", F.element_at(cycle, ((rank - 1) % len(weights) + 1).cast("int")).cast("long"))


def water_fill(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Targets for ``sizes(source, source_size, weight)``, one row per source: shares of all sizes by weight, where what a
    source can't take in ``max_epochs`` repetitions goes to the others by weight, until no target is above its cap.

    In order of cap / weight a source is clamped if all before it are and its share of what they leave reaches its cap; one
    running sum tells them all. The table has a row per source, already summed, so its order needs one small task.
    """
    w = F.col("weight")
    cap = F.col("source_size") * max_epochs
    order = Window.orderBy(cap / w, F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    free = F.sum(w).over(whole) - F.coalesce(F.sum(w).over(before), F.lit(0))
    marked = sizes.select("*", cap.alias("cap"), (left * w >= cap * free).alias("full"))
    left = F.sum("source_size").over(whole) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole)
    free = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(w)).over(whole)
    return marked.select(
        "source", "source_size",
        F.when(F.col("full"), F.col("cap").cast("double")).otherwise(w * (left / free)).alias("target"))


def _keyed(df: DataFrame) -> DataFrame:
    """Join keys for a source that may be null, without null-safe joins."""
    return df.withColumns({"__no": F.col("source").isNull(), "__src": F.coalesce("source", F.lit(""))})


def mix_plan(sizes: DataFrame, weights=(1, 2, 3), max_epochs: int = 3, seed: int = 17, key: str = "doc_id") -> DataFrame:
    """Per source of ``sizes(key, source, size)``: its size, target, whole repetitions of each document, and the cut: in the source's seeded order, documents up to that hash get one copy more.

    The order of a source is summed over SLICES slices of the hash first; only the slice in which the rest ends is ordered
    row by row. A source with a third of all rows so puts a few thousandths of them into one task.
    """
    rows = _keyed(sizes).select(
        "__src", "__no", F.col(key).alias("_key"), seeded_order(F.col(key), seed).alias("_hash"),
        F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("_size")).withColumn("_slice", F.shiftright("_hash", 52).cast("int"))
    slices = stored(rows.groupBy("__src", "__no", "_slice").agg(F.sum("_size").alias("_sum")), "mix-slices")
    per_source = slices.groupBy("__src", "__no").agg(F.sum("_sum").alias("source_size")).select(
        F.when(~F.col("__no"), F.col("__src")).alias("source"), "source_size")
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = _keyed(water_fill(cycled_weights(per_source, weights), max_epochs)).withColumn("whole", times).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size"))
    by_slice = Window.partitionBy("__src", "__no").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        slices.withColumn("_below", F.coalesce(F.sum("_sum").over(by_slice), F.lit(0)))
        .join(targets, ["__src", "__no"])
        .groupBy("__src", "__no", "source", "source_size", "target", "whole", "rest")
        .agg(F.max(F.when(F.col("_below") < F.col("rest"), F.struct("_slice", "_below"))).alias("end")))
    ends = stored(ends.select("*", "end.*").drop("end"), "mix-ends")
    order = Window.partitionBy("__src", "__no").orderBy("_hash", "_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        rows.join(ends.select("__src", "__no", "_slice", "_below", "rest"), ["__src", "__no", "_slice"])
        .withColumn("_before", F.col("_below") + F.coalesce(F.sum("_size").over(order), F.lit(0)))
        .filter(F.col("_before") + F.col("_size") / 2 < F.col("rest"))
        .groupBy("__src", "__no").agg(F.max("_hash").alias("_last")))
    cut = F.coalesce("_last", F.shiftleft(F.col("_slice").cast("long"), 52) - 1, F.lit(-1))
    return stored(ends.join(last, ["__src", "__no"], "left").select(
        "__src", "__no", F.col("source_size").alias("__size"), F.col("target").alias("__target"), F.col("whole").cast("long").alias("__whole"), cut.alias("__cut")), "mix-plan")


def mix(docs: DataFrame, sizes: DataFrame | None = None, weights=(1, 2, 3), max_epochs: int = 3, seed: int = 17, key: str = "doc_id") -> DataFrame:
    """``docs`` (with ``key`` and ``source``) plus ``source_size``, ``target`` and ``copies``; with ``size``, also ``taken``.

    A source's target in units of its size has a whole part, which every document gets, and a rest: in the source's seeded
    order, documents get one copy more until their sizes reach the rest. The sum misses the target by half a document at
    most, no document comes more than ``max_epochs`` times, and reruns agree. ``sizes(key, source, size)`` says what the
    documents weigh; without it ``docs`` has ``size`` itself.

    Defined cases: a null source is a source of its own; null sizes count as 0; documents of size 0 are repeated like others
    and take nothing; a source of size 0 has target 0 and copies 0. Rows with the same key share one place in the order and
    so get the same number of copies. An empty table gives an empty result. Other columns pass through, except that the new
    ones replace columns of their names.

    The plan has a row per source and is a written table: Spark knows its size, sends it to the documents where it is below
    the broadcast threshold, and shuffles (splitting hot sources) where it isn't.
    """
    plan = mix_plan(docs if sizes is None else sizes, weights, max_epochs, seed, key)
    added = ["source_size", "target", "copies", "taken"]
    out = _keyed(docs.drop(*added)).join(plan, ["__src", "__no"]).withColumns({
        "source_size": F.col("__size"), "target": F.col("__target"),
        "copies": F.col("__whole") + (seeded_order(F.col(key), seed) <= F.col("__cut")).cast("long"),
    }).drop("__src", "__no", "__size", "__target", "__whole", "__cut")
    if "size" in docs.columns:
        out = out.withColumn("taken", F.col("copies") * F.coalesce(F.col("size"), F.lit(0)))
    return out


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as ``copies`` says, numbered by ``copy`` from 1."""
    return mixed.filter(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
