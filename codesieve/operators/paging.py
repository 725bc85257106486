"""Long lists in pages: no value holds more than a page, no task more than its share of a group."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.plans.materialize import materialize


def paged(rows: DataFrame, keys: list[str], value: str, size: int, folder: str) -> DataFrame:
    """(keys, page, first, values, n) of ``rows(keys, value)``: each group's values in order, ``size`` a page, the last one shorter. ``page`` counts from 1,
    ``first`` is the place of the page's first value, n their number. Rows that repeat are listed as often; a null value comes first.

    Rows are sorted by range, so that a group of any size is split over tasks, and written to ``folder``, which every executor must reach: a row's place is
    its number in its range, plus what the group has in earlier ranges. Only a range's counts, a row a group and range, meet by group.
    """
    order = [*keys, value]
    sorted_ = materialize(
        rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), folder, "pages")
    piece = F.shiftright("at", 33)
    group = ", ".join(f"`{k}`" for k in keys)
    starts = sorted_.groupBy(*keys, piece.alias("piece")).agg(F.min("at").alias("start"), F.count("*").alias("n")).selectExpr(
        *[f"`{k}`" for k in keys], "piece", "start",
        f"COALESCE(SUM(n) OVER (PARTITION BY {group} ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier")
    # null keys are groups, too
    right = starts.select(*[F.col(k).alias(f"{k}__of") for k in keys], "piece", "start", "earlier")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}__of")) for k in keys])
    placed = sorted_.withColumn("own", piece).join(right, same & (F.col("own") == F.col("piece")))
    placed = placed.withColumn("place", F.col("earlier") + F.col("at") - F.col("start"))
    pages = placed.groupBy(*keys, (F.floor(F.col("place") / size) + 1).alias("page")).agg(
        F.min("place").alias("place"), F.array_sort(F.collect_list(F.struct("place", value))).alias("values"))
    return pages.select(
        *keys, "page", (F.col("place") + 1).alias("first"), F.col(f"values.{value}").alias("values"), F.size("values").cast("long").alias("n"))


def sorted_pieces(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, piece, values) of ``rows(keys, value)``: each group's distinct values in order, cut where a range of the sorted rows ends; pieces count up with
    the values. A null value is left out.

    Rows are dealt out by range, so a group of any size is split over tasks, and what a task gathers is its range. Equal rows meet there.
    """
    ranged = rows.select(*keys, value).repartitionByRange(*keys, value).distinct().withColumn("piece", F.spark_partition_id())
    return ranged.groupBy(*keys, "piece").agg(F.array_sort(F.collect_list(value)).alias("values"))
