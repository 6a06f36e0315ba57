"""Membership of ids in a set of ranges, as an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.runtime import broadcast_if_small, free_names

#: Ids of one block share a join key: at least so many, and so many that the ranges span about BLOCKS of them.
BLOCK, BLOCKS = 4096, 65_536


def merged_ranges(ranges: DataFrame, group: str, first: str, last: str) -> DataFrame:
    """Union of the ranges of each group as disjoint ranges ``(group, lo, hi)``.

    Touching and overlapping ranges become one. A range with a null bound or with first > last is empty.
    """
    w = Window.partitionBy(group).orderBy(first, last)
    before = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (
        ranges.where(F.col(first) <= F.col(last))
        .select(group, first, last)
        .withColumn("_new", F.when(F.col(first) <= before + 1, 0).otherwise(1))
        .withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(group, "_island")
        .agg(F.min(first).alias("lo"), F.max(last).alias("hi"))
        .select(group, "lo", "hi")
    )


def within_ranges(df: DataFrame, ranges: DataFrame, group: str, id: str, flag: str = "covered") -> DataFrame:
    """Add the boolean ``flag``: whether ``id`` lies in a range of its group. Null ids lie in none.

    The ranges are merged first, so a row meets at most one; they are cut at block borders, and rows and ranges join on
    (group, block). The block grows with the span of the ids, so the cut ranges are hardly more than the ranges: they are
    broadcast when their count is small, and then ``df`` is not shuffled; otherwise both are.
    """
    first, last = ranges.agg(F.min("lo"), F.max("hi")).first()
    size = BLOCK if first is None else max(BLOCK, (last - first) // BLOCKS + 1)
    g, lo, hi, b, block = free_names(df, "_g", "_lo", "_hi", "_b", "_block")
    cut = ranges.select(
        F.col(group).alias(g), F.col("lo").alias(lo), F.col("hi").alias(hi),
        F.explode(F.sequence(F.expr(f"lo div {size}"), F.expr(f"hi div {size}"))).alias(b),
    )
    joined = df.withColumn(block, F.expr(f"`{id}` div {size}")).join(
        broadcast_if_small(cut),
        (F.col(group) == F.col(g)) & (F.col(block) == F.col(b)) & F.col(id).between(F.col(lo), F.col(hi)),
        "left",
    )
    return joined.withColumn(flag, F.col(b).isNotNull()).drop(g, lo, hi, b, block)
