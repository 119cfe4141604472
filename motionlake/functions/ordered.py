"""Running totals over an order of all rows, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys that are drawn by their hash for splitters, and every how many of them one is a splitter.
DRAWN, EVERY = 2048, 32


def running_total(rows: DataFrame, key: str, amount: str, out: str) -> DataFrame:
    """rows (one for each key) with the sum of an amount over all keys up to their own; a null key comes first.

    Keys are dealt into ranges by splitters from a bounded draw. Each range is summed by itself, and sums of whole
    ranges before it are added: at most DRAWN / EVERY + 1 rows. The draw decides how even the ranges are, never the result.
    """
    drawn = rows.select(key).orderBy(F.xxhash64(key), key).limit(DRAWN).agg(F.array_sort(F.collect_list(key)).alias("_drawn"))
    splitters = drawn.select(F.filter("_drawn", lambda x, i: i % EVERY == EVERY - 1).alias("_splitters"))
    dealt = rows.crossJoin(F.broadcast(splitters)).withColumn("_range", F.size(F.filter("_splitters", lambda s: s <= F.col(key)))).drop("_splitters")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("_range").agg(F.sum(amount).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn(out, F.sum(amount).over(inside)).join(F.broadcast(before), "_range")
    return summed.withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_before")
