"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) for every node of rows (a, b); self links are ignored.

    Each round writes its edges to the shared folder. A large-star step joins every larger neighbour
    to the smallest neighbour; a small-star step joins the smaller ones. Stars remain when nothing changes.
    Both steps are aggregates and joins on the node; AQE splits the rows of a hub.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # each larger neighbour v of u now points at the least of u's neighbourhood
        large = materialize(large.where("u <> v").distinct())
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u")
        new = materialize(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        same = new.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first() == edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        discard(large, edges)
        edges = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    rows = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return rows.unionByName(roots)
