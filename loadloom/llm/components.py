"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.sources.stage import stage


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component is the smallest node reachable.

    Each round hangs the larger neighbours of a node, and then the smaller ones, on its
    smallest neighbour, until every link points to the smallest node of its component.
    The neighbourhood of a node is only ever folded to its minimum (combined before the
    shuffle), written, and joined back as a second shuffled side, so that a hub's links can be
    split over tasks. Every half round is a written table. Null ends and loops are ignored; no links give no rows.
    """
    e = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        e = stage(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = stage(e.groupBy("u").agg(F.min("v").alias("m")))
        hung = e.join(low, "u")
        e = stage(hung.select(F.col("u"), F.col("m").alias("v")).union(hung.where("v <> m").select("v", "m")).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
