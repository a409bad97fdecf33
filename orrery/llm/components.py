"""Distributed union-find over a table of links.

Alternates the large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond") with DataFrame joins and aggregations
only.  Each round is written to the shared folder, so lineage stays short and
a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import store


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``links``; root is the smallest node
    of its component.  Null ends and self links are ignored; an empty table
    gives an empty table.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    mark = None
    while True:
        edges = store(edges, "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        edges = _small_star(_large_star(edges))
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
