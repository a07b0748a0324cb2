"""Connected components by alternating large-star and small-star passes over an edge table.

A star's centre may have a very large part of all edges. So the least neighbours are stored before
they are joined with the edges: the join then reads a plain table on both sides, and the rows of a
hot centre are split over tasks (or the least neighbours broadcast, where they are few).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastercat.llm.storage import dropped, stored


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours; and what was stored for it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every smaller neighbour of a node, and the node, are linked to the least of them; u > v in each edge."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct(), least


def components(edges: DataFrame, most_passes: int = 200) -> DataFrame:
    """(id, component), stored: for each id of edges(a, b) the least id that it reaches; null ends are ignored."""
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = stored(ordered, "edges"), None
    for _ in range(most_passes):
        for star in (_large_star, _small_star):
            made, least = star(now)
            made = stored(made, "edges")
            dropped(now, least)
            now = made
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            out = stored(ends.union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct(), "components")
            dropped(now)
            return out
        seen = state
    raise RuntimeError(f"no end after {most_passes} passes")
