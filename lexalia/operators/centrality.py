"""Shortest-path centralities by breadth-first search over DataFrames.

State is one row per (source, vertex), spread over the cluster; each level is
a join with the edge table.  Sources can be taken in several passes to bound
the state; all passes together give the exact result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lexalia.operators.network import both_directions
from lexalia.session import cut_lineage


def _levels(arcs: DataFrame, by: list[str], sources: DataFrame) -> list[DataFrame]:
    """One DataFrame ``by, s, v, sigma`` per distance 0, 1, 2, …

    Edges have no direction, so a neighbour of a vertex at one distance is at that
    distance, one less or one more: only the last two levels are looked at.
    """
    first = sources.select(*by, F.col("name").alias("s"), F.col("name").alias("v"),
                           F.lit(1.0).alias("sigma"))
    levels = [cut_lineage(first, "level")]
    while True:
        seen = reduce(DataFrame.unionByName, [x.select(*by, "s", "v") for x in levels[-2:]])
        step = (
            levels[-1].join(arcs.withColumnRenamed("src", "v"), [*by, "v"])
            .groupBy(*by, "s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
            .join(seen, [*by, "s", "v"], "left_anti")
        )
        step = cut_lineage(step, "level")
        if step.isEmpty():
            return levels
        levels.append(step)


def _passes(edges: DataFrame, by: list[str], passes: int):
    arcs = cut_lineage(both_directions(edges, by), "arcs")
    vertices = arcs.select(*by, F.col("src").alias("name")).distinct()
    for i in range(passes):
        part = vertices.filter(F.pmod(F.xxhash64("name"), F.lit(passes)) == i)
        yield arcs, _levels(arcs, by, part)


def closeness(edges: DataFrame, by: list[str], passes: int = 1) -> DataFrame:
    """``by, member, closeness = 1 / sum of distances`` over reachable vertices."""
    parts = []
    for _, levels in _passes(edges, by, passes):
        if len(levels) == 1:  # a pass without sources
            continue
        reached = reduce(DataFrame.unionByName, [
            level.select(*by, "s", F.lit(d).alias("dist"))
            for d, level in enumerate(levels) if d > 0])
        parts.append(reached.groupBy(*by, F.col("s").alias("member")).agg(
            (1.0 / F.sum("dist")).alias("closeness")))
    return reduce(DataFrame.unionByName, parts)


def betweenness(edges: DataFrame, by: list[str], passes: int = 1) -> DataFrame:
    """``by, member, betweenness``: share of shortest paths through each vertex.

    Dependencies are handed back level by level from the farthest vertices
    (Brandes 2001); every unordered pair counts once.
    """
    parts = []
    for arcs, levels in _passes(edges, by, passes):
        delta = levels[-1].withColumn("delta", F.lit(0.0))
        collected = [delta]
        for level in reversed(levels[:-1]):
            farther = delta.select(
                *by, "s", F.col("v").alias("dst"),
                ((1.0 + F.col("delta")) / F.col("sigma")).alias("_share"))
            handed = (farther.join(arcs, [*by, "dst"])
                      .groupBy(*by, "s", F.col("src").alias("v"))
                      .agg(F.sum("_share").alias("_handed")))
            delta = (
                level.join(handed, [*by, "s", "v"], "left")
                .withColumn("delta", F.col("sigma") * F.coalesce("_handed", F.lit(0.0)))
                .drop("_handed")
            )
            delta = cut_lineage(delta, "delta")
            collected.append(delta)
        through = reduce(DataFrame.unionByName, collected)
        own = F.col("s") == F.col("v")
        parts.append(through.groupBy(*by, F.col("v").alias("member")).agg(
            F.sum(F.when(own, 0.0).otherwise(F.col("delta"))).alias("betweenness")))
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(*by, "member").agg(
        (F.sum("betweenness") / 2.0).alias("betweenness"))
