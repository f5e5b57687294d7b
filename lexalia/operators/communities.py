"""Communities by modularity, found with repeated DataFrame joins.

Vertices move to the neighbouring community with the largest gain.  Only half
of them (by hash) may move at a time, and a round is kept only where it raises
modularity, so the score never falls.  Communities then become the vertices of
the next, smaller graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexalia.operators.aggregates import number_within
from lexalia.operators.network import both_directions
from lexalia.session import cut_lineage


def modularity(arcs: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """``by, q`` for labels ``by, v, c``; ``arcs`` list each edge from both ends."""
    src = labels.select(*by, F.col("v").alias("src"), F.col("c").alias("c_src"))
    dst = labels.select(*by, F.col("v").alias("dst"), F.col("c").alias("c_dst"))
    joined = arcs.join(src, [*by, "src"]).join(dst, [*by, "dst"])
    same = F.col("c_src") == F.col("c_dst")
    per_class = joined.groupBy(*by, "c_src").agg(
        F.sum(F.when(same, F.col("weight")).otherwise(0.0)).alias("_in"),
        F.sum("weight").alias("_tot"))
    per_graph = per_class.groupBy(*by).agg(
        F.sum("_in").alias("_in"), F.sum("_tot").alias("_all"),
        F.sum(F.col("_tot") * F.col("_tot")).alias("_sq"))
    return per_graph.select(*by, (F.col("_in") / F.col("_all")
                                  - F.col("_sq") / (F.col("_all") * F.col("_all"))).alias("q"))


def _moved(arcs: DataFrame, strength: DataFrame, labels: DataFrame, by: list[str],
           half: int, salt: int) -> DataFrame:
    """Labels after the vertices of one half took their best move."""
    total = strength.groupBy(*by).agg(F.sum("k").alias("_all"))
    size = (labels.join(strength, [*by, "v"]).groupBy(*by, "c")
            .agg(F.sum("k").alias("_tot")))
    near = labels.select(*by, F.col("v").alias("dst"), F.col("c").alias("c"))
    # The own community is always a candidate, with weight 0 when no neighbour is in it.
    own = labels.select(*by, "v", "c", F.lit(0.0).alias("weight"))
    reach = (
        arcs.filter(F.col("src") != F.col("dst")).join(near, [*by, "dst"])
        .select(*by, F.col("src").alias("v"), "c", "weight").unionByName(own)
        .groupBy(*by, "v", "c").agg(F.sum("weight").alias("_to"))
    )
    home = labels.select(*by, "v", F.col("c").alias("_home"))
    others = F.col("_tot") - F.when(F.col("c") == F.col("_home"), F.col("k")).otherwise(0.0)
    score = F.col("_to") - F.col("k") * others / F.col("_all")
    choice = (
        reach.join(home, [*by, "v"]).join(strength, [*by, "v"])
        .join(size, [*by, "c"]).join(total, by)
        .withColumn("_score", F.round(score, 12))
        .groupBy(*by, "v", "_home").agg(
            F.max(F.struct(F.col("_score"), (F.col("c") == F.col("_home")).alias("_stay"),
                           (-F.col("c")).alias("_neg"))).alias("_best"))
    )
    may_move = F.pmod(F.xxhash64("v", F.lit(salt)), F.lit(2)) == half
    return choice.select(*by, "v", F.when(may_move, -F.col("_best._neg"))
                         .otherwise(F.col("_home")).alias("c"))


def _best_partition(arcs: DataFrame, by: list[str], limit: int) -> DataFrame:
    """Labels ``by, v, c, q`` of one level, starting from single vertices.

    Ends after three rounds without a gain, among which both halves of one hash had their turn.
    """
    strength = cut_lineage(arcs.groupBy(*by, F.col("src").alias("v"))
                           .agg(F.sum("weight").alias("k")), "strength")
    start = strength.select(*by, "v", F.col("v").alias("c"))
    labels = cut_lineage(start.join(modularity(arcs, start, by), by), "labels")
    idle = 0
    for i in range(limit):
        moved = cut_lineage(_moved(arcs, strength, labels, by, i % 2, i // 2), "moved")
        scored = modularity(arcs, moved, by).withColumnRenamed("q", "_q")
        better = F.col("_q") > F.col("q") + 1e-12
        after = (
            labels.withColumnRenamed("c", "_old")
            .join(moved, [*by, "v"]).join(scored, by)
            .select(*by, "v", F.when(better, F.col("c")).otherwise(F.col("_old")).alias("c"),
                    F.when(better, F.col("_q")).otherwise(F.col("q")).alias("q"),
                    better.alias("_better"))
        )
        after = cut_lineage(after, "labels")
        improved = not after.filter("_better").isEmpty()
        labels = after.drop("_better")
        idle = 0 if improved else idle + 1
        if idle >= 3:
            return labels
    raise RuntimeError(f"modularity still rises after {limit} rounds")


def find_communities(edges: DataFrame, by: list[str], vertices: DataFrame | None = None,
                     limit: int = 1000) -> DataFrame:
    """``by, name, modularity_class``; classes are numbered by their first member.

    ``edges`` are undirected ``by, src, dst, weight`` without loops.  A vertex of ``vertices``
    (``by, name``) without edges is a community of one.  Levels and rounds go on until nothing
    is gained; more than ``limit`` rounds in a level are an error.
    """
    named = both_directions(edges, by, "weight")
    known = named.select(*by, F.col("src").alias("name"))
    if vertices is not None:
        known = known.unionByName(vertices.select(*by, "name"))
    names = cut_lineage(known.distinct()
                        .withColumn("v", F.monotonically_increasing_id()), "names")
    src = names.select(*by, F.col("name").alias("src"), F.col("v").alias("_s"))
    dst = names.select(*by, F.col("name").alias("dst"), F.col("v").alias("_d"))
    arcs = cut_lineage(
        named.join(src, [*by, "src"]).join(dst, [*by, "dst"])
        .select(*by, F.col("_s").alias("src"), F.col("_d").alias("dst"), "weight"), "arcs")
    member = names.select(*by, "name", "v", F.col("v").alias("c"))
    while True:
        labels = _best_partition(arcs, by, limit)
        if labels.filter(F.col("v") != F.col("c")).isEmpty():
            return _number_classes(member, by)
        step = labels.select(*by, F.col("v").alias("c"), F.col("c").alias("_next"))
        member = cut_lineage(
            member.join(step, [*by, "c"], "left")
            .select(*by, "name", "v", F.coalesce("_next", "c").alias("c")), "members")
        src = labels.select(*by, F.col("v").alias("src"), F.col("c").alias("_s"))
        dst = labels.select(*by, F.col("v").alias("dst"), F.col("c").alias("_d"))
        arcs = cut_lineage(
            arcs.join(src, [*by, "src"]).join(dst, [*by, "dst"])
            .groupBy(*by, F.col("_s").alias("src"), F.col("_d").alias("dst"))
            .agg(F.sum("weight").alias("weight")), "arcs")


def _number_classes(member: DataFrame, by: list[str]) -> DataFrame:
    firsts = member.groupBy(*by, "c").agg(F.min("name").alias("_first"))
    numbered = number_within(firsts, by, ["_first"], "modularity_class")
    return member.join(numbered.drop("_first"), [*by, "c"]).select(
        *by, "name", "modularity_class")
