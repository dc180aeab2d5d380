"""Consolidating pairwise matches into groups: connected components by seed-tree pruning.

Every round connects each vertex of the graph to the minimum of its neighbourhood. A vertex that is then
nobody's minimum is pruned: it leaves the graph as a child of its own minimum in a propagation forest.
The graph of what remains shrinks until only seeds are left; their ids flow down the forest, last round first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulith.operators.skew import heavy_values, salted_join
from nebulith.runtime import Scratch

MAX_ROUNDS = 64  # a safety net: rounds grow with the logarithm of a component's diameter


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def connected_groups(edges: DataFrame) -> DataFrame:
    """(group_id, vertex) for every vertex of ``edges(a, b)``; group_id is the smallest vertex of the group.

    Edges with a null or two equal ends join nothing (their ends appear only if another edge names them); repeated and turned edges are one edge.
    An empty table gives no rows. All rounds are written to the shared folder, so a lost executor costs no more than a task. Vertices with
    very many neighbours, minima or children are cut in pieces in proportion to their share in every join, whatever that share is.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "groups")
    graph = scratch.write(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct()
    )
    states: list[DataFrame] = []  # one row per vertex of a round: its parent, and whether it stays
    alive: list[DataFrame] = []  # the vertices of a round's graph
    for _ in range(MAX_ROUNDS):
        directed = _both_ways(graph)
        near = scratch.write(directed.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")))
        alive.append(near)
        if near.isEmpty():
            break
        # (w, m): m is the minimum of the closed neighbourhood of some vertex u, and w is u or a neighbour of u
        least = near.select("u", F.least("least", "u").alias("m"))
        told = salted_join(directed, least, "u", ["v"], heavy_values(near, "u", counted="n"))
        minima = scratch.write(told.select(F.col("v").alias("w"), "m").union(least.select(F.col("u").alias("w"), "m")).distinct())
        state = scratch.write(minima.groupBy("w").agg(F.min("m").alias("parent"), F.max(F.col("w") == F.col("m")).alias("stays"), F.count("*").alias("n")))
        states.append(state)
        several = state.where("n > 1")
        graph_next = salted_join(minima, several.select("w", "parent"), "w", ["m"], heavy_values(state, "w", counted="n")).where(F.col("m") != F.col("parent"))
        graph_next = scratch.write(graph_next.select(F.least("m", "parent").alias("a"), F.greatest("m", "parent").alias("b")).distinct())
        scratch.drop(minima, graph)
        graph = graph_next
    else:
        raise RuntimeError("the graph did not shrink to its seeds")
    labels: DataFrame | None = None
    for state, left in zip(reversed(states), reversed(alive[1:])):
        # a vertex that stays but has no edge in the next round is the seed of its group
        new = state.where("stays").select("w").join(left.select(F.col("u").alias("w")), "w", "left_anti").select(F.col("w").alias("vertex"), F.col("w").alias("group_id"))
        above = new if labels is None else labels.unionByName(new)
        children = state.where(~F.col("stays")).select(F.col("w").alias("vertex"), "parent")
        down = salted_join(children, above.select(F.col("vertex").alias("parent"), "group_id"), "parent", ["vertex"], heavy_values(children, "parent")).select("vertex", "group_id")
        merged = scratch.write(above.unionByName(down))
        scratch.drop(labels, state, left)
        labels = merged
    if labels is None:
        return spark.createDataFrame([], "group_id long, vertex long")
    return labels.select("group_id", "vertex")


def link_edges(links: DataFrame, members: DataFrame) -> DataFrame:
    """Edges between particle ids from links between local indices, which are unique only within a snapshot.

    A link with an end that names no member of its snapshot, or equal ends, joins nothing. A member with very many links is cut in pieces.
    """
    ends = links.where("local_index_a IS NOT NULL AND local_index_b IS NOT NULL AND local_index_a <> local_index_b").select("snap_step", "local_index_a", "local_index_b").distinct()
    ids = members.groupBy("snap_step", "local_index").agg(F.min("particle_id").alias("p"))
    for end, name in (("local_index_a", "a"), ("local_index_b", "b")):
        here = ids.select("snap_step", F.col("local_index").alias(end), F.col("p").alias(name))
        ends = salted_join(ends, here, ["snap_step", end], ["local_index_a", "local_index_b"], heavy_values(ends, ["snap_step", end]))
    return ends.select("a", "b")
