"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulith.operators.skew import heavy_values, salted_join
from nebulith.runtime import Scratch, ship

MAX_ROUNDS = 60
BATCH_EDGES = 200_000  # edges contracted at once


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, least vertex it reaches) of the components of one batch, by pointer jumping."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[u], root[v])
        nxt = root.copy()
        np.minimum.at(nxt, root[u], low)
        np.minimum.at(nxt, root[v], low)
        nxt = nxt[nxt]
        while (nxt != nxt[nxt]).any():
            nxt = nxt[nxt]
        if (nxt == root).all():
            break
        root = nxt
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges of the same components, each batch of a partition replaced by stars on its least vertices: one pass without a shuffle.

    Links of neighbouring places lie in one partition, so most chains are gone before the first round. A batch is bounded, whatever the partition's size.
    """
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in _forest(a, b)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= BATCH_EDGES:
                yield out()
        if held:
            yield out()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _star(scratch: Scratch, edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of a vertex is linked to the least of its closed neighbourhood. Small: every smaller
    neighbour of a vertex, and itself, is linked to the least of them. A vertex with very many neighbours is cut in pieces."""
    if large:
        rows = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        rows = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = scratch.write(rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    least_of = F.least("m", "a") if large else F.col("m")
    joined = salted_join(rows, least.select("a", least_of.alias("m")), "a", ["b"], heavy_values(least, "a", counted="n"))
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, label) for every vertex of ``edges(a, b)``; label is the least vertex of its component.

    Rounds grow with the logarithm of the vertices, each round is a written table, and the loop ends when the edges are stars: every
    vertex has one edge down, or only edges from above. More than MAX_ROUNDS are an error. Null ends and self links join nothing.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.write(contracted(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))).distinct())
    for _ in range(MAX_ROUNDS):
        large = scratch.write(_star(scratch, now, large=True))
        now = scratch.write(_star(scratch, large, large=False))
        scratch.drop_but(now)
        ends = now.select(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(now.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("v").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down > 0 AND up > 0").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("label")).union(now.select(F.col("b").alias("vertex"), F.col("b").alias("label")).distinct())
