"""Spatial lookups: nearest cells, points in patches, faces of a grid."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nebulith.operators.base import finite
from nebulith.runtime import Scratch


def nearest_cells(points: DataFrame, cells: DataFrame, k: int, box: float, step: str | None = None) -> DataFrame:
    """(star, cell, d2, rank): the k nearest cells of each point, not across box faces; ties by cell id.

    Cells are bucketed on a grid fine enough for a few per bucket. Each point looks at the buckets around its own. If its k-th distance
    lies within the searched block it is done; if not, that distance bounds the search, and one more join takes all buckets it reaches. Points that found
    fewer than k cells go on to buckets of twice the width, at last to one bucket that holds all, so the result is exact and no point is repeated
    for more buckets than the ball of its k-th distance touches. The joins are never broadcasts: the planner doesn't see how often points are repeated.
    """
    scratch = Scratch(points.sparkSession, "nearest")
    keys = [step] if step else []
    pts = scratch.write(points.where(finite("x", "y", "z")))
    src = scratch.write(cells.where(finite("cx", "cy", "cz")))
    total, lo, hi = src.agg(F.count("*"), F.least(*[F.min(c) for c in ("cx", "cy", "cz")]), F.greatest(*[F.max(c) for c in ("cx", "cy", "cz")])).first()
    groups = src.select(*keys).distinct().count() if keys else 1
    if not total:
        return pts.select(*keys, "star").limit(0).withColumns({"cell": F.lit(0).cast("long"), "d2": F.lit(0.0), "rank": F.lit(0)})
    span = max(hi - lo, 1e-12)
    side = max(1, int((total / groups / max(k, 1)) ** (1 / 3)))  # about k cells per bucket, however many there are
    mine = [*keys, "star"]
    todo, done = pts, []
    while True:
        width = span / side
        bucket = lambda c: F.least(F.greatest(F.floor((F.col(c) - lo) / width), F.lit(0)), F.lit(side - 1)).cast("int")  # noqa: B023, E731
        held = src.select(*keys, "cell", "cx", "cy", "cz", *[bucket(f"c{c}").alias(f"b{c}") for c in "xyz"])

        def nearest(around: DataFrame, *more: str) -> DataFrame:
            d2 = sum((F.col(c) - F.col(f"c{c}")) ** 2 for c in "xyz")
            pairs = around.join(held.hint("merge"), [*keys, "bx", "by", "bz"]).select(*mine, *more, "cell", d2.alias("d2"))  # noqa: B023
            return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*mine).orderBy("d2", "cell"))).where(F.col("rank") <= k)  # cut to k in every task before the shuffle

        around = todo.withColumns({f"p{c}": bucket(c) for c in "xyz"})
        # distance from the point to the nearest face of the searched block, infinite on sides where the block reaches the edge
        gaps = []
        for c in "xyz":
            gaps.append(F.when(F.col(f"p{c}") <= 1, float("inf")).otherwise(F.col(c) - (lo + (F.col(f"p{c}") - 1) * width)))
            gaps.append(F.when(F.col(f"p{c}") >= side - 2, float("inf")).otherwise(lo + (F.col(f"p{c}") + 2) * width - F.col(c)))
        around = around.withColumn("reach", F.least(*gaps))
        for c in "xyz":
            around = around.withColumn(f"b{c}", F.explode(F.sequence(F.greatest(F.col(f"p{c}") - 1, F.lit(0)), F.least(F.col(f"p{c}") + 1, F.lit(side - 1)))))
        whole = Window.partitionBy(*mine)
        found = nearest(around, "reach").withColumns({"kth": F.max("d2").over(whole), "n": F.max("rank").over(whole)})
        found = scratch.write(found.withColumn("enough", (F.col("kth") < F.col("reach") ** 2) & (F.col("n") >= k) | (F.col("reach") == float("inf"))).drop("reach"))
        done.append(found.where("enough").select(*mine, "cell", "d2", "rank"))
        wide = scratch.write(todo.join(found.where(~F.col("enough") & (F.col("n") >= k) & (F.col("rank") == 1)).select(*mine, "kth"), mine))
        if not wide.isEmpty():
            # buckets within the k-th distance, axis by axis; rounding is covered by a little more of it
            left = F.col("kth") * (1 + 1e-9) + 1e-12 * span**2
            ball = wide.withColumn("left", left)
            for c in "xyz":
                at = lambda v: F.least(F.greatest(F.floor((v - lo) / width), F.lit(0)), F.lit(side - 1)).cast("int")  # noqa: B023, E731
                ball = ball.withColumn(f"b{c}", F.explode(F.sequence(at(F.col(c) - F.sqrt("left")), at(F.col(c) + F.sqrt("left")))))
                below, above = lo + F.col(f"b{c}") * width - F.col(c), F.col(c) - (lo + (F.col(f"b{c}") + 1) * width)
                ball = ball.withColumn("left", F.col("left") - F.pow(F.greatest(below, above, F.lit(0.0)), F.lit(2.0))).where("left >= 0")
            done.append(scratch.write(nearest(ball)))
        if side == 1:
            break
        todo = scratch.write(todo.join(found.where((F.col("rank") == 1) & (F.col("enough") | (F.col("n") >= k))).select(*mine), mine, "left_anti"))
        if todo.isEmpty():
            break
        side //= 2
    return reduce(DataFrame.unionByName, done)


def feedback_weights(nearest: DataFrame, keys: list[str], floor: float = 1e-12) -> DataFrame:
    """Weights (1/r) / Σ(1/r) of each point's targets, r² floored."""
    inverse = 1 / F.sqrt(F.greatest(F.col("d2"), F.lit(floor)))
    total = F.sum("_w").over(Window.partitionBy(*keys))
    return nearest.withColumn("_w", inverse).withColumn("weight", F.col("_w") / total).drop("_w")


def in_box(point: tuple[Column, Column, Column], low: tuple[Column, Column, Column], size: tuple[Column, Column, Column]) -> Column:
    """Lower faces belong to the box, upper ones don't."""
    ok = F.lit(True)
    for p, lo, s in zip(point, low, size):
        ok = ok & (p >= lo) & (p < lo + s)
    return ok


def points_in_patches(points: DataFrame, patches: DataFrame, box: float, bucket: float) -> DataFrame:
    """(point, patch): the finest patch that contains each point, ties by patch id.

    Patches are exploded over the buckets they touch and joined with the points on the bucket, so it is an equi join.
    """
    cut = lambda c: F.floor(c / bucket).cast("int")
    spread = patches
    for c, o, e in (("bx", "ox", "ex"), ("by", "oy", "ey"), ("bz", "oz", "ez")):
        last = F.greatest(cut(F.col(o)), F.ceil((F.col(o) + F.col(e)) / bucket).cast("int") - 1)
        spread = spread.withColumn(c, F.explode(F.sequence(cut(F.col(o)), last)))
    at = points.withColumns({"bx": cut(F.col("x")), "by": cut(F.col("y")), "bz": cut(F.col("z"))})
    hit = in_box((F.col("x"), F.col("y"), F.col("z")), (F.col("ox"), F.col("oy"), F.col("oz")), (F.col("ex"), F.col("ey"), F.col("ez")))
    return at.join(spread, ["bx", "by", "bz"]).where(hit).groupBy("point").agg(F.min_by("patch", F.struct(-F.col("level"), F.col("patch"))).alias("patch"), F.max("level").alias("level"))


def grid_faces(cells: DataFrame, n: int, periodic: bool = True) -> DataFrame:
    """(owner, neighbor, axis, boundary) of the upper face of every cell (ix, iy, iz) of an n³ grid, by an equi join per axis."""
    key = lambda x, y, z: (x * n + y) * n + z
    axes = F.explode(F.sequence(F.lit(0), F.lit(2)))
    wide = cells.select("ix", "iy", "iz").withColumn("axis", axes)
    move = lambda c, a: F.col(c) + F.when(F.col("axis") == a, 1).otherwise(0)
    nxt = [move(c, a) for a, c in enumerate(("ix", "iy", "iz"))]
    wraps = (nxt[0] >= n) | (nxt[1] >= n) | (nxt[2] >= n)
    out = wide.select(
        key(F.col("ix"), F.col("iy"), F.col("iz")).alias("owner"), key(*[F.pmod(c, F.lit(n)) for c in nxt]).alias("neighbor"), "axis",
        F.when(wraps, "periodic" if periodic else "open").otherwise("interior").alias("boundary"),
    )
    return out if periodic else out.withColumn("neighbor", F.when(F.col("boundary") == "interior", F.col("neighbor")))


def cube_side(n_rows: int) -> int:
    return max(1, math.ceil(n_rows ** (1 / 3)))
