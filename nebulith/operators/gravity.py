"""Gravity: octree nodes and multipoles from curve prefixes, hierarchical acceptance joins, particle-mesh steps, kicks and drifts."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nebulith.functions import morton
from nebulith.functions.physics import softened_inverse_cube
from nebulith.operators.base import count_if, finite
from nebulith.operators.diagnostics import mass_on_grid
from nebulith.operators.mesh_fft import dense, filtered
from nebulith.operators.near_pairs import near_sums
from nebulith.operators.skew import heavy_values, salted_join
from nebulith.runtime import Scratch, parallelism

LEAF_SIZE = 16
TREE_DEPTH = 21
AXES = ("x", "y", "z")


def _sums() -> list[Column]:
    m = F.col("mass")
    return [
        F.count("*").alias("n"), F.sum("mass").alias("mass"), *[F.sum(m * F.col(c)).alias(f"s{c}") for c in AXES],
        *[F.sum(m * F.col(a) * F.col(b)).alias(f"s{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]], F.min("eps").alias("eps_min"), F.max("eps").alias("eps_max"),
    ]


def tree_nodes(points: DataFrame, depth: int, box: float, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """(level, prefix, n, mass, first and second moments, softening range, half, center, is_leaf) of the octree of ``points``.

    A node is a prefix of the curve key; its sums come from those of its children (they are additive), so the points are aggregated
    once. A node is kept where its parent has more than ``leaf_size`` points; leaves have no more, or are at ``depth``.
    """
    scratch = Scratch(points.sparkSession, "tree")
    key = morton.interleave(*[F.least(F.floor(F.col(c) / box * 2**depth), F.lit(2**depth - 1)).cast("long") for c in AXES], depth)
    names = ["n", "mass", "sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz"]
    level = scratch.write(points.withColumn("prefix", key).groupBy("prefix").agg(*_sums()))
    out = level.withColumn("level", F.lit(depth))
    for d in range(depth - 1, -1, -1):
        level = scratch.write(level.groupBy(F.shiftright("prefix", 3).alias("prefix")).agg(*[F.sum(c).alias(c) for c in names], F.min("eps_min").alias("eps_min"), F.max("eps_max").alias("eps_max")))
        out = out.unionByName(level.withColumn("level", F.lit(d)))
    parents = out.where(F.col("n") > leaf_size).select((F.col("level") + 1).alias("level"), F.col("prefix").alias("_up"))
    kept = out.withColumn("_up", F.shiftright("prefix", 3)).join(parents, ["level", "_up"], "left_semi").unionByName(out.where("level = 0").withColumn("_up", F.lit(0).cast("long"))).drop("_up")
    half = F.lit(box / 2) / F.pow(F.lit(2.0), F.col("level"))
    center = {f"c{c}": (morton.unspread3(F.shiftright("prefix", 2 - i), TREE_DEPTH) * 2 + 1) * half for i, c in enumerate(AXES)}
    return kept.withColumns({"half": half, **center, "is_leaf": (F.col("n") <= leaf_size) | (F.col("level") == depth)})


def tree_depth(n: int, leaf_size: int = LEAF_SIZE) -> int:
    """Levels that split ``n`` points into leaves of ``leaf_size``, and three more for where they crowd."""
    return min(TREE_DEPTH, max(1, math.ceil(math.log(max(n, 1) / leaf_size, 8))) + 3)


def accepts(policy: str, theta: float) -> Column:
    """Multipole acceptance of node columns (half, d, off): cell size over distance, or from the centre of mass with its offset."""
    if policy == "geometric":
        return 2 * F.col("half") < theta * F.col("d")
    return 2 * F.col("half") / theta + F.col("off") < F.col("d")


def tree_acceleration(targets: DataFrame, points: DataFrame, nodes: DataFrame, box: float, depth: int, g: float, theta: float = 0.6, policy: str = "geometric", group_size: int = LEAF_SIZE) -> DataFrame:
    """(target, ax, ay, az, n_nodes, n_points): a walk of groups of neighbouring targets down the tree, level by level.

    A group is the targets in one cell of the curve, as small as holds about ``group_size`` points. It takes a node if every place in its bounding box may, so
    the test is at least as strict as that of each target. Rejected nodes go on to their children; rejected leaves meet the targets with their
    points. The softening of a pair is the larger one, and a node inside the softening is never accepted. The nodes of a level
    with at most 8^4 cells are broadcast, so the walk has no join on few keys; a crowded group is cut in pieces.
    """
    scratch = Scratch(targets.sparkSession, "treewalk")
    nodes = scratch.write(nodes.select("level", "prefix", "mass", *[(F.col(f"s{c}") / F.col("mass")).alias(f"m{c}") for c in AXES], F.sqrt(sum((F.col(f"s{c}") / F.col("mass") - F.col(f"c{c}")) ** 2 for c in AXES)).alias("off"), "half", "eps_max", "is_leaf"))
    key = lambda: morton.interleave(*[F.least(F.floor(F.col(c) / box * 2**depth), F.lit(2**depth - 1)).cast("long") for c in AXES], depth)
    keyed = scratch.write(points.withColumn("prefix", key()))
    aimed = scratch.write(targets.withColumn("prefix", key()))
    coarse = min(depth, max(0, round(math.log(max(keyed.count(), 1) / group_size, 8))))
    aimed = aimed.select("target", *[F.col(c).alias(f"t{c}") for c in AXES], F.col("eps").alias("teps"), F.shiftright("prefix", 3 * (depth - coarse)).alias("group"))
    low, high = ({c: f(f"t{c}") for c in AXES} for f in (F.min, F.max))
    groups = scratch.write(aimed.groupBy("group").agg(
        *[((low[c] + high[c]) / 2).alias(f"g{c}") for c in AXES], (F.sqrt(sum((high[c] - low[c]) ** 2 for c in AXES)) / 2).alias("reach"), F.max("teps").alias("geps"), F.count("*").alias("n_targets"),
    ))
    front = groups.select("group", *[f"g{c}" for c in AXES], "reach", "geps", F.lit(0).cast("long").alias("prefix"))
    taken, close = [], []
    for level in range(depth + 1):
        here = nodes.where(F.col("level") == level)
        here = front.join(F.broadcast(here) if level <= 4 else here, "prefix")  # at most 8^4 nodes
        here = here.withColumn("d", F.sqrt(sum((F.col(f"m{c}") - F.col(f"g{c}")) ** 2 for c in AXES)) - F.col("reach"))
        here = here.withColumn("taken", accepts(policy, theta) & (F.col("d") > F.greatest("geps", "eps_max") + F.col("half") * math.sqrt(3.0)))
        here = scratch.write(here.select("group", *[f"g{c}" for c in AXES], "reach", "geps", "prefix", "taken", "is_leaf", *[F.when(F.col("taken"), F.col(c)).alias(c) for c in ("mass", *[f"m{c}" for c in AXES], "eps_max")]))
        taken.append(here.where("taken").select("group", "mass", *[f"m{c}" for c in AXES], F.col("eps_max").alias("eps")))
        close.append(here.where("NOT taken AND is_leaf").select("group", F.col("prefix").alias("leaf"), F.lit(level).alias("level")))
        front = here.where("NOT taken AND NOT is_leaf").select("group", *[f"g{c}" for c in AXES], "reach", "geps", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("octant"), "prefix").select(
            "group", *[f"g{c}" for c in AXES], "reach", "geps", F.shiftleft("prefix", 3).bitwiseOR(F.col("octant").cast("long")).alias("prefix")
        )
    leaves = nodes.where("is_leaf").select("level", F.col("prefix").alias("leaf"))
    levels = [r[0] for r in leaves.select("level").distinct().collect()]  # at most depth + 1 numbers
    inside = [keyed.select(F.lit(v).alias("level"), F.shiftright("prefix", 3 * (depth - v)).alias("leaf"), "item", *[F.col(c).alias(f"m{c}") for c in AXES], "mass", "eps") for v in levels]
    held = reduce(DataFrame.unionByName, inside).join(leaves, ["level", "leaf"], "left_semi")
    near = reduce(DataFrame.unionByName, close).join(held, ["level", "leaf"]).drop("level", "leaf")
    sources = reduce(DataFrame.unionByName, taken).withColumn("item", F.lit(None).cast("long")).unionByName(near)
    heavy = heavy_values(groups, "group", counted="n_targets")
    pairs = salted_join(aimed, sources, "group", ["target"], heavy).where(F.col("item").isNull() | (F.col("item") != F.col("target")))
    d = {c: F.col(f"m{c}") - F.col(f"t{c}") for c in AXES}
    pairs = pairs.withColumn("r2", sum(d[c] * d[c] for c in AXES)).withColumn("pull", g * F.col("mass") * softened_inverse_cube(F.col("r2"), F.greatest("teps", "eps")))
    found = pairs.select("target", *[(F.col("pull") * d[c]).alias(f"a{c}") for c in AXES], F.col("item").isNull().cast("int").alias("k"))
    return found.groupBy("target").agg(*[F.sum(f"a{c}").alias(f"a{c}") for c in AXES], F.sum("k").alias("n_nodes"), F.sum(1 - F.col("k")).alias("n_points"))


TILE = (8, 6144)  # targets and sources summed at once: long rows, as each step of a tile costs a call
PIECE = 50_000  # targets of one task


def pulls(target: dict[str, np.ndarray], source: dict[str, np.ndarray], g: float) -> np.ndarray:
    """The softened sum over all sources for each target (columns ax, ay, az), tile by tile. A source that is the target itself counts nothing."""
    order = np.argsort(source["item"], kind="stable")
    item, pull, e2 = (source[c][order] for c in ("item", "mass", "eps"))
    at = np.stack([source[c][order] for c in AXES])
    pull, e2 = g * pull, e2 * e2
    # targets of one softening stand together: a tile of them takes the larger softenings of its sources once
    by = np.argsort(target["eps"], kind="stable")
    here, t2 = np.stack([target[c][by] for c in AXES])[:, :, None], target["eps"][by] ** 2
    first, last = (np.searchsorted(item, target["item"][by], side) for side in ("left", "right"))
    sums = np.zeros((3, len(t2)))
    width = math.ceil(len(item) / max(1, math.ceil(len(item) / TILE[1])))  # even tiles, none of a few sources only
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for j in range(0, len(item), max(1, width)):
            cols = slice(j, min(j + width, len(item)))
            place, weight, soft = at[:, None, cols], pull[cols], e2[cols]
            room = np.empty((5, min(TILE[0], len(t2)), len(soft)))
            own = (first < cols.stop) & (last > j) & (last > first)
            for i in range(0, len(t2), TILE[0]):
                rows = slice(i, min(i + TILE[0], len(t2)))
                tile = room[:, : rows.stop - i]
                d, s, w = tile[:3], tile[3], tile[4]
                np.subtract(place, here[:, rows], out=d)
                np.multiply(d[0], d[0], out=s)
                for k in (1, 2):
                    np.multiply(d[k], d[k], out=w)
                    s += w
                s += np.maximum(soft, t2[i] if t2[i] == t2[rows.stop - 1] else t2[rows, None])
                np.sqrt(s, out=w)
                w *= s
                np.divide(weight, w, out=w)
                if own[rows].any():
                    for r in np.flatnonzero(own[rows]):
                        w[r, max(first[i + r] - j, 0) : last[i + r] - j] = 0
                sums[:, rows] += np.vecdot(d, w)
    out = np.empty((len(t2), 3))
    out[by] = sums.T
    return out


def direct_acceleration(targets: DataFrame, points: DataFrame, g: float, blocks: int = 64) -> DataFrame:
    """The direct sum over all points, for a stated set of targets: a task for each piece of the targets and block of the points sums over tiles of
    arrays, and hands on one partial sum per target. Coordinates, masses and softenings are numbers, not null."""
    spark = targets.sparkSession
    t = Scratch(spark, "direct").write(targets.select(F.col("target").cast("long").alias("item"), *[F.col(c).cast("double").alias(c) for c in (*AXES, "eps")]).where("item IS NOT NULL"))
    n_pieces, blocks = max(1, math.ceil(t.count() / PIECE)), max(blocks, parallelism(spark))
    t = t.withColumns({"piece": F.pmod(F.xxhash64("item"), F.lit(n_pieces)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    p = points.select(F.col("item").cast("long").alias("item"), *[F.col(c).cast("double").alias(c) for c in (*AXES, "mass", "eps")]).where("item IS NOT NULL")
    p = p.withColumns({"block": F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"), "piece": F.explode(F.sequence(F.lit(0), F.lit(n_pieces - 1)))})

    def partial(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = ({c: v[c].to_numpy() for c in v.column_names} for v in (left, right))
        met = np.isin(a["item"], b["item"], invert=True) if right.num_rows == 1 else np.full(left.num_rows, right.num_rows > 0)  # a target alone with itself has no row
        a = {c: v[met] for c, v in a.items()}
        found = pulls(a, b, g)
        return pa.table({"target": a["item"], **{f"a{c}": found[:, k] for k, c in enumerate(AXES)}})

    t, p = (df.repartition(blocks * n_pieces, "block", "piece").groupBy("block", "piece") for df in (t, p))
    return t.cogroup(p).applyInArrow(partial, "target long, ax double, ay double, az double").groupBy("target").agg(*[F.sum(f"a{c}").alias(f"a{c}") for c in AXES])


def mesh_density(particles: DataFrame, n: int, box: float, scheme: str = "cic") -> DataFrame:
    """(ix, iy, iz, density): mass assigned without a half-cell shift, divided by the cell's volume."""
    return mass_on_grid(particles, n, box, scheme).select("ix", "iy", "iz", (F.col("mass") / (box / n) ** 3).alias("density"))


def poisson_periodic(density: DataFrame, n: int, box: float, g: float, split: float = 0.0, deconvolve: int = 0) -> DataFrame:
    """(ix, iy, iz, phi, fx, fy, fz) of the periodic Poisson equation, by transforms over planes and lines. Points without a row are empty."""
    k = 2 * np.pi / box * np.fft.fftfreq(n, 1.0 / n)
    # the Nyquist planes have no sign, so their gradient is zero
    kk = np.where(np.abs(np.fft.fftfreq(n, 1.0 / n)) == n / 2, 0.0, k)
    s = np.sinc(np.fft.fftfreq(n))

    def solve(modes: list[np.ndarray], nx: int) -> list[np.ndarray]:
        k2 = k[nx] ** 2 + k[:, None] ** 2 + k[None, :] ** 2
        green = -4 * np.pi * g / np.where(k2 > 0, k2, 1.0) * np.exp(-k2 * split**2)
        if deconvolve:
            green = green / np.maximum((s[nx] * s[:, None] * s[None, :]) ** (2 * deconvolve), 1e-12)
        phi = modes[0] * np.where(k2 > 0, green, 0.0)
        return [phi, -1j * kk[nx] * phi, -1j * kk[:, None] * phi, -1j * kk[None, :] * phi]

    return filtered(density, n, ["density"], ["phi", "fx", "fy", "fz"], solve)


def poisson_isolated(density: DataFrame, n: int, box: float, g: float) -> DataFrame:
    """The isolated potential on a mesh padded to twice its size, kernel −1/r (0 at r = 0), forces by differences, one-sided at the edges."""
    h = box / n
    away = lambda c: F.least(F.col(c), 2 * n - F.col(c)) * h
    r = F.sqrt(sum(away(c) ** 2 for c in ("ix", "iy", "iz")))
    padded = dense(density.select("ix", "iy", "iz", "density"), 2 * n, F.when(r > 0, -1 / r).otherwise(0.0), "kernel")
    phi = Scratch(density.sparkSession, "isolated").write(filtered(padded, 2 * n, ["density", "kernel"], ["phi"], lambda m, _: [m[0] * m[1] * g * h**3], n))
    for c in ("ix", "iy", "iz"):
        w = Window.partitionBy(*[o for o in ("ix", "iy", "iz") if o != c]).orderBy(c)  # one line of the mesh
        at = lambda d: (F.lead if d > 0 else F.lag)("phi", abs(d)).over(w)  # noqa: B023, E731
        slope = F.when(F.col(c) == 0, (-3 * F.col("phi") + 4 * at(1) - at(2)) / (2 * h)).when(F.col(c) == n - 1, (3 * F.col("phi") - 4 * at(-1) + at(-2)) / (2 * h)).otherwise((at(1) - at(-1)) / (2 * h))
        phi = phi.withColumn(f"f{c[1]}", -slope)
    return phi


def interpolate_mesh(points: DataFrame, mesh: DataFrame, n: int, box: float, values: tuple[str, ...] = ("fx", "fy", "fz")) -> DataFrame:
    """(item, values): cloud-in-cell weights of the 8 surrounding mesh points. The mesh is gathered to one row per cell with the values at its corners, so
    each point is shuffled once, not once for each corner. Items are unique."""
    corner = mesh.select(*[F.col(c) for c in ("ix", "iy", "iz")], *values)
    for c in AXES:
        corner = corner.withColumn(f"o{c}", F.explode(F.array(F.lit(0), F.lit(1))))
    cell = [F.pmod(F.col(f"i{c}") - F.col(f"o{c}"), F.lit(n)).cast("int").alias(f"i{c}") for c in AXES]
    corner = corner.select(*cell, (F.col("ox") * 4 + F.col("oy") * 2 + F.col("oz")).alias("k"), *values)
    cells = corner.groupBy("ix", "iy", "iz").agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col(v))), F.lit(0.0)).alias(f"{v}_{k}") for v in values for k in range(8)])
    at = {c: (F.col(c) / box - F.floor(F.col(c) / box)) * n for c in AXES}
    near = points.where(finite(*AXES)).select("item", *[F.pmod(F.floor(v), F.lit(n)).cast("int").alias(f"i{c}") for c, v in at.items()], *[(v - F.floor(v)).alias(f"_f{c}") for c, v in at.items()])
    side = lambda c, far: F.col(f"_f{c}") if far else 1 - F.col(f"_f{c}")
    weight = [side("x", k & 4) * side("y", k & 2) * side("z", k & 1) for k in range(8)]
    return near.join(cells, ["ix", "iy", "iz"]).select("item", *[sum(w * F.col(f"{v}_{k}") for k, w in enumerate(weight)).alias(v) for v in values])


def mesh_acceleration(points: DataFrame, n: int, box: float, g: float, split: float = 0.0) -> DataFrame:
    """Assign, solve, interpolate."""
    mesh = Scratch(points.sparkSession, "mesh").write(poisson_periodic(mesh_density(points, n, box), n, box, g, split))
    return interpolate_mesh(points, mesh, n, box)


def short_range_acceleration(points: DataFrame, box: float, g: float, split: float, cutoff: float, group: str) -> DataFrame:
    """(item, ax, ay, az): what the mesh leaves out, from all pairs within the cutoff, each found once by the sweep and summed there."""

    def pull(d2: np.ndarray, a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            q = np.sqrt(d2) / (2 * split)
            s = d2 + np.maximum(a["_c1"], b["_c1"]) ** 2
            rest = np.fromiter(map(math.erfc, q.tolist()), np.float64, len(q)) + 2 * q / math.sqrt(math.pi) * np.exp(-q * q)
            return g / (s * np.sqrt(s)) * rest

    near = near_sums(points, "item", AXES, group, cutoff, box, ("mass", "eps"), pull)
    return near.select(F.col("id").alias("item"), *[F.col(f"s{c}").alias(f"a{c}") for c in AXES])


def tree_mesh_acceleration(points: DataFrame, n: int, box: float, g: float, split: float, cutoff: float, group: str) -> DataFrame:
    """Long range from the mesh plus the short-range rest."""
    far = mesh_acceleration(points, n, box, g, split).select("item", *[F.col(f"f{c}").alias(f"a{c}") for c in AXES])
    near = short_range_acceleration(points, box, g, split, cutoff, group)
    return far.unionByName(near).groupBy("item").agg(*[F.sum(f"a{c}").alias(f"a{c}") for c in AXES])


def kick(particles: DataFrame, acceleration: DataFrame, drag: float, factor: float, key: str = "particle_id") -> DataFrame:
    """v · drag + a · factor; particles without an acceleration (not active) keep their velocity."""
    a = acceleration.select(key, *[F.col(f"a{c}").alias(f"_a{c}") for c in AXES], F.lit(True).alias("_on"))
    j = particles.join(a, key, "left")
    return j.withColumns({f"v{c}": F.when(F.col("_on"), F.col(f"v{c}") * drag + F.col(f"_a{c}") * factor).otherwise(F.col(f"v{c}")) for c in AXES}).drop("_on", *[f"_a{c}" for c in AXES])


def drift(particles: DataFrame, factor: float, gas_tag: int = 1) -> DataFrame:
    """x += v · factor for particles that aren't gas; no wrap here."""
    moves = F.col("species_tag") != gas_tag
    return particles.withColumns({c: F.when(moves, F.col(c) + F.col(f"v{c}") * factor).otherwise(F.col(c)) for c in AXES})


def gravity_health(accelerations: DataFrame, most: float) -> DataFrame:
    size = F.sqrt(sum(F.col(f"a{c}") ** 2 for c in AXES))
    return accelerations.agg(F.count("*").alias("n"), count_if(~finite("ax", "ay", "az")).alias("non_finite"), F.max(size).alias("largest"), count_if(size > most).alias("over_limit"))


def slab_owner(index: Column, n: int, ranks: int) -> Column:
    """Owner of a mesh plane when n planes are dealt to ranks, the first ones taking one plane more."""
    base, extra = divmod(n, ranks)
    edge = extra * (base + 1)
    return F.when(index < edge, F.floor(index / (base + 1))).otherwise(F.lit(extra) + F.floor((index - edge) / max(base, 1))).cast("int")
