"""The tree walk over arrays: blocks of space exchange the parts of their trees that the others need.

The box is cut into blocks of the octree with about as many points each. The task of a block builds the tree below it and sends to every
other block what may be opened there: all nodes down to those that every place in that block accepts, and the points of leaves
that are met. The task of the receiving block walks groups of its targets down what it was sent, and sums over arrays.
No row is made for a pair of target and source, or of group and node.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulith.functions import morton
from nebulith.operators.gravity import AXES, LEAF_SIZE, pulls, tree_nodes
from nebulith.runtime import parallelism

BLOCK = (4_000, 64_000)  # points of a block: least and most, but for where more crowd in one cell of the finest blocks
FINER = 3  # levels of blocks below those of even density
GROUPS = 256  # groups of targets that walk at once
NODE = -(2**63)  # the item of a node
_NODE = {"level": np.int64, "prefix": np.int64, "mx": float, "my": float, "mz": float, "mass": float, "eps": float, "off": float, "sent": np.int64}
_POINT = {"item": np.int64, **{c: float for c in (*AXES, "mass", "eps")}}


def _accepts(policy: str, theta: float, half, d, off, eps):
    """As ``gravity.accepts``, for arrays, and never inside the softening."""
    far = 2 * half < theta * d if policy == "geometric" else 2 * half / theta + off < d
    return far & (d > eps + half * math.sqrt(3.0))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), first[1], ..."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def _children(level: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of nodes ordered by level and prefix: place of the first child, and how many."""
    low, count = np.zeros(len(level), np.int64), np.zeros(len(level), np.int64)
    start = np.searchsorted(level, np.arange(level[-1] + 3))
    for v in range(level[0], level[-1]):
        own, below = slice(start[v], start[v + 1]), prefix[start[v + 1] : start[v + 2]] >> 3
        low[own] = start[v + 1] + np.searchsorted(below, prefix[own], "left")
        count[own] = start[v + 1] + np.searchsorted(below, prefix[own], "right") - low[own]
    return low, count


def _groups(prefix: np.ndarray, coarse: int, depth: int, crowd: int) -> np.ndarray:
    """Places of the first targets of groups: cells of level ``coarse``, and finer ones where more than ``crowd`` targets are in one."""
    begins, crowded = np.arange(len(prefix)) == 0, np.ones(len(prefix), bool)
    for level in range(coarse, depth + 1):
        begins |= crowded & np.concatenate([[True], np.diff(prefix >> 3 * (depth - level)) != 0])
        n = np.diff(np.concatenate([np.flatnonzero(begins), [len(prefix)]]))
        crowded = np.repeat(n > crowd, n)
        if not crowded.any():
            break
    return np.flatnonzero(begins)


def _subtree(p: dict[str, np.ndarray], top: int, depth: int, leaf_size: int, box: float) -> dict[str, np.ndarray]:
    """Nodes, ordered by level and prefix, of the tree of points ordered by ``prefix`` that lie in one cell of level ``top``; ``at`` is the place of a node's first point."""
    parts, on = [], np.arange(len(p["prefix"]))
    moments = [p["mass"], *[p["mass"] * p[c] for c in AXES]]
    for level in range(top, depth + 1):
        key = p["prefix"][on] >> 3 * (depth - level)
        first = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
        n = np.diff(np.concatenate([first, [len(on)]]))
        mass, sx, sy, sz = (np.add.reduceat(m[on], first) for m in moments)
        with np.errstate(divide="ignore", invalid="ignore"):
            m = {f"m{c}": s / mass for c, s in zip(AXES, (sx, sy, sz))}
        parts.append({"level": np.full(len(first), level), "prefix": key[first], **m, "mass": mass, "eps": np.maximum.reduceat(p["eps"][on], first), "n": n, "at": on[first]})
        on = on[np.repeat(n > leaf_size, n)]
        if not len(on):
            break
    t = {c: np.concatenate([v[c] for v in parts]) for c in parts[0]}
    t["half"] = box / 2 / 2.0 ** t["level"]
    t["off"] = _offset(t)
    t["is_leaf"] = (t["n"] <= leaf_size) | (t["level"] == depth)
    t["low"], t["count"] = _children(t["level"], t["prefix"])
    return t


def _offset(t: dict[str, np.ndarray]) -> np.ndarray:
    """Distance of the centre of mass from that of the cell."""
    cell = [sum(((t["prefix"] >> (3 * i + 2 - k)) & 1) << i for i in range(int(t["level"].max()) + 1)) for k in range(3)]
    return np.sqrt(sum((t[f"m{c}"] - (2 * q + 1) * t["half"]) ** 2 for c, q in zip(AXES, cell)))


def tree_walk(targets: DataFrame, points: DataFrame, box: float, depth: int, g: float, theta: float = 0.6, policy: str = "geometric", leaf_size: int = LEAF_SIZE, group_size: int = LEAF_SIZE, block: int | None = None, crowd: int = 4 * LEAF_SIZE) -> DataFrame:
    """(target, ax, ay, az, n_nodes, n_points): as ``gravity.tree_acceleration`` with the nodes of ``gravity.tree_nodes``, and for any number of points.

    Groups are the targets in one cell of the curve, within their block; those of more than ``crowd`` targets are cut to finer cells. Coordinates lie in [0, box]; they, masses and softenings are numbers, not null.
    To the driver go a few numbers per block.
    """
    spark = targets.sparkSession
    key = morton.interleave(*[F.least(F.floor(F.col(c) / box * 2**depth), F.lit(2**depth - 1)).cast("long") for c in AXES], depth)
    total = points.count()
    block = block or min(BLOCK[1], max(BLOCK[0], total // (2 * parallelism(spark))))
    finest = min(depth, max(0, math.ceil(math.log(max(total / block, 1), 8))) + FINER)
    coarse = min(depth, max(0, round(math.log(max(total, 1) / group_size, 8))))
    names = ["level", "prefix", *[f"s{c}" for c in AXES], "mass", "eps_max", "n", "is_leaf"]
    above = sorted(tree_nodes(points, finest, box, block).select(*names).collect())  # some numbers per block
    widest = targets.agg(F.max("eps")).first()[0]
    if not above or widest is None:
        return spark.createDataFrame([], "target long, ax double, ay double, az double, n_nodes long, n_points long")
    up = {c: np.array([r[c] for r in above]) for c in ("level", "prefix", "mass", "n")} | {"eps": np.array([r["eps_max"] for r in above])}
    with np.errstate(divide="ignore", invalid="ignore"):
        up |= {f"m{c}": np.array([r[f"s{c}"] for r in above]) / up["mass"] for c in AXES}
    up["half"] = box / 2 / 2.0 ** up["level"]
    up["off"] = _offset(up)
    up["is_block"] = np.array([r["is_leaf"] for r in above])
    up["low"], up["count"] = _children(up["level"], up["prefix"])
    tops = np.flatnonzero(up["is_block"])
    tops = tops[np.argsort(up["prefix"][tops] << 3 * (depth - up["level"][tops]))]  # blocks in order of the curve
    begin = up["prefix"][tops] << 3 * (depth - up["level"][tops])
    # a group's ball lies in its block, but for less than the diagonal of a half face of the group's cell
    cell = [sum(((up["prefix"][tops] >> (3 * i + 2 - k)) & 1) << i for i in range(finest + 1)) for k in range(3)]
    spare = math.sqrt(2.0) * box / 2 / 2.0 ** np.maximum(coarse, up["level"][tops]) + 1e-9 * box
    low = [2 * q * up["half"][tops] - spare for q in cell]
    high = [(2 * q + 2) * up["half"][tops] + spare for q in cell]

    def taken(m, half, off, eps, b: np.ndarray) -> np.ndarray:
        """Nodes that every group of block ``b`` takes; a little less than those, for rounding."""
        gap = [np.maximum(0, np.maximum(low[k][b] - m[k], m[k] - high[k][b])) for k in range(3)]
        d = np.sqrt(gap[0] ** 2 + gap[1] ** 2 + gap[2] ** 2) * (1 - 1e-9) - 1e-9 * box
        return _accepts(policy, theta, half, d, off, np.maximum(eps, widest))

    ways: dict[int, int] = {}
    for node in range(len(above)):
        for child in range(up["low"][node], up["low"][node] + up["count"][node]):
            ways[child] = node

    def block_of(prefix: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(begin, prefix.to_numpy(), "right") - 1)

    def sent(table: pa.Table) -> pa.Table:
        p = {c: table[c].to_numpy() for c in table.column_names if c != "block"}
        order = np.argsort(p["prefix"], kind="stable")
        p = {c: v[order] for c, v in p.items()}
        top = tops[table["block"][0].as_py()]
        # blocks that open every node on the way to this one, and this one; it is one of them itself
        to, node = np.arange(len(tops)), top
        while len(to):
            to = to[~taken([up[f"m{c}"][node] for c in AXES], up["half"][node], up["off"][node], up["eps"][node], to)]
            if node not in ways:
                break
            node = ways[node]
        t = _subtree(p, int(up["level"][top]), depth, leaf_size, box)
        near, nodes, opened = to, np.zeros(len(to), np.int64), []
        while len(near):
            ok = taken([t[f"m{c}"][nodes] for c in AXES], t["half"][nodes], t["off"][nodes], t["eps"][nodes], near)
            opened.append((near, nodes, ~ok & t["is_leaf"][nodes]))
            go = ~ok & ~t["is_leaf"][nodes]
            near, nodes = np.repeat(near[go], t["count"][nodes[go]]), _ranges(t["low"][nodes[go]], t["count"][nodes[go]])
        near, nodes, met = (np.concatenate([o[k] for o in opened]) for k in range(3))
        order = np.argsort(near, kind="stable")
        near, nodes, met = near[order], nodes[order], met[order]
        cut, rows = np.flatnonzero(np.diff(near)) + 1, {"block": [], "nodes": [], "points": []}
        for i, j in zip([0, *cut], [*cut, len(near)]):
            own, full = nodes[i:j], met[i:j]
            held = _ranges(t["at"][own[full]], t["n"][own[full]])
            out = {c: t[c][own] for c in _NODE if c != "sent"} | {"sent": np.where(full, t["n"][own], 0)}
            rows["block"].append(int(near[i]))
            rows["nodes"].append(b"".join(np.ascontiguousarray(out[c], kind).tobytes() for c, kind in _NODE.items()))
            rows["points"].append(b"".join(np.ascontiguousarray(p[c][held], kind).tobytes() for c, kind in _POINT.items()))
        return pa.table({"block": pa.array(rows["block"], pa.int64()), "nodes": pa.array(rows["nodes"], pa.binary()), "points": pa.array(rows["points"], pa.binary())})

    def unpacked(packs, kinds: dict) -> list[dict[str, np.ndarray]]:
        return [{c: np.frombuffer(b, kind, len(b) // (8 * len(kinds)), k * (len(b) // len(kinds))) for k, (c, kind) in enumerate(kinds.items())} for b in packs]

    def walked(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({c: pa.array([], pa.float64() if c[0] == "a" else pa.int64()) for c in ("target", "ax", "ay", "az", "n_nodes", "n_points")})
        a = {c: left[c].to_numpy() for c in left.column_names if c != "block"}
        order = np.argsort(a["prefix"], kind="stable")
        a = {c: v[order] for c, v in a.items()}
        first = _groups(a["prefix"], coarse, depth, crowd)
        last = np.concatenate([first[1:], [len(order)]])
        lo, hi = ([f.reduceat(a[c], first) for c in AXES] for f in (np.minimum, np.maximum))
        mid = [(u + v) / 2 for u, v in zip(lo, hi)]
        reach, geps = np.sqrt(sum((v - u) ** 2 for u, v in zip(lo, hi))) / 2, np.maximum.reduceat(a["eps"], first)
        # the tree as far as it was sent; nodes above the blocks, and those of blocks that are taken whole, are known everywhere
        parts = unpacked(right["nodes"].to_pylist(), _NODE)
        points_of = unpacked(right["points"].to_pylist(), _POINT)
        come = {(int(v["level"][0]), int(v["prefix"][0])) for v in parts}
        known = np.array([(int(v), int(q)) not in come for v, q in zip(up["level"], up["prefix"])])
        parts = [{c: up[c][known] if c != "sent" else np.zeros(known.sum(), np.int64) for c in _NODE}, *parts]
        t = {c: np.concatenate([v[c] for v in parts]) for c in _NODE}
        p = {c: np.concatenate([v[c] for v in points_of]) if points_of else np.empty(0, kind) for c, kind in _POINT.items()}
        t["at"] = np.cumsum(t["sent"]) - t["sent"]
        order = np.lexsort((t["prefix"], t["level"]))
        t = {c: v[order] for c, v in t.items()}
        t["low"], t["count"] = _children(t["level"], t["prefix"])
        half = box / 2 / 2.0 ** t["level"]
        rows, counts = np.zeros((len(a["item"]), 3)), np.zeros((2, len(a["item"])), np.int64)
        for start in range(0, len(first), GROUPS):
            group = np.arange(start, min(start + GROUPS, len(first)))
            node, far, close = np.zeros(len(group), np.int64), [], []
            while len(group):
                d = np.sqrt(sum((t[f"m{c}"][node] - mid[k][group]) ** 2 for k, c in enumerate(AXES))) - reach[group]
                ok = _accepts(policy, theta, half[node], d, t["off"][node], np.maximum(geps[group], t["eps"][node]))
                met = ~ok & (t["sent"][node] > 0)
                far.append((group[ok], node[ok]))
                close.append((group[met], node[met]))
                go = ~ok & ~met
                group, node = group[go], node[go]
                if (t["count"][node] == 0).any():
                    raise ValueError("a node that must be opened wasn't sent")
                group, node = np.repeat(group, t["count"][node]), _ranges(t["low"][node], t["count"][node])
            (fg, fn), (cg, cn) = ([np.concatenate(v) for v in zip(*pairs)] for pairs in (far, close))
            order = np.argsort(fg, kind="stable")
            fg, fn = fg[order], fn[order]
            order = np.lexsort((t["at"][cn], cg))
            cg, cn = cg[order], cn[order]
            for i in range(start, min(start + GROUPS, len(first))):
                own = fn[np.searchsorted(fg, i) : np.searchsorted(fg, i, "right")]
                leaf = cn[np.searchsorted(cg, i) : np.searchsorted(cg, i, "right")]
                held = _ranges(t["at"][leaf], t["sent"][leaf])
                source = {"item": np.concatenate([np.full(len(own), NODE), p["item"][held]])} | {c: np.concatenate([t[v][own], p[c][held]]) for c, v in (*((c, f"m{c}") for c in AXES), ("mass", "mass"), ("eps", "eps"))}
                aim = slice(first[i], last[i])
                rows[aim] = pulls({c: v[aim] for c, v in a.items()}, source, g)
                counts[0, aim] = len(own)
                there = np.sort(p["item"][held])
                counts[1, aim] = len(held) - (np.searchsorted(there, a["item"][aim], "right") - np.searchsorted(there, a["item"][aim]))
        kept = counts.sum(0) > 0
        return pa.table({"target": a["item"][kept], **{f"a{c}": rows[kept, k] for k, c in enumerate(AXES)}, "n_nodes": counts[0, kept], "n_points": counts[1, kept]})

    in_block = F.pandas_udf(block_of, "long")
    p = points.select(F.col("item").cast("long").alias("item"), *[F.col(c).cast("double").alias(c) for c in (*AXES, "mass", "eps")], key.alias("prefix")).withColumn("block", in_block("prefix"))
    packs = p.repartition(len(tops), "block").groupBy("block").applyInArrow(sent, "block long, nodes binary, points binary")
    a = targets.select(F.col("target").cast("long").alias("item"), *[F.col(c).cast("double").alias(c) for c in (*AXES, "eps")], key.alias("prefix")).withColumn("block", in_block("prefix"))
    pair = [df.repartition(len(tops), "block").groupBy("block") for df in (a, packs)]
    return pair[0].cogroup(pair[1]).applyInArrow(walked, "target long, ax double, ay double, az double, n_nodes long, n_points long")
