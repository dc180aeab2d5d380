"""All pairs of points within a distance, by strips and a sweep.

One axis (the "latitude") is cut into strips wider than the distance; a point near the upper face of its strip
is also sent to the next one. Rows are range-partitioned on (group, strip, sweep coordinate) by quantiles
sampled from the data, so crowded strips are cut as well; a cut is overlapped by the distance. Every partition is
sorted and swept: the active set holds the points of the last two bands of the sweep axis, ordered by the third
axis ("longitude"), and candidates are verified by their distance. Each pair has one owner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulith.runtime import parallelism, ship

SAMPLE_PER_CUT = 60  # sampled keys per range partition; the sample is bounded by this times the partitions
CUTS_PER_PARTITION = 3  # range pieces per partition: evens out what hashing the pieces leaves uneven
CHUNK = 200_000  # candidate pairs verified at once


def wrap(c, box: float):
    """A finite coordinate moved into [0, box)."""
    w = c - F.floor(c / F.lit(box)) * F.lit(box)
    return F.when(w >= box, w - box).otherwise(w)


#: A copy of a point is at home in its strip (1), not moved over the box's face (2), in its own range piece (4).
HOME, UNMOVED, OWN = 1, 2, 4
_COLUMNS = ("_pid", "_grp", "_strip", "_y", "_x", "_z", "_id", "_mark")


def _pairs_of(y, x, z, ids, mark, fresh, radius: float, box: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ids, smaller first, and squared distances of ``_places_of``."""
    for a, b, square in _places_of(y, x, z, ids, mark, fresh, radius, box):
        a, b = ids[a], ids[b]
        yield np.minimum(a, b), np.maximum(a, b), square


def _places_of(y, x, z, ids, mark, fresh, radius: float, box: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Verified pairs of one sorted segment, as places in it, that have a fresh end and that this segment owns.

    The owner of a pair is the only segment in which each of the three marks is borne by one of the two copies.
    """
    band = np.floor((y - y[0]) / radius).astype(np.int64)
    order = np.lexsort((x, band))
    y, x, z, ids, mark, fresh, band = (v[order] for v in (y, x, z, ids, mark, fresh, band))
    step, slack = 4.0 * box, radius * 1.0001 + 1e-9 * box
    place = band * step + x  # one sorted axis: bands far apart, longitude within
    up, n = place + step, len(x)
    own = np.arange(n)

    def between(lo, hi, floor, where=None):
        a = np.searchsorted(place, np.maximum(lo, floor), "left")
        b = np.searchsorted(place, np.minimum(hi, floor + 2 * box), "right")
        return (a, b) if where is None else (np.where(where, a, 0), np.where(where, b, 0))

    windows = [(own + 1, np.searchsorted(place, place + slack, "right")), between(up - slack, up + slack, (band + 1) * step)]
    low, high = x < slack, x > box - slack
    if high.any() or low.any():
        windows.append(between(place - box - slack, place - box + slack, band * step, high))
        windows.append(between(up - box - slack, up - box + slack, (band + 1) * step, high))
        windows.append(between(up + box - slack, up + box + slack, (band + 1) * step, low))
    for lo, hi in windows:
        counts = np.maximum(hi - lo, 0)
        ends = np.cumsum(counts)
        start = 0
        while start < n:
            base = ends[start - 1] if start else 0
            if base == ends[-1]:
                break
            stop = max(int(np.searchsorted(ends, base + CHUNK, "right")), start + 1)
            part = counts[start:stop]
            a = np.repeat(own[start:stop], part)
            b = np.arange(len(a)) - np.repeat(np.cumsum(part) - part, part) + np.repeat(lo[start:stop], part)
            start = stop
            keep = (fresh[a] | fresh[b]) & ((mark[a] | mark[b]) == 7) & (ids[a] != ids[b])
            a, b = a[keep], b[keep]
            d = np.abs(x[a] - x[b])
            d = np.minimum(d, box - d)
            e = np.abs(z[a] - z[b])
            e = np.minimum(e, box - e)
            g = y[a] - y[b]
            square = d * d + e * e + g * g
            near = square <= radius * radius
            if near.any():
                yield order[a[near]], order[b[near]], square[near]


Pull = Callable[[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]


def _sums_of(rows: dict[str, np.ndarray], carried: tuple[str, ...], pull: Pull, radius: float, box: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, sums) of one sorted segment: for each point with a pair the sum over its pairs of ``pull`` times what the other end carries first times the way to it."""
    n = len(rows["_y"])
    sums, met = np.zeros((3, n)), np.zeros(n, bool)
    weight = rows[carried[0]]
    for a, b, square in _places_of(*(rows[c] for c in ("_y", "_x", "_z", "_id", "_mark", "fresh")), radius, box):
        f = pull(square, *({c: rows[c][i] for c in carried} for i in (a, b)))
        met[a] = met[b] = True
        for k, c in enumerate(("_x", "_y", "_z")):
            d = rows[c][b] - rows[c][a]
            if c != "_y":  # images on the sweep axis are moved already
                d = np.where(d > box / 2, d - box, np.where(d < -box / 2, d + box, d))
            sums[k] += np.bincount(a, f * weight[b] * d, n) - np.bincount(b, f * weight[a] * d, n)
    at = np.flatnonzero(met)
    return at, sums[:, at]


def _sweep(radius: float | dict[int, float], box: float, carried: tuple[str, ...] = (), pull: Pull | None = None):
    """Streams sorted rows; what it holds is one batch and the active set, never a whole group. With ``pull`` it gives sums per point, else the pairs."""
    of = radius.__getitem__ if isinstance(radius, dict) else lambda _: radius

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (*_COLUMNS, *carried)}
            new["fresh"] = np.ones(batch.num_rows, bool)
            rows = {c: np.concatenate([active[c], v]) for c, v in new.items()} if active else new
            changed = sum(np.diff(rows[c]) != 0 for c in ("_pid", "_grp", "_strip")) > 0
            cut = np.flatnonzero(changed) + 1
            for s, t in zip([0, *cut], [*cut, len(rows["_y"])]):
                if t - s > 1 and pull:
                    at, sums = _sums_of({c: v[s:t] for c, v in rows.items()}, carried, pull, of(int(rows["_grp"][s])), box)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(rows["_id"][s:t][at]), *map(pa.array, sums)], names=["id", "sx", "sy", "sz"])
                elif t - s > 1:
                    for a, b, square in _pairs_of(*(rows[c][s:t] for c in ("_y", "_x", "_z", "_id", "_mark", "fresh")), of(int(rows["_grp"][s])), box):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), rows["_grp"][s])), pa.array(a), pa.array(b), pa.array(square)], names=["grp", "id_a", "id_b", "d2"])
            last = cut[-1] if len(cut) else 0
            keep = np.flatnonzero(rows["_y"][last:] >= rows["_y"][-1] - of(int(rows["_grp"][-1])) * 1.0001) + last
            active = {c: v[keep] for c, v in rows.items()}
            active["fresh"][:] = False

    return run


def _piece(bounds: np.ndarray):
    """Number of bounds at or before each (group, strip, y), by one sort of rows and bounds together."""
    grps, strips, ys = (np.array([b[i] for b in bounds]) for i in range(3)) if len(bounds) else (np.empty(0),) * 3

    def count(grp: pd.Series, strip: pd.Series, y: pd.Series) -> pd.Series:
        n, m = len(y), len(ys)
        order = np.lexsort((
            np.concatenate([np.zeros(m), np.ones(n)]), np.concatenate([ys, y.to_numpy()]),
            np.concatenate([strips.astype(np.int64), strip.to_numpy(np.int64)]), np.concatenate([grps.astype(np.int64), grp.to_numpy(np.int64)]),
        ))
        before = np.cumsum(order < m)
        out = np.empty(n + m, np.int64)
        out[order] = before
        return pd.Series(out[m:].astype(np.int32))

    return count


def near_pairs(points: DataFrame, ident: str, coords: tuple[str, str, str], group: str, radius: float | dict[int, float], box: float, partitions: int | None = None, strips: int | None = None) -> DataFrame:
    """(grp, id_a < id_b, squared distance d2) of different points of one group with periodic distance <= ``radius``.

    ``radius`` may be one number or a number for each of a few groups (groups without one have no pairs): strips, overlaps and bands
    follow each group's own, so a small sparse group doesn't widen the search in a large dense one.

    ``coords`` are (longitude, sweep axis, latitude), ``box`` their period. Defined cases: coordinates
    outside the box are wrapped; a point without three finite coordinates, an id or a group has no pair; copies of a point
    count once; points at equal places are pairs; an empty table gives no row. Ids and groups are integers.
    """
    return _swept(points, ident, coords, group, radius, box, partitions, strips)


def near_sums(points: DataFrame, ident: str, coords: tuple[str, str, str], group: str, radius: float, box: float, carried: tuple[str, ...], pull: Pull) -> DataFrame:
    """(id, sx, sy, sz): for each point with a near pair, the sum over its pairs of ``pull(d2, own, other)`` times the other's first ``carried`` column times the way to it.

    Pairs are those of ``near_pairs``; they are summed where the sweep finds them, so no row per pair is written or shuffled. ``pull`` is symmetric, of arrays of squared
    distances and of both ends' carried columns, which are numbers, not null.
    """
    partial = _swept(points, ident, coords, group, radius, box, None, None, carried, pull)
    return partial.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("sx", "sy", "sz")])


def _swept(points: DataFrame, ident: str, coords: tuple[str, str, str], group: str, radius: float | dict[int, float], box: float, partitions: int | None, strips: int | None, carried: tuple[str, ...] = (), pull: Pull | None = None) -> DataFrame:
    own = radius if isinstance(radius, dict) else {}
    if not all(0 < r < box / 4 for r in (own.values() if isinstance(radius, dict) else [radius])):
        raise ValueError("radius must be positive and under a quarter of the box")
    spark = points.sparkSession
    ship(spark)
    n = partitions or parallelism(spark)

    def cuts_of(r: float) -> int:
        c = strips or int(min(2048, box / (10 * r)))
        return c if c >= 3 else 1

    if isinstance(radius, dict):
        if not own:
            return spark.createDataFrame([], "grp long, id_a long, id_b long, d2 double")
        per = lambda f, kind: F.create_map(*[F.lit(x) for g, r in sorted(own.items()) for x in (g, f(r))])[F.col("_grp")].cast(kind)
        cuts, reach = per(cuts_of, "int"), per(lambda r: r * 1.0001, "double")
    else:
        cuts, reach = F.lit(cuts_of(radius)), F.lit(radius * 1.0001)
    width = F.lit(box) / cuts
    big = F.lit(float("inf"))
    ok = F.col(ident).isNotNull() & F.col(group).isNotNull()
    if own:
        ok = ok & F.col(group).isin(sorted(own))
    for c in coords:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < big)
    x, y, z = (wrap(F.col(c).cast("double"), box) for c in coords)
    strip = F.least(F.floor(F.col("_z") / width), cuts - 1).cast("int")
    placed = points.where(ok).select(
        F.col(group).cast("long").alias("_grp"), F.col(ident).cast("long").alias("_id"), x.alias("_x"), y.alias("_y"), z.alias("_z"), *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(carried)]
    ).withColumn("_strip", strip)
    pieces = CUTS_PER_PARTITION * n
    rows = max(points.count(), 1)
    sample = placed.select("_grp", "_strip", "_y").sample(min(1.0, SAMPLE_PER_CUT * pieces / rows), seed=7).collect()
    sample = sorted(tuple(r) for r in sample)
    bounds = sorted({sample[len(sample) * i // pieces] for i in range(1, pieces)}) if sample else []
    piece = F.pandas_udf(_piece(bounds), "int")

    here, above = F.struct(F.col("_strip").alias("s"), F.lit(HOME).alias("h")), F.struct(F.pmod(F.col("_strip") + 1, cuts).alias("s"), F.lit(0).alias("h"))
    in_strips = F.when((F.col("_z") > (F.col("_strip") + 1) * width - reach) & (cuts > 1), F.array(here, above)).otherwise(F.array(here))
    there, moved = F.struct(F.col("_y").alias("yy"), F.lit(UNMOVED).alias("u")), F.struct((F.col("_y") + box).alias("yy"), F.lit(0).alias("u"))
    images = F.when(F.col("_y") <= reach, F.array(there, moved)).otherwise(F.array(there))
    held = [f"_c{i}" for i in range(len(carried))]
    copies = placed.distinct().select("_grp", "_id", "_x", "_z", "_y", *held, F.inline(in_strips)).select(
        "_grp", "_id", "_x", "_z", *held, F.col("s").alias("_strip"), "h", F.inline(images)
    )
    spread = copies.withColumns({"_first": piece("_grp", "_strip", "yy"), "_end": piece("_grp", "_strip", F.col("yy") + reach)}).select(
        "_grp", "_id", "_x", "_z", *held, "_strip", F.col("yy").alias("_y"), "h", "u", "_first", F.explode(F.sequence("_first", "_end")).alias("_pid")
    )
    marked = spread.select("_pid", "_grp", "_strip", "_y", "_x", "_z", "_id", (F.col("h") + F.col("u") + F.when(F.col("_pid") == F.col("_first"), OWN).otherwise(0)).alias("_mark"), *held)
    ordered = marked.repartition(n, "_pid").sortWithinPartitions("_pid", "_grp", "_strip", "_y")
    if pull:
        return ordered.mapInArrow(_sweep(radius, box, tuple(held), pull), "id long, sx double, sy double, sz double")
    return ordered.mapInArrow(_sweep(radius, box), "grp long, id_a long, id_b long, d2 double")
