"""Domain decomposition along a space-filling curve: keys, loads, cuts, imbalance and rebalancing.

Frames of work items have item, owner, load, memory and a curve key.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nebulith.operators.skew import stitched


def weighted_load(explicit: Column, legacy: Column, fallback: Column, is_particle: Column) -> Column:
    """Explicit component load if there is one, else a positive legacy load, else a positive fallback, else 1 for a particle."""
    return F.when(explicit.isNotNull(), F.greatest(explicit, F.lit(0.0))).when(legacy > 0, legacy).when(fallback > 0, fallback).otherwise(F.when(is_particle, 1.0).otherwise(F.greatest(F.lit(1.0), fallback)))


def curve_cuts(items: DataFrame, ranks: int, key: str = "key", ident: str = "item", load: str = "load") -> DataFrame:
    """Adds ``rank``: contiguous pieces of the curve with about equal loads, at least one item each while items remain.

    A piece ends where the running load reaches target · (rank + 1). The running load is a stitched prefix sum over
    range partitions, so no task holds the curve; only one candidate position per rank goes to the driver.
    """
    one = items.withColumn("_all", F.lit(0))
    run = stitched(one, ["_all"], [key, ident], sums={"_cum": F.col(load)})
    n, total = items.agg(F.count("*"), F.sum(load)).first()
    if not n:
        return items.withColumn("rank", F.lit(0))
    active = min(ranks, n)
    step = F.floor(F.col("_cum") * active / F.lit(total))
    first = {int(r[0]): r[1] for r in run.groupBy(step.alias("k")).agg(F.min("_rn").alias("rn")).where(F.col("k").between(1, active)).collect()}
    cuts: list[int] = []
    for k in range(1, active):
        reached = min((rn for j, rn in first.items() if j >= k), default=n)
        cuts.append(min(max(reached, cuts[-1] + 1 if cuts else 1), n - (active - k)))
    # cuts in blocks of positions: a row looks at the few of its own block, the rest is a number; at most four blocks a rank
    width = max(1, n // (4 * active))
    blocks, base = [], 0
    for k in range(n // width + 1):
        end = bisect.bisect_left(cuts, (k + 1) * width, base)
        blocks.append((k, base, cuts[base:end]))
        base = end
    table = items.sparkSession.createDataFrame(blocks, "_block long, _base int, _cuts array<long>")
    placed = run.withColumn("_block", F.floor(F.col("_rn") / width)).join(F.broadcast(table), "_block")
    return placed.select(*items.columns, (F.col("_base") + F.size(F.filter("_cuts", lambda c: F.col("_rn") > c))).alias("rank"))


def load_metrics(items: DataFrame, rank: str, ranks: int, load: str = "load", memory: str = "memory") -> DataFrame:
    """Per-rank load, memory and items beside the overall imbalance; the mean divides by all ranks, also empty ones."""
    per = items.groupBy(F.col(rank).alias("rank")).agg(F.count("*").alias("n_items"), F.sum(load).alias("load"), F.sum(memory).alias("memory"))
    total = per.agg(F.max("load").alias("max_load"), (F.sum("load") / ranks).alias("mean_load"), F.max("memory").alias("max_memory"), (F.sum("memory") / ranks).alias("mean_memory"))
    return per.join(F.broadcast(total), F.lit(True)).select(  # total: one row
        "rank", "n_items", "load", "memory", F.when(F.col("mean_load") > 0, F.col("max_load") / F.col("mean_load")).otherwise(0.0).alias("load_imbalance"),
        F.when(F.col("mean_memory") > 0, F.col("max_memory") / F.col("mean_memory")).otherwise(0.0).alias("memory_imbalance"),
    )


def domain_leaves(items: DataFrame, leaves: int, key: str = "key", ident: str = "item", owner: str = "owner") -> DataFrame:
    """Per owner up to ``leaves`` equal pieces of its curve: key range, bounding box, load and count."""
    run = stitched(items, [owner], [key, ident])
    sizes = items.groupBy(owner).agg(F.count("*").alias("_n"))
    at = F.col("_rn") - 1
    k = F.least(F.lit(leaves), F.col("_n"))
    # item i belongs to the last leaf that begins at or before it; leaf j begins at floor(j n / k)
    leaf = F.floor(((at + 1) * k - 1) / F.col("_n"))
    tagged = run.join(sizes, owner).withColumn("leaf", leaf.cast("int"))
    return tagged.groupBy(owner, "leaf").agg(
        F.min(key).alias("key_begin"), F.max(key).alias("key_end"), F.count("*").alias("n"), F.sum("load").alias("load"),
        *[f(c).alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))],
    )


def neighbour_plan(ghosts: DataFrame, receiver: str, owner: str, row: str) -> DataFrame:
    """Per pair of ranks: how many rows are exchanged, the first and last of them and a digest of the list.

    The list itself stays distributed in ``ghosts``; gathering it in one row would grow with the data.
    """
    return ghosts.where(F.col(receiver) != F.col(owner)).groupBy(receiver, owner).agg(F.count("*").alias("n_rows"), F.min(row).alias("first_row"), F.max(row).alias("last_row"), F.bit_xor(row).alias("row_xor"))


def rebalance_intents(items: DataFrame, old: str, new: str, cap: float, ident: str = "item", load: str = "load") -> DataFrame:
    """Items that change owner until the migrated load would pass ``cap``, in order of ``ident``.

    The cap skips an item that would pass it and goes on with later ones, and always lets the first one
    through. With integer loads this greedy rule is the fold of one number, so each load value needs only its running
    count: candidates are folded in chunks by their order, carrying one number from chunk to chunk.
    """
    from nebulith.runtime import Scratch

    moving = Scratch(items.sparkSession, "intents").write(items.where((F.col(old) >= 0) & (F.col(old) != F.col(new))).withColumn("_all", F.lit(0)))
    run = stitched(moving, ["_all"], [ident], sums={"_cum": F.col(load)})
    # while the running sum stays at or below the cap nothing has been skipped: that prefix is taken whole
    prefix = run.where((F.col("_cum") <= cap) | (F.col("_rn") == 1))
    used = prefix.agg(F.coalesce(F.sum(load), F.lit(0.0)).cast("double"), F.max("_rn")).first()
    room, last = cap - used[0], used[1] or 0
    rest = run.where(F.col("_rn") > last)
    picked = []
    while room > 0:
        nxt = rest.where((F.col(load) <= room) & (F.col("_rn") > last)).agg(F.min("_rn")).first()[0]  # the next that still fits
        if nxt is None:
            break
        tail = stitched(rest.where((F.col("_rn") >= nxt) & (F.col(load) <= room)).drop("_cum", "_rn"), ["_all"], [ident], sums={"_cum": F.col(load)})
        fits = tail.where(F.col("_cum") <= room)
        got = fits.agg(F.sum(load).cast("double"), F.max(ident)).first()
        picked.append(fits)
        room -= got[0]
        last_item = got[1]
        rest = tail.where(F.col(ident) > last_item)
        last = 0
    out = prefix
    for p in picked:
        out = out.unionByName(p)
    return out.select(ident, old, new, load)


def ordered_sum(values: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Sum of each group in a fixed order, so that its last bits don't depend on the partitioning. For groups of bounded size, such as ranks."""
    folded = values.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("v"))
    return folded.select(by, F.aggregate("v", F.lit(0.0), lambda acc, e: acc + e[value]).alias("total"))


def agreement(measured: Column, expected: Column, absolute: float, relative: float) -> tuple[Column, Column, Column]:
    """(absolute error, relative error, agrees): a pair agrees if either error is within its tolerance."""
    err = F.abs(measured - expected)
    rel = F.when(F.abs(expected) > 0, err / F.abs(expected)).otherwise(F.when(err == 0, 0.0).otherwise(F.lit(float("inf"))))
    return err, rel, (err <= absolute) | (rel <= relative)


def mismatching_members(df: DataFrame, group: str, value: str) -> DataFrame:
    """Members whose value differs from that of their group's first member (least id): configuration consensus."""
    first = df.groupBy(group).agg(F.min_by(value, "member").alias("reference"))
    return df.join(first, group).where(~F.col(value).eqNullSafe(F.col("reference"))).select(group, "member", value, "reference")


def species_ordinal(df: DataFrame, species: str, order: str) -> DataFrame:
    """Adds ``ordinal``: the position of a row within its species, from 0; stitched, as one species may hold most rows."""
    out = stitched(df, [species], [order])
    return out.withColumn("ordinal", (F.col("_rn") - 1).cast("long")).drop("_rn")


def chunk_gaps(chunks: DataFrame, source: str, begin: str, end: str) -> DataFrame:
    """Chunks of a source that don't begin where the one before ended: gap (> 0) or overlap (< 0)."""
    w = Window.partitionBy(source).orderBy(begin, end)
    prev = F.lag(end).over(w)
    return chunks.withColumn("gap", F.col(begin) - prev).where(F.coalesce(F.col("gap"), F.lit(0)) != 0)
