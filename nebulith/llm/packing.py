"""Filling fixed-capacity containers: vector bin packing by the dot-product heuristic.

An item is a vector (tokens, one segment, loss-bearing tokens) and a container limits all three at once. Items are dealt by hash into
blocks of bounded size; in each block containers are filled one after the other. A container opens with the item whose dot product with
the room, weighted by what is left to pack, is largest. Then items are taken whose direction is nearest (the dot product over the
item's length) to what the container should still take if it is to hold its part of everything left, so that neither large nor
small nor loss-heavy items are left over. It closes with the one or two items that fill it most.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulith.runtime import Scratch

BLOCK_ITEMS = 5_000  # items packed in one task call, whatever the table's size
TOKENS_PER_SEGMENT = 128  # a container of c tokens takes at most c / 128 segments
LOSS_SHARE = 0.9  # ... and at most this share of c in loss-bearing tokens
CLOSING = 2.5  # segments still planned for a container, below which its last items are chosen together
FILL_WEIGHT = 20.0  # how much filling counts against direction when a container is closed


def pack_block(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container number of each item of ``sizes`` (items × dimensions); an item that fits no empty container is an error."""
    if len(sizes) and (sizes > limits).any():
        raise ValueError(f"{int((sizes > limits).any(axis=1).sum())} items exceed the limits {limits.tolist()} of an empty container")
    kinds, which = np.unique(sizes, axis=0, return_inverse=True)
    which = which.reshape(-1)
    left, order = np.bincount(which, minlength=len(kinds)), np.argsort(which, kind="stable")
    nxt = np.searchsorted(which[order], np.arange(len(kinds)))
    every, relative = kinds.astype(float), kinds / limits
    length = np.sqrt((relative**2).sum(axis=1))
    out = np.empty(len(sizes), np.int64)
    alive = np.arange(len(kinds))  # kinds with items left, by tokens
    box = -1
    while len(alive):
        box += 1
        room = limits.astype(float)
        live, rel, size, count = every[alive], relative[alive], length[alive], left[alive]
        tokens, loss = live[:, 0], live[:, 2]
        lightest = np.searchsorted(tokens, tokens, "left")  # of the kinds with as many tokens the one with the least loss
        demand = rel.T @ count
        demand = demand / demand.max()
        plan = demand.copy()  # what the container should still take, relative to its limits
        while room[1] >= 1 and room[0] > 0:
            top = int(np.searchsorted(tokens, room[0], "right"))
            fits = (loss[:top] <= room[2]) & (count[:top] > 0)
            if not fits.any():
                break
            goal = np.minimum(np.maximum(plan, 1e-9), room / limits)
            if room[1] == limits[1]:
                score = rel[:top] @ (room / limits * demand)
                picks = [int(np.where(fits, score, -1.0).argmax())]
            elif goal[1] * limits[1] >= CLOSING:
                score = (rel[:top] @ goal) / size[:top]
                picks = [int(np.where(fits, score, -1.0).argmax())]
            else:
                i = np.flatnonzero(fits)
                j = np.searchsorted(tokens, room[0] - tokens[i], "right") - 1
                two = (j >= 0) & (room[1] >= 2)
                j = lightest[np.maximum(j, 0)]
                two &= (count[j] > (i == j)) & (loss[i] + loss[j] <= room[2])
                both = rel[i] + np.where(two[:, None], rel[j], 0.0)
                score = FILL_WEIGHT * both[:, 0] * limits[0] / room[0] + (both @ goal) / np.sqrt((both**2).sum(axis=1))
                best = int(score.argmax())
                picks = [int(i[best]), *([int(j[best])] if two[best] else [])]
            for p in picks:
                k = alive[p]
                out[order[nxt[k]]] = box
                nxt[k] += 1
                left[k] -= 1
                count[p] -= 1
                room -= live[p]
                plan = plan - rel[p]
        alive = alive[count > 0]
    return out


def _pack_group(limit_of: dict[int, tuple[int, int, int]]):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "part"], kind="stable")
        spec, block = int(group["spec_id"].iloc[0]), int(group["block"].iloc[0])
        sizes = np.stack([group["n_tokens"].to_numpy(), np.ones(len(group), np.int64), group["n_loss"].to_numpy()], axis=1)
        boxes = pack_block(sizes, np.array(limit_of[spec], float))
        group["container_id"] = [f"{spec}-{block}-{b}" for b in boxes]
        return group[["spec_id", "container_id", "doc_id", "part", "n_tokens", "n_loss"]]

    return run


def limits_of(capacity: int, loss_share: float = LOSS_SHARE) -> tuple[int, int, int]:
    """Tokens, segments and loss-bearing tokens that a container of ``capacity`` takes."""
    return capacity, max(1, capacity // TOKENS_PER_SEGMENT), max(1, int(capacity * loss_share))


def pack(counts: DataFrame, capacities: dict[int, int], block_items: int = BLOCK_ITEMS, loss_share: float = LOSS_SHARE) -> DataFrame:
    """(spec_id, container_id, doc_id, part, n_tokens, n_loss): each text once per capacity.

    A text over the capacity is split into full parts, each a container of its own, and a rest that is packed like a
    text; no other text is split. A text without tokens needs no room: container_id is null, part 0. Loss-bearing
    tokens of a split text are counted from its end. Limits of a container: tokens, capacity/128 segments and
    ``loss_share`` of the capacity in loss-bearing tokens. A text or part that alone bears more loss than that has a container of its
    own, the only one that may pass the limit: it can't be split, and no other text is to add to it. ``counts`` needs one row per text.
    """
    scratch = Scratch(counts.sparkSession, "pack")
    limits = {s: limits_of(c, loss_share) for s, c in capacities.items()}
    specs = F.array(*[F.struct(F.lit(s).alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in sorted(capacities.items())])
    each = counts.select("doc_id", F.col("n_tokens").alias("all_tokens"), F.col("n_loss").alias("all_loss"), F.inline(specs))
    n_parts = F.greatest(F.lit(1), F.ceil(F.col("all_tokens") / F.col("capacity"))).cast("int")
    parts = each.withColumn("n_parts", n_parts).select("*", F.explode(F.sequence(F.lit(1), F.col("n_parts"))).alias("part"))
    start = (F.col("part") - 1) * F.col("capacity")
    size = F.least(F.col("capacity"), F.col("all_tokens") - start)
    bare = F.col("all_tokens") - F.col("all_loss")  # tokens before the first loss-bearing one
    loss = F.greatest(F.lit(0), F.least(size, start + size - bare))
    items = scratch.write(parts.select("spec_id", "doc_id", "part", size.alias("n_tokens"), loss.alias("n_loss"), "capacity"))
    most_loss = F.create_map(*[F.lit(x) for s in sorted(capacities) for x in (s, limits[s][2])])[F.col("spec_id")]
    whole, heavy = F.col("n_tokens") == F.col("capacity"), F.col("n_loss") > most_loss
    own = lambda name: F.concat_ws("-", F.col("spec_id"), F.lit(name), "doc_id", "part")
    alone = items.where(whole | heavy | (F.col("n_tokens") == 0)).select(
        "spec_id", F.when(whole, own("full")).when(heavy, own("loss")).alias("container_id"), "doc_id",
        F.when(F.col("n_tokens") > 0, F.col("part")).otherwise(0).alias("part"), "n_tokens", "n_loss",
    )
    rest = items.where(~whole & ~heavy & (F.col("n_tokens") > 0))
    blocks = {r["spec_id"]: max(1, math.ceil(r["n"] / block_items)) for r in rest.groupBy("spec_id").agg(F.count("*").alias("n")).collect()}
    n_blocks = F.create_map(*[F.lit(x) for s in sorted(capacities) for x in (s, blocks.get(s, 1))])[F.col("spec_id")]
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "part"), n_blocks).cast("int"))
    packed = dealt.groupBy("spec_id", "block").applyInPandas(_pack_group(limits), "spec_id int, container_id string, doc_id long, part int, n_tokens long, n_loss long")
    return packed.unionByName(alone)


def pack_report(packed: DataFrame, capacities: dict[int, int], loss_share: float = LOSS_SHARE) -> DataFrame:
    """Per capacity: containers, texts, tokens, share of the space used, the most segments and loss-bearing tokens of a shared container, and the
    shares of containers at each limit: tokens and loss-bearing tokens within 1 % of it, segments at it. alone_share: containers of one text
    or part that is as long as the capacity or bears more loss than the limit."""
    at = lambda i: F.create_map(*[F.lit(x) for s, c in sorted(capacities.items()) for x in (s, limits_of(c, loss_share)[i])])[F.col("spec_id")]
    alone = F.col("container_id").rlike("-(full|loss)-")
    boxes = packed.where("container_id IS NOT NULL").groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("segments"), F.sum("n_loss").alias("l"))
    boxes = boxes.withColumns({"alone": alone, "_t": F.col("t") >= 0.99 * at(0), "_s": F.col("segments") >= at(1), "_l": F.col("l") >= 0.99 * at(2)})
    share = lambda c: F.avg(F.when(~F.col("alone"), F.col(c).cast("double")))
    return boxes.groupBy("spec_id").agg(
        F.count("*").alias("n_containers"), F.sum("segments").alias("n_parts"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"),
        F.max(F.when(~F.col("alone"), F.col("segments"))).alias("most_segments"), F.max(F.when(~F.col("alone"), F.col("l"))).alias("most_loss"),
        share("_t").alias("full_share"), share("_s").alias("at_segments_share"), share("_l").alias("at_loss_share"), F.avg(F.col("alone").cast("double")).alias("alone_share"),
    ).withColumn("used_share", F.col("n_tokens") / (F.col("n_containers") * at(0)))


def pack_checks(counts: DataFrame, packed: DataFrame, capacities: dict[int, int], loss_share: float = LOSS_SHARE) -> DataFrame:
    """(spec_id, n_texts, all_placed, none_split, limits_kept) of a packing of ``counts``: texts found in it; whether each has all its tokens
    and loss-bearing tokens, whether none that fits is in parts, and whether no shared container passes a limit."""
    at = lambda i: F.create_map(*[F.lit(x) for s, c in sorted(capacities.items()) for x in (s, limits_of(c, loss_share)[i])])[F.col("spec_id")]
    texts = packed.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("t"), F.sum("n_loss").alias("l"), F.count("*").alias("parts")).join(counts, "doc_id", "left")
    per_text = texts.groupBy("spec_id").agg(
        F.count("*").alias("n_texts"), F.bool_and(F.coalesce((F.col("t") == F.col("n_tokens")) & (F.col("l") == F.col("n_loss")), F.lit(False))).alias("all_placed"), F.bool_and((F.col("parts") == 1) | (F.col("t") > at(0))).alias("none_split"),
    )
    boxes = packed.where(F.col("container_id").isNotNull() & ~F.col("container_id").rlike("-(full|loss)-")).groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("t"), F.sum("n_loss").alias("l"), F.count("*").alias("s"))
    per_box = boxes.groupBy("spec_id").agg(F.bool_and((F.col("t") <= at(0)) & (F.col("s") <= at(1)) & (F.col("l") <= at(2))).alias("limits_kept"))
    return per_text.join(per_box, "spec_id", "left").withColumn("limits_kept", F.coalesce("limits_kept", F.lit(True)))
