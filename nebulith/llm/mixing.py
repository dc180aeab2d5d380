"""Mixing sources to target weights by cube-method balanced sampling.

Each source needs its texts m times; floor(m) copies of every text and a balanced sample for the fraction.
Inclusion probabilities move through the null space of the balancing constraints (documents and tokens)
until they are 0 or 1. Blocks of texts fly apart from each other; the two or fewer undecided texts that each block
leaves fly on together in the next level, until a small landing problem per source remains. It is landed by
flipping decided texts: the error in tokens is brought down with the texts at hand, each block having passed on a reserve.
"""

from __future__ import annotations

import bisect
import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulith.runtime import Scratch

BLOCK_DOCS = 20_000  # texts that fly in one task call
RESERVE = 200  # decided texts that a block passes on with its undecided ones, to land with, ...
RESERVE_SHARE = 0.1  # ... and at most this share of the block, so that every level is smaller than the one before
_DONE = 1e-9


def source_name(c: Column) -> Column:
    """Loose spellings of a source brought together: trimmed, lower case, words joined by one underscore."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-]+", "_")


def _step(pi: list[float], idx: list[int], u: list[float], rng: random.Random) -> None:
    up = min(((1 - pi[i]) / d if d > 0 else pi[i] / -d) for i, d in zip(idx, u) if d)
    down = min((pi[i] / d if d > 0 else (1 - pi[i]) / -d) for i, d in zip(idx, u) if d)
    go = up if rng.random() * (up + down) < down else -down
    for i, d in zip(idx, u):
        p = pi[i] + go * d
        pi[i] = 0.0 if p < _DONE else 1.0 if p > 1 - _DONE else p


def fly(pi: list[float], tokens: list[float], seed: int, land: bool) -> list[float]:
    """Moves ``pi`` with both totals kept until at most two texts are undecided; ``land`` decides these too."""
    rng = random.Random(seed)
    goal = sum(p * t for p, t in zip(pi, tokens))
    pi = list(pi)
    active = []
    for i in range(len(pi)):
        if not 0.0 < pi[i] < 1.0:
            continue
        active.append(i)
        while len(active) == 3:
            a, b, c = (tokens[j] for j in active)
            u = [c - b, a - c, b - a]
            big = max(map(abs, u))
            u = [1.0, -1.0, 0.0] if big == 0 else [x / big for x in u]
            _step(pi, active, u, rng)
            active = [j for j in active if 0.0 < pi[j] < 1.0]
    if land and active:
        while len(active) == 2:
            _step(pi, active, [1.0, -1.0], rng)
            active = [j for j in active if 0.0 < pi[j] < 1.0]
        for j in active:
            pi[j] = 1.0 if rng.random() < pi[j] else 0.0
        _flip(pi, tokens, goal)
    return pi


def _flip(pi: list[float], tokens: list[float], goal: float) -> None:
    """Flips decided texts, always the one that brings the token total nearest to ``goal``, while that helps."""
    sides = [sorted((tokens[i], i) for i in range(len(pi)) if pi[i] == v) for v in (0.0, 1.0)]  # out, in
    error = goal - sum(p * t for p, t in zip(pi, tokens))
    for _ in range(len(pi)):
        pool = sides[0] if error > 0 else sides[1]
        at = bisect.bisect(pool, (abs(error), len(pi)))
        near = min((j for j in (at - 1, at) if 0 <= j < len(pool)), key=lambda j: abs(abs(error) - pool[j][0]), default=None)
        if near is None or abs(abs(error) - pool[near][0]) >= abs(error):
            return
        size, i = pool.pop(near)
        pi[i] = 1.0 - pi[i]
        error -= math.copysign(size, error)


def _fly_group(level: int, seed: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", kind="stable")
        land = bool(group["blocks"].iloc[0] == 1)
        key = hash((seed, level, int(group["block"].iloc[0]), len(group)))
        pi = fly(group["pi"].tolist(), group["n_tokens"].astype(float).tolist(), key, land)
        carry = [0.0 < p < 1.0 for p in pi]
        if any(carry):
            for i in random.Random(key).sample(range(len(pi)), min(RESERVE, int(len(pi) * RESERVE_SHARE))):
                carry[i] = True
        return group.assign(pi=pi, carry=carry)[["doc_id", "source", "n_tokens", "whole", "pi", "carry"]]

    return run


def plan_multiplicities(supply: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """How often each source's texts are needed for the largest mixture that meets all shares within the caps.

    Sources without tokens can't be met; the others then share the total in proportion to their targets.
    """
    usable = {s: (share, cap) for s, (share, cap) in targets.items() if supply.get(s, 0) > 0 and share > 0 and cap > 0}
    if not usable:
        return {}
    total = min(cap * supply[s] / share for s, (share, cap) in usable.items())
    return {s: total * share / supply[s] for s, (share, _) in usable.items()}


def mix(docs: DataFrame, targets: dict[str, tuple[float, int]], block_docs: int = BLOCK_DOCS, seed: int = 11) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the mixture from docs(doc_id, source, n_tokens).

    Texts of sources that are null or no target, and texts without tokens, are not in the mixture. Source totals are counted
    over all texts. One source may hold most texts: it is dealt into blocks by hash. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    named = docs.select("doc_id", source_name(F.col("source")).alias("source"), "n_tokens").where((F.col("n_tokens") > 0) & F.col("source").isin(sorted(targets)))
    named = scratch.write(named)
    stats = {r["source"]: r for r in named.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()}  # at most one row per target
    need = plan_multiplicities({s: r["tokens"] for s, r in stats.items()}, targets)
    empty = spark.createDataFrame([], "doc_id long, source string, n_tokens long, copies int")
    if not need:
        return empty
    times = {s: math.floor(m + 1e-9) for s, m in need.items()}
    part = {s: max(0.0, m - times[s]) for s, m in need.items()}
    lookup = lambda values: F.create_map(*[F.lit(x) for s in sorted(values) for x in (s, values[s])])[F.col("source")]
    flying = named.where(F.col("source").isin(sorted(need))).withColumns({"whole": lookup(times), "pi": lookup({s: p if p > _DONE else 0.0 for s, p in part.items()})})
    counts = {s: stats[s]["n"] for s in need}
    settled: list[DataFrame] = []
    level = 0
    while True:
        blocks = {s: max(1, math.ceil(n / block_docs)) for s, n in counts.items()}
        n_blocks = lookup(blocks)
        dealt = flying.withColumns({"blocks": n_blocks, "block": F.pmod(F.xxhash64("doc_id", F.lit(level)), n_blocks).cast("int")})
        flown = scratch.write(dealt.groupBy("source", "block").applyInPandas(_fly_group(level, seed), "doc_id long, source string, n_tokens long, whole int, pi double, carry boolean"))
        settled.append(flown.where(~F.col("carry")))
        counts = {r["source"]: r["n"] for r in flown.where("carry").groupBy("source").agg(F.count("*").alias("n")).collect()}
        if not counts:
            break
        flying = flown.where("carry").drop("carry")
        level += 1
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    copies = (F.col("whole") + F.col("pi")).cast("int")
    return done.select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")


def mix_report(mixture: DataFrame, targets: dict[str, tuple[float, int]]) -> DataFrame:
    """Per target source: target_share, actual_share, tokens, texts and most copies of a text; a source without texts has 0."""
    spark = mixture.sparkSession
    wanted = spark.createDataFrame([(s, float(t), int(m)) for s, (t, m) in sorted(targets.items())], "source string, target_share double, max_repeats int")
    per = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_docs"), F.max("copies").alias("most_copies"))
    out = wanted.join(F.broadcast(per), "source", "left").fillna(0, ["tokens", "n_docs", "most_copies"])  # per: at most one row per target
    total = out.agg(F.sum("tokens").alias("total"))
    return out.join(F.broadcast(total), F.lit(True)).select(
        "source", "target_share", F.coalesce(F.try_divide("tokens", "total"), F.lit(0.0)).alias("actual_share"), "tokens", "n_docs", "most_copies", "max_repeats"
    )
