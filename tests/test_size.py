"""What failed on larger tables: plans and methods that only sizes beyond the test tables show."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from nebulith.operators import gravity as G
from nebulith.operators import spatial, state
from nebulith.runtime import Scratch

DATA = "/root/testdata/sf0.001"


def _clumped(spark, seed=3):
    """A dense clump of cells, a few lone ones, and points in, beside and far outside the clump; in step 2 hardly any cell."""
    rng = np.random.default_rng(seed)
    cells = np.concatenate([rng.normal(20, 0.4, (400, 3)), rng.uniform(0, 100, (40, 3)), np.full((6, 3), 70.0), [[30.0, 30, 30], [90, 90, 90]]])
    steps = [1] * 446 + [2] * 2
    points = np.concatenate([rng.normal(20, 0.5, (20, 3)), rng.uniform(0, 100, (20, 3)), rng.uniform(-150, 300, (10, 3)), [[70.0, 70, 70]], rng.uniform(0, 100, (3, 3))])
    at = [1] * 51 + [2] * 3
    s = spark.createDataFrame([(t, i, *map(float, p)) for i, (t, p) in enumerate(zip(at, points))], "snap_step long, star long, x double, y double, z double")
    c = spark.createDataFrame([(t, 1000 + i, *map(float, p)) for i, (t, p) in enumerate(zip(steps, cells))], "snap_step long, cell long, cx double, cy double, cz double")
    want = []
    for i, (t, p) in enumerate(zip(at, points)):
        d2 = sorted((sum((float(a) - float(b)) ** 2 for a, b in zip(p, q)), 1000 + j) for j, (u, q) in enumerate(zip(steps, cells)) if u == t)
        want += [(i, cell, round(d, 9), r + 1) for r, (d, cell) in enumerate(d2[:4])]
    return s, c, sorted(want)


def test_nearest_cells_repeats_no_point_into_a_broadcast(spark, monkeypatch):
    plans, write = [], Scratch.write

    def noted(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df)

    monkeypatch.setattr(Scratch, "write", noted)
    s, c, want = _clumped(spark)
    out = spatial.nearest_cells(s, c, 4, 100.0, "snap_step").collect()
    assert sorted((r["star"], r["cell"], round(r["d2"], 9), r["rank"]) for r in out) == want
    assert not [p for p in plans if "BroadcastExchange" in p and "Generate explode" in p]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
@pytest.mark.parametrize("name", ["jn05_feedback_weights", "ph09_feedback_deposit"])
def test_feedback_repeats_no_star_into_a_broadcast(spark, monkeypatch, name):
    from nebulith.plans import registry

    plans, write = [], Scratch.write

    def noted(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df)

    monkeypatch.setattr(Scratch, "write", noted)
    assert registry.queries()[name](spark, DATA).count()
    assert not [p for p in plans if "BroadcastExchange" in p and "Generate explode" in p]


def _pull_table(spark, n=300, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, *map(float, rng.uniform(0, 10, 3)), float(rng.uniform(0, 2)), float(rng.choice([0.0, 0.1, 0.5]))) for i in range(n)]
    rows += [(n, *rows[0][1:5], 0.5), (n + 1, 1.0, 1.0, 1.0, 1.0, 0.0)]  # a softened point at another's place, an unsoftened one
    return rows, spark.createDataFrame(rows, "item long, x double, y double, z double, mass double, eps double")


def test_direct_sum_makes_no_row_per_pair(spark):
    table, p = _pull_table(spark)
    asked = p.where("item % 7 = 0 OR item > 298").select(F.col("item").alias("target"), "x", "y", "z", "eps")
    df = G.direct_acceleration(asked, p, 2.0, 3)
    got = {r["target"]: [r["ax"], r["ay"], r["az"]] for r in df.collect()}
    assert sorted(got) == [i for i in range(302) if i % 7 == 0 or i > 298]
    for i, a in got.items():
        want = [0.0] * 3
        for j, *q, m, e in table:
            if j != i:
                d = [u - v for u, v in zip(q, table[i][1:4])]
                want = [w + 2 * m * c * (sum(v * v for v in d) + max(e, table[i][5]) ** 2) ** -1.5 for w, c in zip(want, d)]
        assert np.allclose(a, want, rtol=1e-11, atol=1e-11)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan


def test_direct_sum_takes_the_softenings_of_a_tile_once(monkeypatch):
    """The larger softenings aren't taken pair by pair, and the sums are right across edges of tiles, where softenings change and where all differ."""
    rng = np.random.default_rng(8)
    n, m = 700, 61
    source = {c: rng.uniform(0, 10, n) for c in "xyz"} | {"item": rng.permutation(n), "mass": rng.uniform(0, 1, n), "eps": rng.choice([0.02, 0.1, 0.5], n)}
    asked = rng.choice(n, m, replace=False)
    target = {c: source[c][asked] for c in (*"xyz", "item", "eps")}
    made, maximum = [], np.maximum

    def noted(*a, **k):
        found = maximum(*a, **k)
        made.append(np.size(found))
        return found

    def right():
        for i, k in enumerate(asked):
            d = np.stack([source[c] - source[c][k] for c in "xyz"])
            w = 2.0 * source["mass"] * ((d**2).sum(0) + maximum(source["eps"], target["eps"][i]) ** 2) ** -1.5
            yield (np.delete(w, k) * np.delete(d, k, 1)).sum(1)

    monkeypatch.setattr(G, "TILE", (8, 256))
    monkeypatch.setattr(np, "maximum", noted)
    assert np.allclose(G.pulls(target, source, 2.0), list(right()), rtol=1e-11, atol=1e-11)
    assert sum(made) < n * m / 2
    target["eps"] = rng.uniform(0, 1, m)
    assert np.allclose(G.pulls(target, source, 2.0), list(right()), rtol=1e-11, atol=1e-11)


def test_direct_sum_at_one_place_and_alone(spark):
    """Without softening a pair at one place is no number, as in SQL; a point alone has no row."""
    p = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0, 0.0), (2, 1.0, 1.0, 1.0, 1.0, 0.0), (3, 2.0, 1.0, 1.0, 1.0, 0.0)], "item long, x double, y double, z double, mass double, eps double")
    asked = p.select(F.col("item").alias("target"), "x", "y", "z", "eps")
    got = {r["target"]: r["ax"] for r in G.direct_acceleration(asked, p, 1.0, 2).collect()}
    assert np.isnan(got[1]) and np.isnan(got[2]) and got[3] == -2.0
    assert not G.direct_acceleration(asked, p.where("item = 1"), 1.0, 2).where("target = 1").collect()


def test_short_range_sums_where_the_sweep_finds_pairs(spark):
    rng = np.random.default_rng(11)
    at = np.concatenate([rng.uniform(0, 20, (150, 3)), rng.normal(0, 0.7, (60, 3)) % 20.0])
    group, mass, eps = rng.integers(1, 3, 210), rng.uniform(0, 1, 210), rng.choice([0.1, 0.5], 210)
    p = spark.createDataFrame([(i, int(group[i]), *map(float, at[i]), float(mass[i]), float(eps[i])) for i in range(210)], "item long, snap_step long, x double, y double, z double, mass double, eps double")
    df = G.short_range_acceleration(p, 20.0, 2.0, 0.6, 2.0, "snap_step")
    got = {r["item"]: [r["ax"], r["ay"], r["az"]] for r in df.collect()}
    want = {}
    for i in range(210):
        d = at - at[i]
        d -= 20.0 * np.round(d / 20.0)
        d2 = (d**2).sum(1)
        for j in np.flatnonzero((group == group[i]) & (d2 <= 4.0) & (np.arange(210) != i)):
            q = math.sqrt(d2[j]) / 1.2
            f = 2.0 * mass[j] * (d2[j] + max(eps[i], eps[j]) ** 2) ** -1.5 * (math.erfc(q) + 2 * q / math.sqrt(math.pi) * math.exp(-q * q))
            want[i] = want.get(i, 0) + f * d[j]
    assert sorted(got) == sorted(want) and all(np.allclose(got[i], want[i], rtol=1e-9, atol=1e-11) for i in want)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_mesh_values_are_gathered_with_one_row_per_point(spark):
    rng = np.random.default_rng(2)
    at, mesh = rng.uniform(-5, 15, (200, 3)), rng.normal(0, 1, (4, 4, 4))
    p = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(at)], "item long, x double, y double, z double")
    m = spark.createDataFrame([(i, j, k, float(mesh[i, j, k])) for i in range(4) for j in range(4) for k in range(4)], "ix int, iy int, iz int, fx double")
    df = G.interpolate_mesh(p, m, 4, 10.0, ("fx",))
    got = dict(map(tuple, df.collect()))
    for i, q in enumerate((at / 10 - np.floor(at / 10)) * 4):
        lo, f = np.floor(q).astype(int), q - np.floor(q)
        want = sum(mesh[tuple((lo + o) % 4)] * np.prod(np.where(o, f, 1 - f)) for o in np.array(np.meshgrid([0, 1], [0, 1], [0, 1])).reshape(3, 8).T)
        assert abs(got[i] - want) < 1e-12
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [item" not in plan and len(got) == 200


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
def test_direct_query_joins_no_pairs(spark):
    from nebulith.plans import registry

    plan = registry.queries()["gr03_direct_acceleration"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan and "Join" not in plan


def _crowd(spark, n=900, seed=4):
    rng = np.random.default_rng(seed)
    at = np.concatenate([rng.uniform(0, 10, (n, 3)), rng.normal(3, 0.15, (n // 2, 3)), np.full((30, 3), 7.0), [[0.0, 0, 0], [10, 10, 10]]])
    rows = [(i, *map(float, q), float(rng.uniform(0.1, 2)), float(rng.choice([0.02, 0.1, 0.4]))) for i, q in enumerate(at)]
    return spark.createDataFrame(rows, "item long, x double, y double, z double, mass double, eps double")


@pytest.mark.parametrize(("policy", "block"), [("geometric", 100), ("geometric", 10**6), ("com", 300)])
def test_tree_walk_of_blocks_is_the_walk_of_rows(spark, policy, block):
    from nebulith.operators.tree_walk import tree_walk

    p = Scratch(spark, "crowd").write(_crowd(spark))
    asked = p.where("item % 3 <> 1").select(F.col("item").alias("target"), "x", "y", "z", "eps")
    df = tree_walk(asked, p, 10.0, 6, 2.0, 0.6, policy, block=block, crowd=10**6)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r["target"]: tuple(r)[1:] for r in df.collect()}
    want = {r["target"]: tuple(r)[1:] for r in G.tree_acceleration(asked, p, G.tree_nodes(p, 6, 10.0), 10.0, 6, 2.0, 0.6, policy).collect()}
    assert sorted(got) == sorted(want) and max(w[3] for w in want.values()) > 0
    same = [got[i][3:] == w[3:] and np.allclose(got[i][:3], w[:3], rtol=1e-9, atol=1e-9) for i, w in want.items()]
    assert all(same) if block == 10**6 else sum(same) > len(same) / 2  # blocks smaller than groups cut the groups


def test_tree_walk_of_crowded_groups(spark):
    """Groups are cut where targets crowd: fewer points are met, and forces are those of the direct sum."""
    from nebulith.operators.tree_walk import tree_walk

    p = Scratch(spark, "crowd").write(_crowd(spark))
    asked = p.select(F.col("item").alias("target"), "x", "y", "z", "eps")
    got, whole, direct = ({r["target"]: tuple(r)[1:] for r in df.collect()} for df in (
        tree_walk(asked, p, 10.0, 6, 2.0, 0.4, block=200), tree_walk(asked, p, 10.0, 6, 2.0, 0.4, block=200, crowd=10**6), G.direct_acceleration(asked, p, 2.0, 4)))
    assert sorted(got) == sorted(direct)
    assert sum(r[4] for r in got.values()) < sum(r[4] for r in whole.values())
    off, size = (np.sqrt(np.mean(np.square([np.subtract(u[i][:3], v) if u else v for i, v in direct.items()]))) for u in (got, None))
    assert off < 0.01 * size


def test_migration_reads_its_rows_once(spark):
    """Rows that another reading would give otherwise, as of unequal copies of one id, are neither lost nor doubled."""
    import pandas as pd

    ids = F.pandas_udf(lambda s: pd.Series(np.random.default_rng().integers(0, 2**60, len(s))), "long").asNondeterministic()
    now = spark.range(200).select(ids("id").alias("key"), F.lit(1).alias("n"))
    none = spark.createDataFrame([], "key long, n int")
    assert state.commit_migration(now, none, none, "key").count() == 200
    twice = spark.createDataFrame([(7, 1), (7, 2)], "key long, n int")
    with pytest.raises(Exception, match="duplicate id after migration: 7"):
        state.commit_migration(none, none, twice, "key").collect()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
def test_patch_migration_counts_cells_once(spark):
    from nebulith.plans import registry

    plan = registry.queries()["se04_patch_migration"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "cells.parquet" not in plan and plan.count("HashAggregate") == 0
