import random

import pytest

from conftest import rows
from nebulith.operators.near_pairs import near_pairs

SCHEMA = "id long, step long, x double, y double, z double, _pid int, grp string"


def brute(points, r, box):
    seen = {}
    for i, s, *p in points:
        if i is None or s is None or any(c is None or c != c or abs(c) == float("inf") for c in p[:3]):
            continue
        seen[(i, s)] = [c % box for c in p[:3]]
    ids = sorted(seen)
    out = set()
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            if ids[a][1] != ids[b][1] or ids[a][0] == ids[b][0]:
                continue
            d = 0.0
            for u, v in zip(seen[ids[a]], seen[ids[b]]):
                e = abs(u - v)
                d += min(e, box - e) ** 2
            if d <= r * r:
                out.add((ids[a][1], ids[a][0], ids[b][0]))
    return sorted(out)


def points(n, box, seed, spread):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = [rng.choice([0.0, box / 2, box - 1e-9]) if rng.random() < spread else rng.uniform(0, box) for _ in range(3)]
        out.append((i * 3 + 1, rng.choice([1, 2]), *[c + rng.gauss(0, box / 60) + rng.choice([0, 0, box, -2 * box]) for c in base], 0, "g"))
    return out


@pytest.mark.parametrize("r,strips,parts", [(3.0, None, None), (3.0, 4, 7), (9.0, None, 3), (24.0, None, 2), (1.0, 20, 16)])
def test_against_brute_force(spark, r, strips, parts):
    p = points(260, 100.0, 5, 0.5)
    got = near_pairs(spark.createDataFrame(p + p[:30], SCHEMA).repartition(3), "id", ("x", "y", "z"), "step", r, 100.0, parts, strips)
    assert [t[:3] for t in rows(got)] == brute(p, r, 100.0)


def test_nulls_nans_ties_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    p = [(1, 1, 5.0, 5.0, 5.0), (2, 1, 5.0, 5.0, 5.0), (2, 1, 5.0, 5.0, 5.0), (3, 1, nan, 5.0, 5.0), (4, 1, None, 5.0, 5.0), (5, 1, inf, 5.0, 5.0), (None, 1, 5.0, 5.0, 5.0), (6, None, 5.0, 5.0, 5.0), (7, 2, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame([(*t, 1, "x") for t in p], SCHEMA)
    assert [t[:3] for t in rows(near_pairs(df, "id", ("x", "y", "z"), "step", 0.1, 10.0))] == [(1, 1, 2)]
    assert rows(near_pairs(df.limit(0), "id", ("x", "y", "z"), "step", 0.1, 10.0)) == []


def test_radius_must_fit(spark):
    with pytest.raises(ValueError):
        near_pairs(spark.createDataFrame([], SCHEMA), "id", ("x", "y", "z"), "step", 5.0, 10.0)


def test_crowded_strip(spark):
    rng = random.Random(1)
    p = [(i, 1, 50 + rng.random() * 0.2, 50 + rng.random() * 30, 50 + rng.random() * 0.2, 0, "") for i in range(1500)]
    got = near_pairs(spark.createDataFrame(p, SCHEMA), "id", ("x", "y", "z"), "step", 0.05, 100.0, 5)
    assert [t[:3] for t in rows(got)] == brute(p, 0.05, 100.0)


def test_all_pairs_without_the_sweep(spark, tmp_path, monkeypatch):
    from nebulith.operators import near_pairs as sweep
    from nebulith.plans import reference_c
    from nebulith.plans.catalog import QUERIES

    def refuse(*_):
        raise AssertionError("the sweep was called")

    rng = random.Random(9)
    p = [(i, i // 7 % 2, *[rng.choice([0, 100]) + rng.uniform(-1.2, 1.2) for _ in "xyz"], i % 4, 1) for i in range(300)]
    spark.createDataFrame(p + p[:9], "particle_id long, snap_step long, x double, y double, z double, species_tag int, ingested_at int").write.parquet(f"{tmp_path}/particles.parquet")
    monkeypatch.setattr(sweep, "near_pairs", refuse)
    monkeypatch.setattr(reference_c, "near_pairs", refuse, raising=False)
    got = [t[:3] for t in rows(QUERIES["jn04_all_pairs"](spark, str(tmp_path)))]
    near = lambda a, b: sum(min(d, 100 - d) ** 2 for d in (abs(u % 100 - v % 100) for u, v in zip(a, b))) <= 1
    want = sorted((s, i, j) for i, s, *a, _, _ in p for j, t, *b, _, _ in p if i % 20 == 0 and i != j and s == t and near(a, b))
    assert got == want and want


def test_radius_per_group(spark):
    p = points(240, 100.0, 9, 0.5)
    df = spark.createDataFrame(p, SCHEMA)
    got = [t[:3] for t in rows(near_pairs(df, "id", ("x", "y", "z"), "step", {1: 2.0, 2: 14.0}, 100.0, 5))]
    assert got == sorted([t for t in brute(p, 2.0, 100.0) if t[0] == 1] + [t for t in brute(p, 14.0, 100.0) if t[0] == 2])
    assert near_pairs(df, "id", ("x", "y", "z"), "step", {}, 100.0).count() == 0


def test_small_sparse_group_beside_a_large_dense_one(spark, monkeypatch):
    """Candidates stay linear: the ten points of one group don't widen the search among the many of the other."""
    import numpy as np
    from nebulith.operators import near_pairs as N

    rng = np.random.default_rng(3)
    n, tested = 4000, []
    y, x, z = (rng.uniform(0, 100, n) for _ in range(3))
    plain_where = np.repeat
    monkeypatch.setattr(N.np, "repeat", lambda a, k: tested.append(int(np.sum(k))) or plain_where(a, k))
    order = np.argsort(y)
    args = (y[order], x[order], z[order], np.arange(n), np.full(n, 7), np.ones(n, bool))

    def candidates(radius):
        tested.clear()
        list(N._pairs_of(*args, radius, 100.0))
        return sum(tested)

    own, widest = candidates(0.2 * 100 / n ** (1 / 3)), candidates(0.2 * 100 / 10 ** (1 / 3))
    assert own < 60 * n < widest
