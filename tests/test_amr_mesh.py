import math
import random

import pytest
from pyspark.sql import functions as F

from nebulith.functions import hydro as H
from nebulith.operators import amr
from nebulith.operators import amr_mesh as M
from nebulith.operators import hydro_step as S
from nebulith.operators import subgrid

N, BOX, GAMMA = 4, 8.0, 1.4
SCHEMA = "level int, ix int, iy int, iz int, rho double, u double, v double, w double, p double, z double"


def state(rng):
    return [rng.uniform(0.5, 2.0), *(rng.uniform(-0.3, 0.3) for _ in range(3)), rng.uniform(0.8, 1.5), rng.uniform(0.0, 0.3)]


def two_levels(split, seed=3):
    rng, out = random.Random(seed), []
    for i in range(N):
        for j in range(N):
            for k in range(N):
                if (i, j, k) in split:
                    out += [(1, 2 * i + a, 2 * j + b, 2 * k + c, *state(rng)) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
                else:
                    out.append((0, i, j, k, *state(rng)))
    return out


SPLIT = {(0, 0, 0), (0, 0, 3), (1, 2, 2), (2, 2, 2), (3, 1, 0)}


def test_faces_between_levels_against_brute_force(spark):
    """Every pair of leaves whose boxes share a face, found by testing all pairs of the periodic mesh."""
    cells = two_levels(SPLIT)
    box = lambda c: [(c[1 + a] * 2 // 2 ** c[0], 2 // 2 ** c[0]) for a in range(3)]  # noqa: E731  (low, size) in half coarse cells
    total, want = 2 * N, set()
    for p in cells:
        for q in cells:
            for axis in range(3):
                a, b = box(p), box(q)
                touch = (a[axis][0] + a[axis][1]) % total == b[axis][0]
                overlap = all(max(a[o][0], b[o][0]) < min(a[o][0] + a[o][1], b[o][0] + b[o][1]) for o in range(3) if o != axis)
                if touch and overlap:
                    want.add((p[:4], q[:4], axis) if p[0] >= q[0] else (q[:4], p[:4], axis))
    df = spark.createDataFrame(cells, SCHEMA)
    faces = M.leaf_faces(df, N, BOX)
    names = M.keyed(df.select("level", "ix", "iy", "iz")).collect()
    of = {r["key"]: tuple(r)[:4] for r in names}
    got = [(of[r["own"]], of[r["nb"]], r["axis"]) for r in faces.collect()]
    assert len(got) == len(want) and set(got) == want
    area = {r["kind"]: r["area"] for r in faces.where("level = 1").collect()}
    assert area == {"same": (BOX / N / 2) ** 2, "fine": (BOX / N / 2) ** 2}
    assert {r["distance"] for r in faces.where("kind = 'fine'").collect()} == {1.5 * BOX / N / 2}
    open_box = M.leaf_faces(df, N, BOX, periodic=False)
    assert open_box.count() < faces.count() and M.leaf_faces(df.limit(0), N, BOX).count() == 0


@pytest.mark.parametrize("solver", ["hlle", "hllc"])
@pytest.mark.parametrize("advance", [M.advance_synchronous, M.advance_subcycled])
def test_steps_conserve_everything(spark, solver, advance):
    cells = spark.createDataFrame(two_levels(SPLIT), SCHEMA)
    after = M.evolve(cells, 2, lambda c: advance(c, N, BOX, 0.05, GAMMA, solver))
    a, b = M.totals(cells, N, BOX, GAMMA).first(), M.totals(after, N, BOX, GAMMA).first()
    for c in H.CONSERVED:
        assert abs(a[c] - b[c]) < 1e-10 * max(1.0, abs(a[c])), c
    assert after.count() == cells.count() and after.where("rho IS NULL OR isnan(rho)").count() == 0
    assert after.exceptAll(cells).count() == cells.count()


def test_one_level_is_the_plain_grid(spark):
    cells = spark.createDataFrame(two_levels(set()), SCHEMA)
    key = ["ix", "iy", "iz"]
    plain = S.advance(cells.drop("level"), N, BOX / N, 0.05, GAMMA).select(*key, *[F.col(c).alias(f"_{c}") for c in S.FIELDS])
    for advance in (M.advance_synchronous, M.advance_subcycled):
        both = advance(cells, N, BOX, 0.05, GAMMA).join(plain, key).collect()
        assert len(both) == N**3 and all(math.isclose(r[c], r[f"_{c}"], rel_tol=1e-11, abs_tol=1e-12) for r in both for c in S.FIELDS)


def test_uniform_gas_stays_uniform_and_expansion_cools_it(spark):
    same = [(*c[:4], 1.0, 0.1, -0.2, 0.05, 1.0, 0.2) for c in two_levels(SPLIT)]
    cells = spark.createDataFrame(same, SCHEMA)
    for advance in (M.advance_synchronous, M.advance_subcycled):
        rows = advance(cells, N, BOX, 0.1, GAMMA, "hllc").collect()
        assert all(math.isclose(r["rho"], 1.0, rel_tol=1e-12) and math.isclose(r["u"], 0.1, rel_tol=1e-11) and math.isclose(r["p"], 1.0, rel_tol=1e-11) for r in rows)
        cooled = advance(cells, N, BOX, 0.1, GAMMA, "hllc", (0.02, 0.04)).collect()
        assert all(math.isclose(r["u"], 0.1 * (1 - 0.1 * 0.03), rel_tol=1e-3) and r["p"] < 1.0 for r in cooled)


def test_subcycled_and_synchronous_steps_differ_by_second_order_in_time(spark):
    cells = spark.createDataFrame(two_levels({(1, 1, 1)}), SCHEMA)

    def apart(dt):
        a, b = ({tuple(r)[:4]: r["rho"] for r in f(cells, N, BOX, dt, GAMMA).collect()} for f in (M.advance_synchronous, M.advance_subcycled))
        assert a.keys() == b.keys()
        return max(abs(a[k] - b[k]) for k in a)

    wide, narrow = apart(0.04), apart(0.02)
    assert 1e-5 < narrow < wide and 3.0 < wide / narrow < 5.5


def test_deeper_meshes_are_refused_for_subcycling_only(spark):
    rng = random.Random(5)
    cells = [c for c in two_levels({(1, 1, 1)}) if c[:4] != (1, 2, 2, 2)]
    cells += [(2, 4 + a, 4 + b, 4 + c, *state(rng)) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    df = spark.createDataFrame(cells, SCHEMA)
    with pytest.raises(ValueError, match="two successive levels"):
        M.advance_subcycled(df, N, BOX, 0.02, GAMMA)


def test_diffusion_over_leaf_faces(spark):
    cells = spark.createDataFrame(two_levels(SPLIT), SCHEMA)
    faces = M.diffusion_faces(M.leaf_faces(cells, N, BOX), 0.01)
    table = M.keyed(cells).select(F.col("key").alias("cell"), (F.col("rho") * 8 / F.pow(F.lit(8.0), "level")).alias("gas"), (F.col("rho") * F.col("z") * 8 / F.pow(F.lit(8.0), "level")).alias("metals"))
    rate = subgrid.diffusion_rate(table, faces)
    assert abs(rate.agg(F.sum("rate")).first()[0]) < 1e-12 and rate.where("rate = 0").count() == 0
    step = subgrid.limited_euler(table, faces, 0.5 * subgrid.stable_step(table, faces, 0.4))
    spread = lambda t: t.agg(F.max(F.col("metals") / F.col("gas")) - F.min(F.col("metals") / F.col("gas"))).first()[0]
    assert spread(step) < spread(table)
    assert math.isclose(step.agg(F.sum("metals")).first()[0], table.agg(F.sum("metals")).first()[0], rel_tol=1e-12)


STATE = "key long, patch_id long, t double, fingerprint long, generation long, d double"


def ghosts(spark, start, end, patches, time):
    frames = [spark.createDataFrame(r, STATE) for r in (start, end)]
    return amr.temporal_ghosts(*frames, spark.createDataFrame(patches, "patch_id long, fingerprint long, generation long"), F.lit(time), ("d",)).collect()


def test_temporal_ghosts_and_their_guards(spark):
    start, end, now = [(1, 7, 0.0, 5, 2, 10.0), (3, 7, 0.0, 5, 2, 1.0)], [(1, 7, 2.0, 5, 2, 20.0), (4, 7, 2.0, 5, 2, 1.0)], [(7, 5, 2)]
    for time, want in ((0.0, 10.0), (0.5, 12.5), (2.0, 20.0), (2.0 + 1e-13, 20.0)):
        assert [(r["key"], r["d"]) for r in ghosts(spark, start, end, now, time)] == [(1, want)]
    for time, s, e, p, word in ((2.1, start, end, now, "outside"), (0.5, start, end, [(7, 6, 2)], "stale"), (0.5, start, end, [(7, 5, 3)], "stale"), (0.5, start, [(1, 7, 2.0, 4, 2, 20.0)], now, "stale"), (0.5, start, end, [], "stale")):
        with pytest.raises(Exception, match=word):
            ghosts(spark, s, e, p, time)


def test_production_refinement_needs_free_ids(spark):
    cells = spark.createDataFrame([(i, float(i), 0.0, 0.0, 8.0, 1.0, 0) for i in range(1, 4)], "gas_cell_id long, cx double, cy double, cz double, mass double, width double, level int")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id long")
    out = amr.refine_production(cells, F.col("gas_cell_id") == 2, ids(*range(100, 110)), ("mass",)).collect()
    assert sorted(r["gas_cell_id"] for r in out) == [1, 3, *range(100, 108)] and sum(r["mass"] for r in out) == 24.0
    children = {r["key"]: r for r in out if r["key"] is not None}
    assert sorted(children) == list(range(17, 25)) and all(r["parent_key"] == 2 and r["level"] == 1 for r in children.values())
    for free in (ids(*range(100, 107)), ids(3, *range(100, 110))):
        with pytest.raises(Exception, match="free ids"):
            amr.refine_production(cells, F.col("gas_cell_id") == 2, free, ("mass",)).collect()


def test_birth_plan_order(spark):
    plan = spark.createDataFrame([(9,), (2,), (None,), (5,)], "gas_cell_id long")
    assert sorted((r["place"], r["gas_cell_id"]) for r in subgrid.birth_order(plan).collect()) == [(0, 2), (1, 5), (2, 9)]
    with pytest.raises(Exception, match="names twice"):
        subgrid.birth_order(spark.createDataFrame([(9,), (2,), (9,)], "gas_cell_id long")).collect()
