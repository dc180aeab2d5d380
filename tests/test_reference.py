"""Fixtures, conservation laws and second algorithms for the simulation operators."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from nebulith.functions import random as R
from nebulith.operators import decomposition as P
from nebulith.operators import gravity as G
from nebulith.operators import halos as H
from nebulith.operators import hydro_step as S
from nebulith.operators import spectrum, subgrid, tables, timebins
from nebulith.operators.groups import components
from nebulith.runtime import Scratch
from nebulith.sources import config, products, snapshots
from nebulith.streaming import twins

PART = "particle_id long, snap_step long, species_tag int, x double, y double, z double, vx double, vy double, vz double, mass double"


def particles(spark, places, first):
    return spark.createDataFrame([(first + i, 1, 0, *p, 0.0, 0.0, 0.0, 1.0) for i, p in enumerate(places)], PART)


def test_two_groups(spark):
    p = particles(spark, [(x, 0.1, 0.1) for x in (0.10, 0.11, 0.12)] + [(x, 0.8, 0.8) for x in (0.80, 0.81, 0.82)], 100)
    m = H.membership(H.candidates(p), 0.30, 1.0, 2)
    cat = H.catalogue(H.candidates(p), m, 1.0).collect()
    assert sorted((r["particle_count"], r["min_particle_id"], r["halo_id"]) for r in cat) == [(3, 100, (1 << 32) | 1), (3, 103, (1 << 32) | 2)]


def test_group_across_the_face(spark):
    p = particles(spark, [(x, 0.5, 0.5) for x in (0.99, 0.01, 0.03)], 200)
    cat = H.catalogue(H.candidates(p), H.membership(H.candidates(p), 0.35, 1.0, 2), 1.0).collect()
    assert len(cat) == 1 and (cat[0]["com_x"] < 0.1 or cat[0]["com_x"] > 0.9)


def test_components_against_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    up = {}

    def find(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    linked = {v for e in edges if e[0] != e[1] for v in e}
    assert rows(components(spark.createDataFrame(edges, "a long, b long"))) == sorted((v, find(v)) for v in linked)


def test_spectrum_two_ways(spark):
    rng = random.Random(1)
    p = particles(spark, [(rng.random(), rng.random(), rng.random()) for _ in range(200)], 1)
    a = spectrum.power_spectrum(p, 8, 5, 1.0, "cic", True, False).orderBy("bin").collect()
    b = spectrum.power_spectrum(p, 8, 5, 1.0, "cic", True, False, direct=True).orderBy("bin").collect()
    assert sum(r["mode_count"] for r in a) == 8**3 - 1
    assert all(math.isclose(x["power"], y["power"], rel_tol=1e-9) and x["mode_count"] == y["mode_count"] for x, y in zip(a, b))
    two = particles(spark, [(0.125, 0.125, 0.125)] * 2 + [(0.625, 0.125, 0.125)] * 2, 1)
    assert spectrum.shot_noise(two, 1.0) == 0.25


def test_tree_against_direct_sum(spark):
    rng = random.Random(2)
    pts = spark.createDataFrame([(i, rng.random(), rng.random(), rng.random(), rng.random(), 0.02) for i in range(400)], "item long, x double, y double, z double, mass double, eps double")
    targets = pts.where("item < 12").select(F.col("item").alias("target"), "x", "y", "z", "eps")
    tree = {r["target"]: r for r in G.tree_acceleration(targets, pts, G.tree_nodes(pts, 5, 1.0), 1.0, 5, 1.0, 0.4).collect()}
    direct = {r["target"]: r for r in G.direct_acceleration(targets, pts, 1.0, 4).collect()}
    for k, d in direct.items():
        size = math.sqrt(sum(d[c] ** 2 for c in ("ax", "ay", "az")))
        off = math.sqrt(sum((d[c] - tree[k][c]) ** 2 for c in ("ax", "ay", "az")))
        assert off <= 0.05 * size
    assert any(r["n_nodes"] > 0 for r in tree.values())


def test_two_bodies(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 0.1), (1, 1.0, 0.0, 0.0, 3.0, 0.1)], "item long, x double, y double, z double, mass double, eps double")
    r = G.direct_acceleration(p.where("item = 0").select(F.col("item").alias("target"), "x", "y", "z", "eps"), p, 2.0, 2).first()
    assert math.isclose(r["ax"], 6 / 1.01**1.5) and r["ay"] == r["az"] == 0


def test_poisson_plane_wave(spark):
    n, box = 16, 2.0
    k = 2 * math.pi / box
    i = F.col("id")
    d = spark.range(n**3).select(F.floor(i / n**2).cast("int").alias("ix"), (F.floor(i / n) % n).cast("int").alias("iy"), (i % n).cast("int").alias("iz"))
    d = d.withColumn("density", 3 + F.cos(k * F.col("ix") * (box / n)))
    out = G.poisson_periodic(d, n, box, 1.0).toPandas()
    x = out.ix * box / n
    assert np.allclose(out.phi, -4 * math.pi / k**2 * np.cos(k * x), atol=1e-9)
    assert np.allclose(out.fx, -4 * math.pi / k * np.sin(k * x), atol=1e-9) and np.allclose(out.fy, 0, atol=1e-9)


def test_isolated_point_mass(spark):
    n, box = 16, 16.0
    d = spark.createDataFrame([(8, 8, 8, 5.0)], "ix int, iy int, iz int, density double")
    out = G.poisson_isolated(d, n, box, 2.0).toPandas().set_index(["ix", "iy", "iz"])
    assert math.isclose(out.phi[(12, 8, 8)], -2.0 * 5.0 / 4, rel_tol=1e-9) and math.isclose(out.phi[(8, 8, 8)], 0.0, abs_tol=1e-9)


def test_gas_steps_conserve(spark):
    i = F.col("id")
    g = spark.range(64).select(F.floor(i / 16).cast("int").alias("ix"), (F.floor(i / 4) % 4).cast("int").alias("iy"), (i % 4).cast("int").alias("iz"))
    g = g.withColumns({"rho": F.when(F.col("ix") < 2, 1.0).otherwise(0.125), "u": F.lit(0.0), "v": F.lit(0.1), "w": F.lit(0.0), "p": F.when(F.col("ix") < 2, 1.0).otherwise(0.1), "z": F.lit(0.02)})
    e = F.col("p") / 0.4 + 0.5 * F.col("rho") * (F.col("u") ** 2 + F.col("v") ** 2 + F.col("w") ** 2)
    before = g.agg(F.sum("rho"), F.sum(e)).first()
    for solver, limiter in (("hlle", None), ("hllc", "minmod")):
        after = S.evolve(g, 4, 0.25, 1e-3, 1.4, 2, solver, limiter).agg(F.sum("rho"), F.sum(e), F.min("rho")).first()
        assert math.isclose(before[0], after[0], rel_tol=1e-10) and math.isclose(before[1], after[1], rel_tol=1e-10) and after[2] > 0


def test_metal_line_table():
    assert np.isclose(np.interp(4.5, [4.0, 5.0], [-23.0, -22.0]), -22.5)


def test_lookup_in_metal_line_table(spark):
    r = spark.range(1).select(tables.interpolate([(4.0, -23.0), (5.0, -22.0)], F.lit(4.5), 1).alias("v")).first()["v"]
    assert abs(r + 22.5) < 1e-9


def test_cooling_against_a_scalar_loop(spark):
    cells = spark.createDataFrame([(1, 1.0, 0.5, 1.0, 0.01), (2, 50.0, 2.0, 1.0, 0.0), (3, None, 1.0, 1.0, 0.0)], "gas_cell_id long, internal_energy double, density double, mass double, metal_mass double")
    got = {r["gas_cell_id"]: r for r in subgrid.cool(cells, 5.0, 0.01, 32, unit=1e22).collect()}
    for k, e, rho in ((1, 1.0, 0.5), (2, 50.0, 2.0)):
        left, used = 5.0, 0
        while used < 32 and left > 0:
            t = max(e * 1e4, 10.0)
            de = (2e-24 * math.exp(-((2 / 2.5) ** 2)) / (1 + (rho / 1e-2) ** 1.6) * rho - 1e-22 * math.sqrt(t / 1e4) * rho * rho) / rho * 1e22
            h = min(left, max(0.01 * e / max(abs(de), 1e-30), 5e-14))
            e, left, used = max(e + de * h, 1e-6), left - h, used + 1
        assert math.isclose(got[k]["energy"], e, rel_tol=1e-9) and got[k]["subcycles"] == used and got[k]["energy"] >= 1e-6
    assert got[3]["energy"] is None or math.isnan(got[3]["energy"])


def test_holes_of_one_cell_act_in_turn(spark):
    holes = spark.createDataFrame([(2, 9, 5.0, 0.0, 0.0, 0.0), (1, 9, 5.0, 0.0, 0.0, 0.0)], "bh long, host long, bh_mass double, vx double, vy double, vz double")
    cells = spark.createDataFrame([(9, 10.0, 2.0, 1.0, 3.0, 3.0, 0.0, 0.0, 0.0)], "host long, gas_mass double, density double, metal_mass double, internal_energy double, sound_speed double, gvx double, gvy double, gvz double")
    cfg = subgrid.Accretion(g=0.05, capped=False)
    a, b = sorted(subgrid.accrete(holes, cells, cfg, 0.5).collect(), key=lambda r: r["bh"])
    first = cfg.alpha * 4 * math.pi * cfg.g**2 * 25 * 2.0 / 27
    assert math.isclose(a["mdot"], first, rel_tol=1e-12) and b["mdot"] < a["mdot"]
    assert math.isclose(a["bh_mass"] + b["bh_mass"] + b["gas_mass"], 20.0, rel_tol=1e-12)
    assert math.isclose(b["gas_metals"] / b["gas_mass"], 0.1, rel_tol=1e-12)


def test_star_formation_takes_what_it_gives(spark):
    cfg = subgrid.StarFormation(density_threshold=1.0, least_mass=0.05, target_mass=0.1, g=1.0, efficiency=0.5)
    names = "gas_cell_id long, mass double, density double, pressure double, metal_mass double, temperature double, sound_speed double, vx double, vy double, vz double, cx double, cy double, cz double, divergence double, gradient2 double, volume double"
    c = spark.createDataFrame([(i, 2.0 + i % 3, 5.0, 1.0, 0.1, 100.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, 1.0) for i in range(1, 200)], names).withColumns({"active": F.lit(True), "owned": F.lit(True), "leaf": F.lit(True), "ghost": F.lit(False)})
    cells, stars = subgrid.star_formation_commit(subgrid.star_formation_plan(c, cfg, 0.3, 5), 5)
    born, n, ids = stars.agg(F.sum("birth_mass"), F.count("*"), F.countDistinct("star_id")).first()
    assert n == ids > 50 and math.isclose(c.agg(F.sum("mass")).first()[0], cells.agg(F.sum("mass")).first()[0] + born, rel_tol=1e-12)
    assert cells.where("taken > most * (1 + 1e-9)").count() == 0


def line(spark, n=16):
    z = [0.1 + 0.05 * math.sin(2 * math.pi * i / n) for i in range(n)]
    cells = spark.createDataFrame([(i, 1.0, z[i]) for i in range(n)], "cell long, gas double, metals double")
    return cells, spark.createDataFrame([(i, (i + 1) % n, 0.3) for i in range(n)], "left long, right long, conductance double")


def test_diffusion_conserves_and_decays(spark):
    cells, faces = line(spark)
    total = cells.agg(F.sum("metals")).first()[0]
    spread = lambda d: d.agg(F.max("metals") - F.min("metals")).first()[0]
    explicit = subgrid.stable_step(cells, faces, 0.4)
    assert math.isclose(explicit, 0.4 / 0.6)
    for out in (subgrid.limited_euler(cells, faces, 0.3), subgrid.limited_rk2(cells, faces, 0.3), subgrid.super_time_step(cells, faces, 4.0)[0]):
        assert math.isclose(out.agg(F.sum("metals")).first()[0], total, rel_tol=1e-12) and spread(out) < spread(cells)
    far = subgrid.super_time_step(cells, faces, 4.0)[0]
    decay = math.exp(-0.3 * 4.0 * 2 * (1 - math.cos(2 * math.pi / 16)))
    assert abs(spread(far) / spread(cells) - decay) < 0.02


def test_limited_step_keeps_bounds(spark):
    cells = spark.createDataFrame([(0, 1.0, 0.01), (1, 1.0, 0.0), (2, 1.0, 0.99)], "cell long, gas double, metals double")
    faces = spark.createDataFrame([(0, 1, 5.0), (2, 1, 5.0)], "left long, right long, conductance double")
    out = [r[2] for r in sorted(subgrid.limited_euler(cells, faces, 10.0).collect())]
    assert min(out) >= -1e-12 and max(out) <= 1 + 1e-12 and math.isclose(sum(out), 1.0)


def test_time_bins_of_six_elements(spark):
    e = spark.createDataFrame([(i, b) for i, b in enumerate([0, 0, 1, 1, 2, 2])], "element long, bin int")
    act = timebins.activity(e, spark.range(8).withColumnRenamed("id", "tick")).orderBy("tick").collect()
    assert [r["n_active"] for r in act] == [6, 2, 4, 2, 6, 2, 4, 2]


def test_rebalance_against_a_fold(spark):
    rng = random.Random(3)
    data = [(i, rng.randrange(3), rng.randrange(3), float(rng.randrange(1, 30))) for i in range(300)]
    for cap in (0.5, 40.0, 700.0):
        got = [r["item"] for r in P.rebalance_intents(spark.createDataFrame(data, "item long, old int, new int, load double"), "old", "new", cap).orderBy("item").collect()]
        want, used = [], 0.0
        for i, a, b, w in data:
            if a == b or used + w > cap and want:
                continue
            want.append(i)
            used += w
        assert got == want


def test_curve_cuts_keep_one_item_per_rank(spark):
    data = [(i, i, 1.0 if i else 100.0) for i in range(6)]
    got = [r["rank"] for r in P.curve_cuts(spark.createDataFrame(data, "item long, key long, load double"), 4).orderBy("item").collect()]
    assert got == [0, 1, 2, 3, 3, 3]
    assert P.curve_cuts(spark.createDataFrame([], "item long, key long, load double"), 4).count() == 0


def test_published_mixing_value(spark):
    got = spark.range(1).select(R.unsigned(R.mixed(F.lit(0).cast("long"))).alias("v"), R.uniform(F.lit(0)).alias("u")).first()
    assert int(got["v"]) == 0xE220A8397B1DCDAF and 0 <= got["u"] < 1


def test_config():
    text = "schema_version = 1\n[mode]\nmode = zoom_in # comment\n[numerics]\npm_grid = 32\ntreepm_assignment_scheme = TSC\n[output]\nrun_name = 'a;b'\n"
    c = config.freeze(text)
    assert c["numerics.treepm_pm_grid"] == 32 and c.used_aliases == ("numerics.pm_grid",) and c["numerics.treepm_assignment_scheme"] is config.Assignment.TSC and c["output.run_name"] == "'a;b'"
    assert config.freeze(text).hash == c.hash and config.fnv1a("") == 0xCBF29CE484222325
    for bad in ("[mode]\nmode = a\nmode = b", "[mode]\nmode = a\n[numerics]\npm_grid = 1", "[x]\ny = 1", "[mode]\nmode = a\n[numerics]\npm_grid = 8\ntreepm_pm_grid = 9", "[]"):
        with pytest.raises(config.ConfigError):
            config.freeze(bad)
    for s in ("a\\b\n\tc", ""):
        assert config.unescape(config.escape(s)) == s


def test_snapshot_is_refused_when_changed_or_unfinished(spark):
    path = Scratch(spark, "snap").base
    p = particles(spark, [(0.1, 0.2, 0.3), (0.4, 0.5, 0.6)], 5)
    snapshots.write_snapshot(p, path, {"box": 1.0, "step": 3})
    assert sorted(r["particle_id"] for r in snapshots.read_snapshot(spark, path, verify=True).collect()) == [5, 6]
    p.withColumn("part_type", F.lit(1)).drop("part_type").write.mode("append").parquet(f"{path}/particles/part_type=1")
    with pytest.raises(snapshots.SnapshotError):
        snapshots.read_snapshot(spark, path, verify=True)
    with pytest.raises(snapshots.SnapshotError):
        snapshots.read_tables(spark, Scratch(spark, "none").base)


def test_aliases(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 1.0, 1.0, 1.0, 7, 2.0)], "Pos_x double, coordinates_y double, z double, vel_x double, vy double, vz double, ParticleIDs long, Masses double")
    assert set(snapshots.resolve_aliases(df).columns) == {"x", "y", "z", "vx", "vy", "vz", "particle_id", "mass"}
    with pytest.raises(snapshots.SnapshotError):
        snapshots.resolve_aliases(df.withColumn("x", F.lit(1.0)))
    with pytest.raises(snapshots.SnapshotError):
        snapshots.resolve_aliases(df.drop("Masses"))


def test_manifest_of_another_version_is_an_error(spark):
    df = spark.createDataFrame([(1, json.dumps({"schema_version": 3, "fields": []}))], "source_file_index long, manifest string")
    with pytest.raises(Exception, match="version 4"):
        products.manifest_fields(df).collect()


def test_transition_stream_against_a_fold(spark):
    rng = random.Random(8)
    data = [(rng.randrange(5), t, rng.randrange(4)) for t in range(200)]
    base = Scratch(spark, "requests").base
    spark.createDataFrame(data, "element long, tick long, wanted int").coalesce(1).write.parquet(base)
    got = rows(twins.run_to_end(twins.transition_stream(twins.read_stream(spark, base)), "append", "test"))
    state, want = {}, []
    for e, t, w in data:
        now = state.get(e, 0)
        if w < now or w > now and t % (1 << w) == 0:
            want.append((e, t, now, w))
            state[e] = w
    assert got == sorted(want)


def test_wrap_leaves_what_is_no_number(spark):
    from nebulith.operators.state import periodic_wrap

    df = spark.createDataFrame([(1, 250.0), (2, -1e-18), (3, float("nan")), (4, None), (5, 100.0)], "i int, x double")
    got = {r["i"]: r["w"] for r in df.select("i", periodic_wrap(F.col("x"), 100.0).alias("w")).collect()}
    assert got[1] == 50.0 and got[2] == 0.0 and math.isnan(got[3]) and got[4] is None and got[5] == 0.0


def test_stages_keep_their_contracts(spark):
    from nebulith.operators.steps import Stage, ordered, run_step

    df = spark.range(1)
    order = ordered([Stage("drift", dict, (), name="b", requires=("a",)), Stage("drift", dict, (), name="a"), Stage("kick_pre", dict, ())])
    assert [s.name or s.slot for s in order] == ["kick_pre", "a", "b"]
    for bad in ([Stage("nowhere", dict, ())], [Stage("drift", dict, (), requires=("x",))]):
        with pytest.raises(ValueError):
            ordered(bad)
    with pytest.raises(ValueError):
        run_step({"a": df}, [Stage("drift", lambda t: {"b": df}, ("a",), ("a",))])
    with pytest.raises(ValueError):
        run_step({}, [Stage("drift", dict, ("a",))])


def test_holes_of_one_cell_act_in_order_whatever_the_batches(spark):
    from nebulith.operators import subgrid

    rng = random.Random(9)
    hosts = [1] * 40 + [2, 3, 4] + [5] * 3 + list(range(6, 30))
    holes = [(i, h, rng.uniform(0.5, 2.0), *(rng.uniform(-1, 1) for _ in range(3))) for i, h in enumerate(hosts)]
    cells = [(h, rng.uniform(5, 9), rng.uniform(1, 2), 0.1, 3.0, rng.uniform(1, 2), 0.1, 0.2, 0.3) for h in set(hosts)]
    cfg, dt = subgrid.Accretion(), 1e-4
    want = {}
    state = {c[0]: c[1:5] for c in cells}
    about = {c[0]: c[5:] for c in cells}
    for bh, h, mass, *v in sorted(holes):
        gas, rho, metals, energy = state[h]
        cs, *gv = about[h]
        v2 = sum((a - b) ** 2 for a, b in zip(v, gv))
        bondi = cfg.alpha * 4 * math.pi * cfg.g**2 * mass**2 * rho / (cs * cs + v2) ** 1.5
        limit = 4 * math.pi * cfg.g * mass * cfg.proton / (cfg.efficiency * cfg.thomson * cfg.light)
        got = min(bondi, limit) * dt
        power = cfg.feedback * cfg.efficiency * got / dt * cfg.light**2 * dt
        keep = (gas - got) / gas
        state[h] = (gas - got, rho * keep, metals * keep, energy + power * cfg.coupling / (gas - got))
        want[bh] = (mass + got, *state[h][:1], *state[h][2:])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = subgrid.accrete(
            spark.createDataFrame(holes, "bh long, host long, bh_mass double, vx double, vy double, vz double"),
            spark.createDataFrame(cells, "host long, gas_mass double, density double, metal_mass double, internal_energy double, sound_speed double, gvx double, gvy double, gvz double"), cfg, dt,
        ).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r["bh"]: (r["bh_mass"], r["gas_mass"], r["gas_metals"], r["gas_energy"]) for r in out}
    assert got.keys() == want.keys() and all(math.isclose(a, b, rel_tol=1e-12) for k in want for a, b in zip(got[k], want[k]))


def test_interpolation_join_of_an_uneven_table(spark):
    import numpy as np
    from nebulith.operators import tables

    rng = random.Random(4)
    xs = sorted({round(rng.random() ** 6 * 1e4, 6) for _ in range(300)})
    ys = [math.sin(x) for x in xs]
    at = [rng.uniform(-10, 1.1e4) for _ in range(200)] + xs[:20] + [xs[-1]]
    points = spark.createDataFrame([(i, v, 1) for i, v in enumerate(at)] + [(-1, None, 1), (-2, float("nan"), 1)], "i long, q double, tx int")
    table = spark.createDataFrame(list(zip(xs, ys)) + [(None, 1.0)], "tx double, ty double")
    got = {r["i"]: r["y"] for r in tables.interpolate_join(points, table, "q", "tx", "ty", "y").collect()}
    assert len(got) == len(at) + 2 and got[-1] is None and got[-2] is None
    assert all(math.isclose(got[i], np.interp(v, xs, ys), rel_tol=1e-9, abs_tol=1e-9) for i, v in enumerate(at))
    assert [r["y"] for r in tables.interpolate_join(points.limit(1), table.limit(0), "q", "tx", "ty", "y").collect()] == [None]
