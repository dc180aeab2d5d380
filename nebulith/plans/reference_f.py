"""Queries: subgrid steps and time bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from nebulith.operators import subgrid as G
from nebulith.operators import timebins as T
from nebulith.operators.base import finite
from nebulith.operators.hydro_step import grid_state
from nebulith.operators.spatial import grid_faces
from nebulith.plans.catalog import CC, CP, CT, query, rounded
from nebulith.plans.frames import STARS_SQL, stars
from nebulith.plans.reference_d import _SSP

BOX = 100.0
_SF = f"sf AS (SELECT gas_cell_id, mass, density, pressure, metal_mass, temperature, sound_speed, vx, vy, vz, time_bin <= 4 AS active, removed_step IS NULL AS owned, mass / density AS volume, vx / 100 AS divergence, vy * vy / 1e4 AS gradient2 FROM {CC})"
CFG = G.StarFormation(density_threshold=0.2, temperature_threshold=6000.0, least_mass=1e-4, target_mass=2e-4, g=43.0, efficiency=0.05)
BOUND = G.StarFormation(model="bound_jeans", alpha_max=60.0, jeans_floor=5.0, least_mass=1e-4, target_mass=5e-4, g=43.0, efficiency=0.05)


def _sf_cells(t):
    c = t.current_cells
    return c.select(
        "gas_cell_id", "mass", "density", "pressure", "metal_mass", "temperature", "sound_speed", "vx", "vy", "vz", "cx", "cy", "cz", (F.col("time_bin") <= 4).alias("active"), F.col("removed_step").isNull().alias("owned"), F.lit(True).alias("leaf"), F.lit(False).alias("ghost"),
        (F.col("mass") / F.col("density")).alias("volume"), (F.col("vx") / 100).alias("divergence"), (F.col("vy") ** 2 / 1e4).alias("gradient2"),
    )


_REASON = """CASE WHEN NOT active THEN 'inactive' WHEN NOT owned THEN 'not_owned' WHEN NOT coalesce(isfinite(mass) AND mass > 0, false) THEN 'non_positive_mass'
 WHEN NOT coalesce(isfinite(density) AND density > 0 AND isfinite(temperature) AND temperature >= 0 AND isfinite(sound_speed) AND sound_speed >= 0 AND isfinite(divergence) AND isfinite(gradient2) AND isfinite(vx) AND isfinite(vy) AND isfinite(vz) AND isfinite(metal_mass) AND metal_mass >= 0, false) THEN 'invalid_state' {rest} ELSE 'none' END"""
_R1 = _REASON.format(rest="WHEN density < 0.2 THEN 'density' WHEN temperature > 6000 THEN 'temperature' WHEN divergence > 0 THEN 'not_converging'")
_R2 = _REASON.format(rest="WHEN gas_cell_id = 0 THEN 'invalid_state' WHEN NOT (volume > 0) THEN 'non_positive_volume' WHEN divergence >= 0 THEN 'not_converging' WHEN NOT ((gradient2 + 2 * pow(sound_speed / cbrt(volume), 2)) / (8 * pi() * 43 * density) < 60) THEN 'unbound' WHEN NOT (pow(pi(), 2.5) / 6 * pow(sound_speed, 3) / (pow(43, 1.5) * sqrt(density)) < greatest(5.0, mass)) THEN 'jeans_stable'")


@query("ph01_threshold_reasons", f"WITH {_SF} SELECT gas_cell_id, {_R1} AS reason FROM sf")
def ph01(t):
    """First failing test of the threshold model."""
    return _sf_cells(t).select("gas_cell_id", G.rejection(CFG).alias("reason"))


@query("ph01_bound_reasons", f"WITH {_SF} SELECT gas_cell_id, {_R2} AS reason FROM sf")
def ph01b(t):
    """First failing test of the bound-and-unstable model."""
    return _sf_cells(t).select("gas_cell_id", G.rejection(BOUND).alias("reason"))


@query("ph01_expected_mass", f"WITH {_SF}, r AS (SELECT *, {_R1} AS reason FROM sf) SELECT gas_cell_id, round(CASE WHEN reason = 'none' THEN least(mass * 0.05 * 0.02 / sqrt(3 * pi() / (32 * 43 * density)), mass * 0.25) ELSE 0 END, 12) AS expected FROM r")
def ph01e(t):
    """Expected mass of new stars."""
    return rounded(G.star_formation_plan(_sf_cells(t), CFG, 0.02, 7).select("gas_cell_id", "expected"), expected=12)


@query("ag28_step_counters", f"WITH {_SF} SELECT reason, count(*) AS n, min(density) FILTER (isfinite(density)) AS least_density, max(density) FILTER (isfinite(density)) AS most_density FROM (SELECT *, {_R1} AS reason FROM sf) GROUP BY reason")
def ag28(t):
    """Rejections by reason."""
    c = _sf_cells(t).withColumn("reason", G.rejection(CFG))
    d = F.when(finite("density"), F.col("density"))
    return c.groupBy("reason").agg(F.count("*").alias("n"), F.min(d).alias("least_density"), F.max(d).alias("most_density"))


@query("ph02_star_formation_commit")
def ph02(t):
    """New stars of a step; counts are drawn, so the tests check conservation instead of SQL."""
    _, new = G.star_formation_commit(G.star_formation_plan(_sf_cells(t), CFG, 0.02, 7), 7)
    return new


_LOG_T = "log10(greatest(e * 1e4, 10))"
_METAL_RATE = f"pow(10, CASE WHEN {_LOG_T} <= 3 THEN -25 WHEN {_LOG_T} <= 4 THEN -25 + 2 * ({_LOG_T} - 3) WHEN {_LOG_T} <= 5 THEN -23 + ({_LOG_T} - 4) WHEN {_LOG_T} <= 7 THEN -22 - 0.25 * ({_LOG_T} - 5) ELSE -22.5 END)"
_COOL = f"""WITH RECURSIVE c AS (SELECT gas_cell_id, internal_energy AS e0, greatest(density, 1e-40) AS rho, greatest(density, 1e-12) AS n, greatest(CASE WHEN isfinite(metal_mass / mass) THEN metal_mass / mass ELSE 0 END, 0) AS z, coalesce(isfinite(internal_energy) AND isfinite(density), false) AS ok FROM {CC}),
r AS (SELECT gas_cell_id, rho, n, z, greatest(e0, CAST(1e-6 AS DOUBLE)) AS e, CAST(0.05 AS DOUBLE) AS left_, 0 AS used FROM c WHERE ok
 UNION ALL SELECT gas_cell_id, rho, n, z, greatest(e + de * least(left_, h), 1e-6), left_ - least(left_, h), used + 1 FROM (SELECT *, greatest(0.1 * greatest(e, 1e-6) / greatest(abs(de), 1e-30), 1e-14 * 0.05) AS h FROM (
  SELECT *, (2e-24 * exp(-pow(2 / 2.5, 2)) / (1 + pow(n / 1e-2, 1.6)) * n - 1e-22 * sqrt(greatest(e * 1e4, 10) / 1e4) * n * n - z * {_METAL_RATE}) / rho * 1e22 AS de FROM r WHERE left_ > 0 AND used < 64)))
SELECT c.gas_cell_id, CASE WHEN ok THEN round(arg_max(e, used), 8) WHEN isfinite(any_value(e0)) THEN any_value(e0) END AS energy, coalesce(max(used), 0) AS subcycles, coalesce(arg_max(left_, used), 0) > 1e-14 * 0.05 AS hit_limit FROM c LEFT JOIN r USING (gas_cell_id) GROUP BY c.gas_cell_id, ok"""


@query("ph03_cooling", _COOL)
def ph03(t):
    """Cooling subcycles of all cells; a cell without a finite state keeps its energy (null where that is no number)."""
    out = G.cool(t.current_cells, 0.05, metal_rows=[(3.0, -25.0), (4.0, -23.0), (5.0, -22.0), (7.0, -22.5)], unit=1e22)
    return rounded(out.withColumn("energy", F.when(finite("energy"), F.col("energy"))), energy=8)


def _bh(t):
    holes = t.current_particles.where((F.col("species_tag") == 3) & finite("mass", "vx", "vy", "vz")).select(F.col("particle_id").alias("bh"), (F.col("mass") * 100).alias("bh_mass"), "vx", "vy", "vz", (F.col("particle_id") % 400).alias("slot"))
    cells = t.current_cells.where(finite("mass", "density", "metal_mass", "internal_energy", "sound_speed", "vx", "vy", "vz")).select(
        F.col("gas_cell_id").alias("host"), F.col("mass").alias("gas_mass"), "density", "metal_mass", "internal_energy", "sound_speed", *[F.col(v).alias(f"g{v}") for v in ("vx", "vy", "vz")], (F.col("gas_cell_id") % 400).alias("slot")
    )
    first = cells.groupBy("slot").agg(F.min("host").alias("host"))
    return holes.join(first, "slot").drop("slot"), cells.drop("slot")


_CELL_FINITE = " AND ".join(f"isfinite({c})" for c in ("mass", "density", "metal_mass", "internal_energy", "sound_speed", "vx", "vy", "vz"))
_ACC = f"""WITH RECURSIVE cell AS (SELECT gas_cell_id AS host, mass AS gas, density AS rho, metal_mass AS metals, internal_energy AS en, sound_speed AS cs, vx AS gx, vy AS gy, vz AS gz, gas_cell_id % 400 AS slot FROM {CC} WHERE {_CELL_FINITE}),
first AS (SELECT slot, min(host) AS host FROM cell GROUP BY slot),
hole AS (SELECT particle_id AS bh, mass * 100 AS m, vx, vy, vz, host, row_number() OVER (PARTITION BY host ORDER BY particle_id) AS rn FROM {CP} JOIN first ON slot = particle_id % 400 WHERE species_tag = 3 AND isfinite(mass) AND isfinite(vx) AND isfinite(vy) AND isfinite(vz)),
r AS (SELECT host, 0 AS rn, CAST(NULL AS BIGINT) AS bh, gas, rho, metals, en, CAST(0 AS DOUBLE) AS bh_mass, CAST(0 AS DOUBLE) AS got, CAST(0 AS DOUBLE) AS lim, CAST(0 AS DOUBLE) AS new_vx FROM cell WHERE host IN (SELECT host FROM hole)
 UNION ALL SELECT host, rn, bh, gas - got, rho * CASE WHEN gas > 0 THEN (gas - got) / gas ELSE 1 END, metals * CASE WHEN gas > 0 THEN (gas - got) / gas ELSE 1 END, en + CASE WHEN gas - got > 1e-30 THEN 0.05 * 0.1 * got / 1e-4 * 300 * 300 * 1e-4 / (gas - got) ELSE 0 END, m + got, got, lim, (m * vx + got * gx) / (m + got) FROM (
  SELECT *, least(least(4 * pi() * 43 * 43 * m * m * greatest(rho, 1e-20) / pow(cs * cs + pow(vx - gx, 2) + pow(vy - gy, 2) + pow(vz - gz, 2), 1.5), lim) * 1e-4, greatest(gas - 1e-30, 0)) AS got FROM (
   SELECT r.host, h.rn, h.bh, r.gas, r.rho, r.metals, r.en, h.m, h.vx, h.vy, h.vz, c.cs, c.gx, c.gy, c.gz, 4 * pi() * 43 * h.m / (0.1 * 2 * 300) AS lim FROM r JOIN hole h ON h.host = r.host AND h.rn = r.rn + 1 JOIN cell c ON c.host = r.host)))
SELECT bh, host, round(bh_mass, 9) AS bh_mass, round(got / 1e-4, 5) AS mdot, round(got / 1e-4 / lim, 9) AS edd_ratio, round(new_vx, 9) AS vx, round(gas, 9) AS gas_mass, round(metals, 12) AS gas_metals FROM r WHERE bh IS NOT NULL"""


@query("ph04_accretion", _ACC)
def ph04(t):
    """Accretion with the holes of one cell in turn."""
    out = G.accrete(*_bh(t), G.Accretion(), 1e-4).select("bh", "host", "bh_mass", "mdot", "edd_ratio", "vx", "gas_mass", "gas_metals")
    return rounded(out, bh_mass=9, mdot=5, edd_ratio=9, vx=9, gas_mass=9, gas_metals=12)


@query("ph05_seed_candidates", f"""WITH h AS (SELECT parent_particle_id, count(*) AS n FROM {CC} GROUP BY 1), c AS (SELECT gas_cell_id, mass, mass * (1 + gas_cell_id % 50) AS halo_mass FROM {CC}), b AS (SELECT gas_cell_id AS host, count(*) AS n FROM (SELECT tracer_host AS gas_cell_id FROM {CT}) GROUP BY 1)
SELECT c.gas_cell_id, c.mass, c.halo_mass FROM c LEFT JOIN b ON b.host = c.gas_cell_id WHERE halo_mass >= 0.3 AND isfinite(mass) AND mass > 0.007 AND coalesce(b.n, 0) < 1""")
def ph05(t):
    """Cells that may take a seed; tracer hosts stand for cells that have one."""
    cells = t.current_cells.select("gas_cell_id", "mass", (F.col("mass") * (1 + F.col("gas_cell_id") % 50)).alias("halo_mass"))
    return G.seed_candidates(cells, t.current_tracers.select(F.col("tracer_host").alias("host")), 0.3, 0.007)


@query("ph06_stellar_interval", f"WITH s AS ({STARS_SQL}) SELECT star_id, round(least(greatest(({_SSP.format(a='(age_years + 5e7)')}) - ({_SSP.format(a='age_years')}), 0) * birth_mass, birth_mass * 0.05), 7) AS returned FROM s")
def ph06(t):
    """Returned mass over an interval, capped by the mass at hand."""
    from nebulith.operators.tables import ssp_interval

    s = stars(t)
    return rounded(s.select("star_id", F.least(ssp_interval(F.col("age_years"), F.col("age_years") + 5e7, F.col("birth_mass"), 1), F.col("birth_mass") * 0.05).alias("returned")), returned=7)


@query("ph07_stellar_commit", f"WITH s AS ({STARS_SQL}) SELECT star_id, round(returned_metals + greatest(({_SSP.format(a='(age_years + 5e7)')}) - ({_SSP.format(a='age_years')}), 0) * birth_mass, 7) AS returned_total, age_years + 5e7 AS age_years FROM s")
def ph07(t):
    """Cumulative lanes advanced by the interval."""
    from nebulith.operators.tables import ssp_interval

    s = stars(t)
    return rounded(s.select("star_id", (F.col("returned_metals") + ssp_interval(F.col("age_years"), F.col("age_years") + 5e7, F.col("birth_mass"), 1)).alias("returned_total"), (F.col("age_years") + 5e7).alias("age_years")), returned_total=7)


@query("ph08_feedback_budget", f"WITH s AS ({STARS_SQL}) SELECT star_id, round(birth_mass * 0.1 * 50 * 0.7, 7) AS thermal, round(birth_mass * 0.1 * 50 * 0.3, 7) AS kinetic, round(birth_mass * 0.1 * 2, 7) AS momentum FROM s")
def ph08(t):
    """Feedback energies and momentum per star."""
    s = stars(t).select("star_id", (F.col("birth_mass") * 0.1).alias("returned_mass"), "returned_metals")
    return rounded(G.feedback_budget(s, 50.0, 0.7, 0.3, 2.0).select("star_id", "thermal", "kinetic", "momentum"), thermal=7, kinetic=7, momentum=7)


_NEARW = f"""s AS (SELECT snap_step, particle_id AS star, x, y, z, mass * 0.1 AS rm FROM {CP} WHERE species_tag = 2 AND isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(mass)), c AS (SELECT snap_step, gas_cell_id AS cell, cx, cy, cz FROM {CC} WHERE isfinite(cx) AND isfinite(cy) AND isfinite(cz)),
d AS (SELECT s.*, cell, pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2) AS d2 FROM s JOIN c USING (snap_step)), k AS (SELECT *, row_number() OVER (PARTITION BY snap_step, star ORDER BY d2, cell) AS rank FROM d QUALIFY rank <= 4),
w AS (SELECT *, (1 / sqrt(greatest(d2, 1e-12))) / sum(1 / sqrt(greatest(d2, 1e-12))) OVER (PARTITION BY snap_step, star) AS weight FROM k), a AS (SELECT cell, sum(weight * rm) AS rm, sum(weight * rm * 50) AS e FROM w GROUP BY cell)"""


@query("ph09_feedback_deposit", f"WITH {_NEARW} SELECT gas_cell_id AS cell, round(mass + coalesce(rm, 0), 9) AS mass, round((mass * internal_energy + coalesce(e, 0)) / (mass + coalesce(rm, 0)), 6) AS internal_energy FROM {CC} c LEFT JOIN a ON a.cell = c.gas_cell_id WHERE isfinite(mass) AND isfinite(internal_energy) AND mass > 0")
def ph09(t):
    """Feedback of all stars spread over their nearest cells."""
    from nebulith.operators.spatial import feedback_weights, nearest_cells

    s = t.current_particles.where((F.col("species_tag") == 2) & finite("mass", "x", "y", "z")).select("snap_step", F.col("particle_id").alias("star"), "x", "y", "z", (F.col("mass") * 0.1).alias("returned_mass"), F.lit(0.0).alias("returned_metals"))
    near = nearest_cells(s.select("snap_step", "star", "x", "y", "z"), t.current_cells.select("snap_step", F.col("gas_cell_id").alias("cell"), "cx", "cy", "cz"), 4, BOX, "snap_step")
    w = feedback_weights(near, ["snap_step", "star"]).select("snap_step", "star", "cell", "weight")
    budget = G.feedback_budget(s, 50.0, 0.7, 0.3, 2.0)
    cells = t.current_cells.where(finite("mass", "internal_energy") & (F.col("mass") > 0)).select(F.col("gas_cell_id").alias("cell"), "mass", "density", "metal_mass", "internal_energy")
    out, _ = G.deposit(budget, w, cells, ["snap_step", "star"])
    return rounded(out.select("cell", "mass", "internal_energy"), mass=9, internal_energy=6)


def _diffusion(t):
    g = grid_state(t.current_particles, 8, BOX).withColumn("cell", (F.col("ix") * 8 + F.col("iy")) * 8 + F.col("iz"))
    faces = grid_faces(g, 8).select(F.col("owner").alias("left"), F.col("neighbor").alias("right"), (0.001 * (1 + F.col("axis"))).alias("conductance"))
    return g.select("cell", F.col("rho").alias("gas"), (F.col("rho") * F.col("z")).alias("metals")), faces


_DG = f"""g AS (SELECT CAST(i AS INT) AS cell, CAST(i // 64 AS INT) AS ix, CAST((i // 8) % 8 AS INT) AS iy, CAST(i % 8 AS INT) AS iz FROM range(512) r(i)),
m AS (SELECT CAST(floor((x / 100 - floor(x / 100)) * 8) AS INT) AS ix, CAST(floor((y / 100 - floor(y / 100)) * 8) AS INT) AS iy, CAST(floor((z / 100 - floor(z / 100)) * 8) AS INT) AS iz, sum(mass) AS m, avg(time_bin) AS b FROM {CP} WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(vx) AND isfinite(vy) AND isfinite(vz) AND isfinite(mass) GROUP BY 1, 2, 3),
s AS (SELECT cell, ix, iy, iz, coalesce(m, 0) + 0.01 AS gas, coalesce(b, 0) / 100 AS zz FROM g LEFT JOIN m USING (ix, iy, iz)), ax AS (SELECT CAST(a AS INT) AS axis FROM range(3) r(a)),
f AS (SELECT s.cell AS l, (((ix + CASE WHEN axis = 0 THEN 1 ELSE 0 END) % 8) * 8 + (iy + CASE WHEN axis = 1 THEN 1 ELSE 0 END) % 8) * 8 + (iz + CASE WHEN axis = 2 THEN 1 ELSE 0 END) % 8 AS r, 0.001 * (1 + axis) AS k FROM s, ax),
q AS (SELECT l, r, k * (a.zz - b.zz) AS rate FROM f JOIN s a ON a.cell = l JOIN s b ON b.cell = r), u AS (SELECT l AS cell, -rate AS d FROM q UNION ALL SELECT r, rate FROM q), dd AS (SELECT cell, sum(d) AS rate FROM u GROUP BY cell)"""


@query("ph10_diffusion_rate", f"WITH {_DG} SELECT cell, round(rate, 12) AS rate FROM dd")
def ph10(t):
    """Gain of metals per cell over the faces of a periodic grid."""
    cells, faces = _diffusion(t)
    return rounded(G.diffusion_rate(cells, faces), rate=12)


@query("ph11_limited_step", f"WITH {_DG} SELECT s.cell, round(gas * zz + 0.5 * rate, 10) AS metals FROM s JOIN dd USING (cell)")
def ph11(t):
    """One limited step. (The SQL holds while nothing is limited, as here.)"""
    cells, faces = _diffusion(t)
    return rounded(G.limited_euler(cells, faces, 0.5).select("cell", "metals"), metals=10)


_RK2 = _DG + """, s1 AS (SELECT s.cell, gas, gas * zz AS m0, gas * zz + 0.5 * rate AS m1 FROM s JOIN dd USING (cell)),
q1 AS (SELECT l, r, k * (a.m1 / a.gas - b.m1 / b.gas) AS rate FROM f JOIN s1 a ON a.cell = l JOIN s1 b ON b.cell = r), u1 AS (SELECT l AS cell, -rate AS d FROM q1 UNION ALL SELECT r, rate FROM q1), d1 AS (SELECT cell, sum(d) AS rate FROM u1 GROUP BY cell)"""


@query("ph11_limited_rk2", f"WITH {_RK2} SELECT s1.cell, round(0.5 * m0 + 0.5 * (m1 + 0.5 * rate), 10) AS metals FROM s1 JOIN d1 USING (cell)")
def ph11r(t):
    """Two limited steps averaged with the start. (The SQL holds while nothing is limited, as here.)"""
    return rounded(G.limited_rk2(*_diffusion(t), 0.5).select("cell", "metals"), metals=10)


@query("ph12_super_time_step")
def ph12(t):
    """A super time step of many explicit ones; its decay is tested."""
    cells, faces = _diffusion(t)
    return G.super_time_step(cells, faces, 4.0)[0]


_EOS = """h AS (SELECT i AS bin, exp(i / 63.0 * ln(1e4)) AS ratio FROM range(64) r(i)), a AS (SELECT *, 10 + 1e4 / (1 + 1000 * pow(ratio, -0.8)) AS hot, 2.0 / sqrt(ratio) AS ts FROM h),
b AS (SELECT *, ts / (0.01 * sqrt(hot) / ratio) * hot / (0.1 * 1e4 - 0.9 * 10) AS y FROM a), c AS (SELECT *, 2 * y / (1 + 2 * y + sqrt(1 + 4 * y)) AS x FROM b), d AS (SELECT *, (1 - x) * hot + x * 10 AS raw FROM c),
e AS (SELECT *, greatest(raw + (150 - first_value(raw) OVER (ORDER BY bin)), 10) AS energy FROM d)"""


@query("ph14_effective_table", f"WITH {_EOS} SELECT bin, round(x, 9) AS cold_fraction, round(energy, 6) AS energy, round(2.0 / 3 * ratio * energy, 4) AS pressure FROM e")
def ph14(t):
    """Table of the effective equation of state."""
    return rounded(G.effective_table(t.spark, G.EffectiveGas()).select("bin", "cold_fraction", "energy", "pressure"), cold_fraction=9, energy=6, pressure=4)


@query("fn24_effective_point", f"WITH {_EOS} SELECT bin, round(hot, 7) AS hot, round(y, 5) AS y FROM b")
def fn24(t):
    """Hot energy and the balance parameter of each table point."""
    e = G.EffectiveGas()
    tab = G.effective_table(t.spark, e)
    y = 2.0 / F.sqrt("density") / (0.01 * F.sqrt("hot") / F.col("density")) * F.col("hot") / (0.1 * 1e4 - 0.9 * 10)
    return rounded(tab.select("bin", "hot", y.alias("y")), hot=7, y=5)


@query("ph15_relaxation", f"SELECT gas_cell_id, round(150 + (internal_energy - 150) * exp(-0.5), 7) AS energy, round((150 - internal_energy) * (1 - exp(-0.5)), 7) AS added FROM {CC} WHERE isfinite(internal_energy)")
def ph15(t):
    """Relaxation to the effective energy with its ledger."""
    new, added = G.relax_to_effective(F.col("internal_energy"), F.lit(150.0), 0.5, 1.0)
    return rounded(t.current_cells.where(finite("internal_energy")).select("gas_cell_id", new.alias("energy"), added.alias("added")), energy=7, added=7)


@query("ph16_tracer_injection", f"SELECT t.particle_id, CASE WHEN c.gas_cell_id IS NULL THEN 'no_host' WHEN NOT coalesce(c.mass > 0, false) THEN 'empty_host' WHEN last_host_mass * t.fraction < 0 THEN 'negative' ELSE 'ok' END AS state, round(CASE WHEN c.mass > 0 THEN last_host_mass * t.fraction / c.mass END, 9) AS fraction FROM {CT} t LEFT JOIN {CC} c ON c.gas_cell_id = t.tracer_host")
def ph16(t):
    """Tracer fractions of their hosts."""
    req = t.current_tracers.select("particle_id", F.col("tracer_host").alias("host"), (F.col("last_host_mass") * F.col("fraction")).alias("injected"))
    return rounded(G.inject_tracers(req, t.current_cells).select("particle_id", "state", "fraction"), fraction=9)


@query("ph17_tracer_update", f"SELECT state, count(*) AS n, round(sum(ex), 7) AS exchanged FROM (SELECT CASE WHEN c.gas_cell_id IS NULL THEN 'invalid_host' WHEN c.time_bin > 4 THEN 'inactive_host' WHEN NOT coalesce(c.mass > 0.005, false) THEN 'low_host_mass' ELSE 'updated' END AS state, CASE WHEN c.gas_cell_id IS NOT NULL AND c.time_bin <= 4 AND c.mass > 0.005 THEN exchanged + abs(t.fraction * c.mass - last_host_mass * t.fraction) ELSE exchanged END AS ex FROM {CT} t LEFT JOIN {CC} c ON c.gas_cell_id = t.tracer_host) GROUP BY state")
def ph17(t):
    """Tracer masses from their hosts, with what was skipped and why."""
    tr = t.current_tracers.withColumn("tracer_mass", F.col("last_host_mass") * F.col("fraction"))
    cells = t.current_cells.withColumn("active", F.col("time_bin") <= 4)
    up = G.update_tracers(tr, cells, 0.005)
    return rounded(up.groupBy("state").agg(F.count("*").alias("n"), F.sum("exchanged").alias("exchanged")), exchanged=7)


def _gradient_sql() -> str:
    from nebulith.plans.reference_e import _GRID

    near = {a: [" AND ".join(f"{s}.{c} = (s.{c} + {d}) % 8" if i == a else f"{s}.{c} = s.{c}" for i, c in enumerate(("ix", "iy", "iz"))) for s, d in ((f"l{a}", 7), (f"h{a}", 1))] for a in range(3)}
    joins = " ".join(f"JOIN s l{a} ON {near[a][0]} JOIN s h{a} ON {near[a][1]}" for a in range(3))
    return f"WITH {_GRID} SELECT s.ix, s.iy, s.iz, {', '.join(f'round((h{a}.{v} - l{a}.{v}) / 25, 9) AS g_{v}{c}' for a, c in enumerate('xyz') for v in 'uvw')} FROM s {joins}"


@query("ph18_velocity_gradient", _gradient_sql())
def ph18(t):
    """Velocity gradient on a periodic grid."""
    return rounded(G.velocity_gradient(grid_state(t.current_particles, 8, BOX), 8, 12.5), **{f"g_{v}{c}": 9 for v in "uvw" for c in "xyz"})


def _elements(t):
    return t.current_particles.select(F.col("particle_id").alias("element"), F.col("time_bin").alias("bin")).where("bin IS NOT NULL")


@query("tm01_active_at_tick", f"SELECT particle_id AS element, time_bin AS bin FROM {CP} WHERE time_bin IS NOT NULL AND 12 % (1 << time_bin) = 0")
def tm01(t):
    """Elements active at tick 12."""
    return T.active_elements(_elements(t), 12)


@query("tm02_activity", f"WITH b AS (SELECT time_bin, count(*) AS n FROM {CP} WHERE time_bin IS NOT NULL GROUP BY 1), k AS (SELECT i AS tick FROM range(64) r(i)) SELECT tick, CAST(sum(n) AS BIGINT) AS n_active, round(sum(n) / (SELECT sum(n) FROM b), 9) AS active_fraction, arg_min(time_bin, (-n, time_bin)) AS most_active_bin FROM k JOIN b ON tick % (1 << time_bin) = 0 GROUP BY tick")
def tm02(t):
    """Active count, fraction and fullest bin of 64 ticks."""
    return rounded(T.activity(_elements(t), t.spark.range(64).withColumnRenamed("id", "tick")), active_fraction=9)


_CAND = f"SELECT particle_id AS element, 1 AS ordinal, time_bin AS bin, 'current' AS source FROM {CP} WHERE time_bin IS NOT NULL UNION ALL SELECT particle_id, 2, CAST((particle_id + snap_step) % 6 AS INT), 'gravity' FROM {CP} UNION ALL SELECT particle_id, 3, CAST((particle_id // 7) % 6 AS INT), 'cfl' FROM {CP} WHERE species_tag = 1"


def _candidates(t):
    p = t.current_particles
    one = p.where("time_bin IS NOT NULL").select(F.col("particle_id").alias("element"), F.lit(1).alias("ordinal"), F.col("time_bin").alias("bin"), F.lit("current").alias("source"))
    two = p.select(F.col("particle_id").alias("element"), F.lit(2).alias("ordinal"), ((F.col("particle_id") + F.col("snap_step")) % 6).cast("int").alias("bin"), F.lit("gravity").alias("source"))
    three = p.where("species_tag = 1").select(F.col("particle_id").alias("element"), F.lit(3).alias("ordinal"), (F.floor(F.col("particle_id") / 7) % 6).cast("int").alias("bin"), F.lit("cfl").alias("source"))
    return one.unionByName(two).unionByName(three)


@query("tm03_reconcile", f"WITH c AS ({_CAND}) SELECT element, min(bin) AS bin, arg_min(source, (bin, ordinal)) AS source FROM c GROUP BY element")
def tm03(t):
    """The smallest candidate per element."""
    return T.reconcile(_candidates(t))


@query("tm03_limiting_sources", f"WITH c AS ({_CAND}), r AS (SELECT element, arg_min(source, (bin, ordinal)) AS source FROM c GROUP BY element) SELECT source, count(*) AS n FROM r GROUP BY source")
def tm03l(t):
    """What limits the steps."""
    return T.limiting_sources(T.reconcile(_candidates(t)))


@query("tm04_transitions", f"""WITH c AS ({_CAND}), r AS (SELECT element, min(bin) AS wanted FROM c WHERE source <> 'current' GROUP BY element), e AS (SELECT particle_id AS element, time_bin AS bin FROM {CP} WHERE time_bin IS NOT NULL),
o AS (SELECT e.element, bin, wanted, CASE WHEN wanted IS NULL THEN 'none' WHEN wanted = bin THEN 'same' WHEN 12 % (1 << bin) <> 0 THEN 'waits' WHEN wanted < bin THEN 'refined' WHEN 12 % (1 << wanted) = 0 THEN 'coarsened' ELSE 'deferred' END AS outcome FROM e LEFT JOIN r USING (element))
SELECT element, CASE WHEN outcome IN ('refined', 'coarsened') THEN wanted ELSE bin END AS bin, CASE WHEN outcome IN ('waits', 'deferred') THEN wanted END AS pending, outcome FROM o""")
def tm04(t):
    """Bin changes at tick 12: refining at once, coarsening where the tick allows it."""
    wanted = T.reconcile(_candidates(t).where("source <> 'current'"))
    return T.apply_transitions(_elements(t), wanted, 12)


@query("tm05_scheduler_export", f"SELECT particle_id AS element, time_bin AS bin, CAST((12 // (1 << time_bin) + 1) * (1 << time_bin) AS BIGINT) AS next_tick FROM {CP} WHERE time_bin IS NOT NULL")
def tm05(t):
    """Persistent scheduler state after tick 12."""
    return T.scheduler_export(_elements(t), 12)


@query("tm05_scheduler_import", f"SELECT count(*) AS n, 0 AS bad_bin, 0 AS in_past, 0 AS off_period FROM {CP} WHERE time_bin IS NOT NULL")
def tm05i(t):
    """An exported state has nothing to refuse."""
    return T.scheduler_violations(T.scheduler_export(_elements(t), 12), 12, 12).select("n", *[F.col(c).cast("int").alias(c) for c in ("bad_bin", "in_past", "off_period")])


@query("tm06_mirror_check", f"SELECT r.particle_id, r.time_bin, p.time_bin AS scheduler_bin FROM (SELECT DISTINCT ON (particle_id) * FROM particles_replica) r LEFT JOIN {CP} p USING (particle_id) WHERE r.time_bin IS DISTINCT FROM p.time_bin")
def tm06(t):
    """Rows of the other copy whose bin isn't the scheduler's."""
    r = t.particles_replica.drop("ingested_at").dropDuplicates(["particle_id"])
    return T.mirror_mismatches(_elements(t), r, "particle_id")


@query("tm07_mesh_cadence", "SELECT i AS opportunity, (i - 1) % 5 = 0 AS refresh, (i - 1) // 5 + 1 AS field_version FROM range(1, 201) r(i)")
def tm07(t):
    """Refreshes of the mesh every fifth opportunity."""
    return T.refresh_events(t.spark.range(1, 201).withColumnRenamed("id", "opportunity"), 5)


@query("tm08_restart_legality", "SELECT i AS tick, CASE WHEN i % 16 = 0 THEN 'global' WHEN i % 2 = 0 THEN 'partial' ELSE 'substep' END AS boundary, i % 16 = 0 AND i % 48 <> 0 AS restart_safe FROM range(200) r(i)")
def tm08(t):
    """Boundaries at which a restart may be written."""
    steps = t.spark.range(200).select(F.col("id").alias("tick"), F.lit(4).alias("max_bin"), (F.col("id") % 48 == 0).alias("pending"))
    return T.restart_legality(steps)


@query("tm10_output_cadence", "WITH s AS (SELECT event_id AS step, event_id * 0.37 AS time FROM events) SELECT step, step % 10 = 0 AS by_steps, floor(time / 2.5) > floor((time - 0.37) / 2.5) AS by_time FROM s WHERE step % 10 = 0 OR floor(time / 2.5) > floor((time - 0.37) / 2.5)")
def tm10(t):
    """Outputs by steps and by time."""
    s = t.events.select(F.col("event_id").alias("step"), (F.col("event_id") * 0.37).alias("time"), F.lit(0.37).alias("dt"))
    return T.output_steps(s, 10, 2.5)


@query("tm11_diagnostics_cadence", "SELECT event_id AS step, true AS health, event_id % 8 = 0 AS light, event_id % 64 = 0 AS heavy FROM events")
def tm11(t):
    """Diagnostics due at each step."""
    return T.diagnostics_due(t.events.select(F.col("event_id").alias("step")))


@query("tm13_adaptive_bins", f"SELECT gas_cell_id, least(greatest(CAST(floor(log2(greatest(least(0.4 * cbrt(mass / density) / (sqrt(vx * vx + vy * vy + vz * vz) + sound_speed), 0.5), 1e-9) / 1e-5) + 1e-12) AS INT), 0), 8) AS bin FROM {CC} WHERE isfinite(vx) AND isfinite(vy) AND isfinite(vz) AND isfinite(sound_speed) AND isfinite(density) AND isfinite(mass) AND density > 0 AND mass > 0")
def tm13(t):
    """Candidate bins of all cells from their criteria."""
    from nebulith.functions import hydro as H
    from nebulith.functions import physics as P

    c = t.current_cells.where(finite("vx", "vy", "vz", "sound_speed", "density", "mass") & (F.col("density") > 0) & (F.col("mass") > 0))
    v = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)
    step = P.least_step(H.cfl_step(F.cbrt(F.col("mass") / F.col("density")), v, F.col("sound_speed"), 0.4), F.lit(0.5))
    return c.select("gas_cell_id", P.time_bin(step, 1e-5, 8).alias("bin"))


@query("tm14_stale_rejection", "WITH n AS (SELECT owner_rank, max(decomposition_epoch) AS e FROM pm_ownership GROUP BY 1) SELECT p.owner_rank, count(*) AS n FROM pm_ownership p JOIN n USING (owner_rank) WHERE decomposition_epoch >= e GROUP BY 1")
def tm14(t):
    """Rows of an epoch older than the newest of their owner are dropped."""
    now = t.pm_ownership.groupBy("owner_rank").agg(F.max("decomposition_epoch").alias("decomposition_epoch"))
    return T.reject_stale(t.pm_ownership, now, "owner_rank", "decomposition_epoch").groupBy("owner_rank").agg(F.count("*").alias("n"))
