"""Queries: scalar functions, tables and the subgrid models' rates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from nebulith.functions import cosmology as C
from nebulith.functions import hydro as H
from nebulith.functions import physics as P
from nebulith.functions import random as R
from nebulith.operators import tables as T
from nebulith.operators.base import finite
from nebulith.plans.catalog import CC, CP, query, rounded
from nebulith.plans.frames import STARS_SQL, stars

U, BG, G = C.CodeUnits(), C.Background(), 43.0
_E = "sqrt(0.3 / pow(scale_factor, 3) + 0.7)"
_H0 = repr(BG.hubble0)
_FILES = "(SELECT DISTINCT ON (source_file_index) * FROM ic_files)"


def _files(t):
    return t.ic_files.drop("ingested_at").dropDuplicates(["source_file_index"])


@query("fn01_units", f"SELECT gas_cell_id, round(mass * {U.factor('mass')!r} / 1e36, 9) AS mass_si36, round(cx * {U.factor('length', 'cgs')!r} / 1e20, 9) AS cx_cgs20, round(vx * {U.factor('velocity')!r}, 5) AS vx_si, round(density * {U.factor('density')!r} * 1e20, 9) AS density_si20 FROM {CC} WHERE isfinite(mass) AND isfinite(cx) AND isfinite(vx) AND isfinite(density)")
def fn01(t):
    """Code units to SI and CGS."""
    c = t.current_cells.where(finite("mass", "cx", "vx", "density"))
    out = c.select("gas_cell_id", (F.col("mass") * U.factor("mass") / 1e36).alias("mass_si36"), (F.col("cx") * U.factor("length", "cgs") / 1e20).alias("cx_cgs20"), (F.col("vx") * U.factor("velocity")).alias("vx_si"), (F.col("density") * U.factor("density") * 1e20).alias("density_si20"))
    return rounded(out, mass_si36=9, cx_cgs20=9, vx_si=5, density_si20=9)


@query("fn02_newton_g", f"SELECT round({C.NEWTON_G!r} * {U.mass!r} * pow({U.time!r}, 2) / pow({U.length!r}, 3), 6) AS g FROM region WHERE r_regionkey = 0")
def fn02(t):
    """Newton's constant in code units."""
    return t.region.where("r_regionkey = 0").select(F.round(F.lit(U.newton_g), 6).alias("g"))


@query("fn03_comoving", f"SELECT source_file_index, round(box_size * scale_factor, 6) AS physical_box, round(box_size / scale_factor, 4) AS stretched FROM {_FILES}")
def fn03(t):
    """Comoving and physical lengths."""
    f = _files(t)
    return rounded(f.select("source_file_index", C.comoving_to_physical(F.col("box_size"), F.col("scale_factor")).alias("physical_box"), (F.col("box_size") / F.col("scale_factor")).alias("stretched")), physical_box=6, stretched=4)


@query("fn04_expansion", f"SELECT source_file_index, round({_E}, 9) AS e, round({_E} * {_H0} * 1e18, 9) AS hubble18, round(3 * pow({_E} * {_H0}, 2) / (8 * pi() * {C.NEWTON_G!r}) * 1e27, 6) AS rho_crit27 FROM {_FILES}")
def fn04(t):
    """E(a), H(a) and the critical density of every file."""
    a = F.col("scale_factor")
    return rounded(_files(t).select("source_file_index", BG.e(a).alias("e"), (BG.hubble(a) * 1e18).alias("hubble18"), (BG.critical_density(a) * 1e27).alias("rho_crit27")), e=9, hubble18=9, rho_crit27=6)


def _aw(i: str) -> str:
    return f"(0.02 + (scale_factor - 0.02) / 256 * {i})"


@query("fn05_cosmic_time", f"SELECT source_file_index, round(list_sum([CASE WHEN i = 0 OR i = 256 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END / ({_aw('i')} * {_H0} * sqrt(0.3 / pow({_aw('i')}, 3) + 0.7)) FOR i IN range(257)]) * (scale_factor - 0.02) / 256 / 3 / 3.15576e16, 8) AS gyr FROM {_FILES}")
def fn05(t):
    """Time since a = 0.02 in Gyr by Simpson's rule."""
    return rounded(_files(t).select("source_file_index", (BG.cosmic_time(F.lit(0.02), F.col("scale_factor")) / 3.15576e16).alias("gyr")), gyr=8)


def _mid(p: int) -> str:
    a = "(scale_factor + 0.01 * scale_factor / 32 * (i + 0.5))"
    return f"list_sum([0.01 * scale_factor / 32 / (pow({a}, {p}) * {_H0} * sqrt(0.3 / pow({a}, 3) + 0.7)) FOR i IN range(32)])"


@query("fn06_drift_kick", f"SELECT source_file_index, round({_mid(3)} / 1e15, 9) AS drift15, round({_mid(2)} / (1.01 * scale_factor) / 1e15, 9) AS kick15, round(1 / 1.01, 9) AS drag FROM {_FILES}")
def fn06(t):
    """Drift, kick and drag factors of a step of one per cent in a."""
    a = F.col("scale_factor")
    b = a + 0.01 * a
    return rounded(_files(t).select("source_file_index", (BG.drift(a, b) / 1e15).alias("drift15"), (BG.kick(a, b) / 1e15).alias("kick15"), BG.drag(a, b).alias("drag")), drift15=9, kick15=9, drag=9)


@query("fn07_advance_scale_factor", f"WITH a AS (SELECT i / 10.0 AS a_begin FROM range(1, 10) r(i)), t AS (SELECT a_begin, 2 / (3 * {BG.hubble0!r} * sqrt(0.7)) * asinh(sqrt(0.7 / 0.3) * pow(a_begin, 1.5)) + 1e15 AS t FROM a) SELECT a_begin, round(pow(0.3 / 0.7, 1.0 / 3) * pow(sinh(1.5 * {BG.hubble0!r} * sqrt(0.7) * t), 2.0 / 3), 9) AS a_end FROM t")
def fn07(t):
    """Scale factor after 1e15 seconds, for a ladder of starts: a scalar for the step loop. (The SQL has the closed form of the flat model.)"""
    rows = [(a / 10, BG.advance(a / 10, 1e15)) for a in range(1, 10)]
    return rounded(t.spark.createDataFrame(rows, "a_begin double, a_end double"), a_end=9)


@query("fn33_scale_redshift", f"SELECT source_file_index, round(1 / (1 + redshift), 9) AS a_of_z, coalesce(abs(scale_factor * (1 + redshift) - 1) <= 1e-4, true) AS consistent FROM {_FILES}")
def fn33(t):
    """Scale factor from redshift, and whether the two agree."""
    return rounded(_files(t).select("source_file_index", C.to_scale_factor(F.col("redshift")).alias("a_of_z"), C.consistent(F.col("scale_factor"), F.col("redshift")).alias("consistent")), a_of_z=9)


_CELL_OK = "isfinite(vx) AND isfinite(vy) AND isfinite(vz) AND isfinite(sound_speed) AND isfinite(density) AND isfinite(pressure) AND isfinite(mass) AND isfinite(metal_mass) AND density > 0 AND mass > 0 AND isfinite(internal_energy)"


def _cells(t):
    return t.current_cells.where(finite("vx", "vy", "vz", "sound_speed", "density", "pressure", "mass", "metal_mass", "internal_energy") & (F.col("density") > 0) & (F.col("mass") > 0))


@query("fn08_cfl_step", f"SELECT gas_cell_id, round(least({', '.join(f'0.4 * cbrt(mass / density) / (abs({v}) + sound_speed)' for v in ('vx', 'vy', 'vz'))}) * 1e3, 9) AS dt3 FROM {CC} WHERE {_CELL_OK}")
def fn08(t):
    """Courant step of each gas cell."""
    width = F.cbrt(F.col("mass") / F.col("density"))
    return rounded(_cells(t).select("gas_cell_id", (H.cfl_step_3d(width, (F.col("vx"), F.col("vy"), F.col("vz")), F.col("sound_speed"), 0.4) * 1e3).alias("dt3")), dt3=9)


@query("fn09_gravity_step", f"SELECT particle_id, round(0.025 * sqrt(coalesce(softening, 0.5) / abs(vx)), 9) AS dt FROM {CP} WHERE isfinite(vx) AND vx <> 0")
def fn09(t):
    """Gravity step, with a velocity component in place of an acceleration."""
    return rounded(t.current_particles.where(finite("vx") & (F.col("vx") != 0)).select("particle_id", P.gravity_step(F.coalesce("softening", F.lit(0.5)), F.col("vx"), 0.025).alias("dt")), dt=9)


@query("fn10_expansion_step", f"SELECT source_file_index, round(least(0.02 * (1 + member_no), 0.05) / ({_E} * {_H0}) / 1e15, 9) AS dt15 FROM {_FILES}")
def fn10(t):
    """Expansion step with a cap on the change of ln a."""
    return rounded(_files(t).select("source_file_index", (P.expansion_step(BG.hubble(F.col("scale_factor")), 0.02 * (1 + F.col("member_no")), 0.05) / 1e15).alias("dt15")), dt15=9)


_STEPS = "least(0.4 * cbrt(mass / density) / (abs(vx) + sound_speed), CASE WHEN vy <> 0 THEN 0.025 * sqrt(0.5 / abs(vy)) END, 0.01)"


@query("fn11_combined_step", f"SELECT gas_cell_id, round({_STEPS}, 12) AS dt FROM {CC} WHERE {_CELL_OK}")
def fn11(t):
    """The least of the criteria; one that gives none is left out."""
    step = P.least_step(H.cfl_step(F.cbrt(F.col("mass") / F.col("density")), F.col("vx"), F.col("sound_speed"), 0.4), F.when(F.col("vy") != 0, P.gravity_step(F.lit(0.5), F.col("vy"), 0.025)), F.lit(0.01))
    return rounded(_cells(t).select("gas_cell_id", step.alias("dt")), dt=12)


@query("fn12_time_bin", f"SELECT gas_cell_id, least(greatest(CAST(floor(log2(greatest({_STEPS}, 1e-9) / 1e-5) + 1e-12) AS INT), 0), 12) AS time_bin FROM {CC} WHERE {_CELL_OK}")
def fn12(t):
    """Time bin of each cell's step."""
    step = P.least_step(H.cfl_step(F.cbrt(F.col("mass") / F.col("density")), F.col("vx"), F.col("sound_speed"), 0.4), F.when(F.col("vy") != 0, P.gravity_step(F.lit(0.5), F.col("vy"), 0.025)), F.lit(0.01))
    return _cells(t).select("gas_cell_id", P.time_bin(step, 1e-5, 12).alias("time_bin"))


@query("fn13_softened_inverse", f"SELECT particle_id, round(pow(x * x + y * y + z * z + 0.25, -1.5) * 1e6, 9) AS inv3 FROM {CP} WHERE isfinite(x) AND isfinite(y) AND isfinite(z)")
def fn13(t):
    """Softened inverse cube of the distance from the origin."""
    p = t.current_particles.where(finite("x", "y", "z"))
    return rounded(p.select("particle_id", (P.softened_inverse_cube(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2, F.lit(0.5)) * 1e6).alias("inv3")), inv3=9)


_ERF = "2 / sqrt(pi()) * list_sum([pow(-1, n) * pow(q, 2 * n + 1) / (gamma(n + 1.0) * (2 * n + 1)) FOR n IN range(80)])"


@query("fn14_split_factors", f"WITH r AS (SELECT i / 10.0 AS r, i / 10.0 / 2.5 AS q FROM range(1, 101) t(i)), s AS (SELECT r, 1 - {_ERF} + 2 * q / sqrt(pi()) * exp(-q * q) AS s FROM r) SELECT r, round(s, 7) AS short_range, round(1 - s, 7) AS long_range, round(exp(-r * r * 1.25 * 1.25), 9) AS fourier FROM s")
def fn14(t):
    """Short- and long-range factors of the Gaussian split. (The SQL sums the series of the error function.)"""
    r = t.spark.range(1, 101).select((F.col("id") / 10).alias("r"))
    s = P.short_range_factor(F.col("r"), 1.25)
    return rounded(r.select("r", s.alias("short_range"), (1 - s).alias("long_range"), P.fourier_split(F.col("r") ** 2, 1.25).alias("fourier")), short_range=7, long_range=7, fourier=9)


@query("fn16_limiters", f"""WITH d AS (SELECT gas_cell_id, vx AS a, vy AS b FROM {CC} WHERE isfinite(vx) AND isfinite(vy))
SELECT gas_cell_id, CASE WHEN a * b <= 0 THEN 0 WHEN abs(a) < abs(b) THEN a ELSE b END AS minmod, CASE WHEN a * b <= 0 THEN 0 ELSE sign(a) * least(2 * abs(a), 2 * abs(b), 0.5 * abs(a + b)) END AS mc,
 round(CASE WHEN a * b <= 0 THEN 0 ELSE 2 * a * b / (a + b) END, 9) AS van_leer FROM d""")
def fn16(t):
    """Three slope limiters."""
    c = t.current_cells.where(finite("vx", "vy"))
    return rounded(c.select("gas_cell_id", *[f(F.col("vx"), F.col("vy")).alias(n) for n, f in H.LIMITERS.items()]), van_leer=9)


_KIN = "0.5 * density * (vx * vx + vy * vy + vz * vz)"


@query("fn17_conserved_primitive", f"SELECT gas_cell_id, round(density * vx, 6) AS mx, round(pressure / (5.0 / 3 - 1) + {_KIN}, 5) AS e, round(greatest(pressure, 1e-14), 5) AS p_back FROM {CC} WHERE {_CELL_OK} AND pressure > 0")
def fn17(t):
    """Primitive to conserved and back."""
    q = H.state(H.PRIMITIVE, *[F.col(c) for c in ("density", "vx", "vy", "vz", "pressure")], F.col("metal_mass") / F.col("mass"))
    c = _cells(t).where("pressure > 0").withColumn("c", H.conserved(q, 5 / 3))
    return rounded(c.select("gas_cell_id", F.col("c.mx").alias("mx"), F.col("c.e").alias("e"), H.primitive(F.col("c"), 5 / 3)["p"].alias("p_back")), mx=6, e=5, p_back=5)


def _interfaces(t):
    """Each cell against a mirrored and cooled copy of itself: a Riemann problem per row."""
    c = _cells(t).where("pressure > 0")
    z = F.col("metal_mass") / F.col("mass")
    left = H.state(H.PRIMITIVE, F.col("density"), F.col("vx") / 100, F.col("vy") / 100, F.col("vz") / 100, F.col("pressure"), z)
    right = H.state(H.PRIMITIVE, F.col("density") * 0.5, -F.col("vx") / 200, F.col("vy") / 100, F.col("vz") / 100, F.col("pressure") * 0.7, z)
    return c.select("gas_cell_id", left.alias("l"), right.alias("r"))


_FACE = f"""WITH c AS (SELECT *, metal_mass / mass AS zz FROM {CC} WHERE {_CELL_OK} AND pressure > 0),
s AS (SELECT gas_cell_id, density AS rl, vx / 100 AS ul, vy / 100 AS vv, vz / 100 AS ww, pressure AS pl, density * 0.5 AS rr, -vx / 200 AS ur, pressure * 0.7 AS pr, zz FROM c),
w AS (SELECT *, least(ul - sqrt(1.4 * pl / rl), ur - sqrt(1.4 * pr / rr)) AS sl, greatest(ul + sqrt(1.4 * pl / rl), ur + sqrt(1.4 * pr / rr)) AS sr, pl / 0.4 + 0.5 * rl * (ul * ul + vv * vv + ww * ww) AS el, pr / 0.4 + 0.5 * rr * (ur * ur + vv * vv + ww * ww) AS er FROM s),
f AS (SELECT *, rl * ul AS fdl, rr * ur AS fdr, rl * ul * ul + pl AS fml, rr * ur * ur + pr AS fmr, (el + pl) * ul AS fel, (er + pr) * ur AS fer,
  (pr - pl + rl * (sl - ul) * ul - rr * (sr - ur) * ur) / (rl * (sl - ul) - rr * (sr - ur)) AS sc FROM w)"""


@query("fn18_hlle_flux", _FACE + """ SELECT gas_cell_id, round(CASE WHEN sl >= 0 THEN fdl WHEN sr <= 0 THEN fdr ELSE (sr * fdl - sl * fdr + sl * sr * (rr - rl)) / (sr - sl) END, 5) AS mass_flux,
 round(CASE WHEN sl >= 0 THEN fml WHEN sr <= 0 THEN fmr ELSE (sr * fml - sl * fmr + sl * sr * (rr * ur - rl * ul)) / (sr - sl) END, 4) AS momentum_flux,
 round(CASE WHEN sl >= 0 THEN fel WHEN sr <= 0 THEN fer ELSE (sr * fel - sl * fer + sl * sr * (er - el)) / (sr - sl) END, 3) AS energy_flux,
 round(CASE WHEN sl >= 0 THEN fdl * zz WHEN sr <= 0 THEN fdr * zz ELSE 0 END, 7) AS metal_flux FROM f""")
def fn18(t):
    """Two-wave fluxes."""
    f = H.hlle(_interfaces(t), "l", "r", 1.4, "f")
    return rounded(f.select("gas_cell_id", F.col("f.d").alias("mass_flux"), F.col("f.mx").alias("momentum_flux"), F.col("f.e").alias("energy_flux"), F.col("f.zd").alias("metal_flux")), mass_flux=5, momentum_flux=4, energy_flux=3, metal_flux=7)


@query("fn19_hllc_flux", _FACE + """, p AS (SELECT *, 0.5 * (pl + rl * (sl - ul) * (sc - ul) + pr + rr * (sr - ur) * (sc - ur)) AS ps, rl * (sl - ul) / (sl - sc) AS dl, rr * (sr - ur) / (sr - sc) AS dr FROM f),
e AS (SELECT *, dl * ((sl - ul) * el - pl * ul + ps * sc) / (rl * (sl - ul)) AS xl, dr * ((sr - ur) * er - pr * ur + ps * sc) / (rr * (sr - ur)) AS xr FROM p),
k AS (SELECT *, sl < 0 AND sr > 0 AND NOT coalesce(ps > 0 AND dl > 0 AND dr > 0 AND xl > 0 AND xr > 0, false) AS fallback FROM e)
SELECT gas_cell_id, round(CASE WHEN sl >= 0 THEN fdl WHEN sr <= 0 THEN fdr WHEN fallback THEN (sr * fdl - sl * fdr + sl * sr * (rr - rl)) / (sr - sl) WHEN sc >= 0 THEN fdl + sl * (dl - rl) ELSE fdr + sr * (dr - rr) END, 5) AS mass_flux,
 round(CASE WHEN sl >= 0 THEN fml WHEN sr <= 0 THEN fmr WHEN fallback THEN (sr * fml - sl * fmr + sl * sr * (rr * ur - rl * ul)) / (sr - sl) WHEN sc >= 0 THEN fml + sl * (dl * sc - rl * ul) ELSE fmr + sr * (dr * sc - rr * ur) END, 4) AS momentum_flux, fallback FROM k""")
def fn19(t):
    """Three-wave fluxes; rows whose star states aren't physical fall back and are counted."""
    f = H.hllc(_interfaces(t), "l", "r", 1.4, "f")
    return rounded(f.select("gas_cell_id", F.col("f.d").alias("mass_flux"), F.col("f.mx").alias("momentum_flux"), F.col("f_fallback").alias("fallback")), mass_flux=5, momentum_flux=4)


@query("fn20_collapse_scales", f"""SELECT gas_cell_id, round(sqrt(3 * pi() / (32 * {G} * density)), 9) AS t_ff, round(pow(pi(), 2.5) / 6 * pow(sound_speed, 3) / (pow({G}, 1.5) * sqrt(density)), 6) AS jeans_mass,
 round((vx * vx / 1e4 + 2 * pow(sound_speed / cbrt(mass / density), 2)) / (8 * pi() * {G} * density), 5) AS alpha, round(CASE WHEN vx < 0 THEN -1 / (vx / 100) END, 7) AS t_comp FROM {CC} WHERE {_CELL_OK}""")
def fn20(t):
    """Free fall, Jeans mass, virial parameter and compression time."""
    rho, cs = F.col("density"), F.col("sound_speed")
    comp = P.compression_time(F.col("vx") / 100)
    out = _cells(t).select("gas_cell_id", P.free_fall_time(rho, G).alias("t_ff"), P.jeans_mass(rho, cs, G).alias("jeans_mass"), P.virial_parameter(rho, F.cbrt(F.col("mass") / rho), cs, F.col("vx") ** 2 / 1e4, G).alias("alpha"), F.when(comp < float("inf"), comp).alias("t_comp"))
    return rounded(out, t_ff=9, jeans_mass=6, alpha=5, t_comp=7)


METAL_LINES = [(3.0, -25.0), (4.0, -23.0), (5.0, -22.0), (7.0, -22.5)]
_ML = "pow(10, CASE WHEN lt >= 7 THEN -22.5 WHEN lt >= 5 THEN -22.0 + (lt - 5) / 2 * -0.5 WHEN lt >= 4 THEN -23.0 + (lt - 4) WHEN lt >= 3 THEN -25.0 + (lt - 3) * 2 ELSE -25.0 END)"


@query("fn21_cooling_rates", f"""WITH c AS (SELECT gas_cell_id, greatest(temperature, 10) AS tt, greatest(density, 1e-12) AS n, metal_mass / mass AS zz, log10(greatest(temperature, 10)) AS lt FROM {CC} WHERE {_CELL_OK} AND isfinite(temperature))
SELECT gas_cell_id, round((1e-22 * sqrt(tt / 1e4) * n * n + {_ML} * zz) * 1e22, 9) AS cooling22, round(2e-24 * exp(-pow((1.0 - 2) / 2.5, 2)) / (1 + pow(n / 1e-2, 1.6)) * n * 1e24, 12) AS heating24 FROM c""")
def fn21(t):
    """Cooling and heating at redshift one."""
    c = _cells(t).where(finite("temperature"))
    rate = F.pow(F.lit(10.0), T.interpolate(METAL_LINES, F.log10(F.greatest("temperature", F.lit(10.0))), 1))
    cool, heat = P.cooling_heating(F.col("temperature"), F.col("density"), F.lit(1.0), F.col("metal_mass") / F.col("mass"), rate)
    return rounded(c.select("gas_cell_id", (cool * 1e22).alias("cooling22"), (heat * 1e24).alias("heating24")), cooling22=9, heating24=12)


@query("fn22_accretion_rates", f"""SELECT p.particle_id, round(1.0 * 4 * pi() * {G} * {G} * p.mass * p.mass * c.density / pow(c.sound_speed * c.sound_speed + pow(p.vx - c.vx, 2), 1.5) * 1e6, 7) AS bondi6, round(4 * pi() * {G} * p.mass * 1.0 / (0.1 * 2.0 * 300), 9) AS eddington
FROM {CP} p JOIN {CC} c ON c.parent_particle_id = p.particle_id WHERE isfinite(p.mass) AND isfinite(p.vx) AND p.mass > 0 AND {_CELL_OK.replace('isfinite(', 'isfinite(c.').replace('AND density', 'AND c.density').replace('AND mass', 'AND c.mass')}""")
def fn22(t):
    """Bondi and Eddington rates of particles beside their cells."""
    c = _cells(t).select(F.col("parent_particle_id").alias("particle_id"), "density", "sound_speed", F.col("vx").alias("gx"))
    j = t.current_particles.where(finite("mass", "vx") & (F.col("mass") > 0)).select("particle_id", "mass", "vx").join(c, "particle_id")
    out = j.select("particle_id", (P.bondi(F.col("mass"), F.col("density"), F.col("sound_speed"), F.col("vx") - F.col("gx"), 1.0, G) * 1e6).alias("bondi6"), P.eddington(F.col("mass"), G, 1.0, 0.1, 2.0, 300.0).alias("eddington"))
    return rounded(out, bondi6=7, eddington=9)


@query("fn23_shear", f"""WITH g AS (SELECT gas_cell_id, vx / 100 AS a, vy / 100 AS b, vz / 100 AS c FROM {CC} WHERE isfinite(vx) AND isfinite(vy) AND isfinite(vz)), s AS (SELECT *, (a + b + c) / 3 AS tr FROM g)
SELECT gas_cell_id, round(sqrt(2 * (pow(a - tr, 2) + pow(b - tr, 2) + pow(c - tr, 2) + 2 * pow(0.5 * (a - b), 2))), 8) AS shear, round(least(0.02 * 0.25 * sqrt(2 * (pow(a - tr, 2) + pow(b - tr, 2) + pow(c - tr, 2) + 2 * pow(0.5 * (a - b), 2))), 0.03), 8) AS kappa FROM s""")
def fn23(t):
    """Trace-free strain of a gradient and the diffusivity it gives."""
    a, b, c, o = F.col("vx") / 100, F.col("vy") / 100, F.col("vz") / 100, F.lit(0.0)
    s = P.shear([[a, a, o], [-b, b, o], [o, o, c]])
    return rounded(t.current_cells.where(finite("vx", "vy", "vz")).select("gas_cell_id", s.alias("shear"), P.smagorinsky(s, F.lit(0.5), 0.02, 0.03).alias("kappa")), shear=8, kappa=8)


def _mix_sql(x: str) -> str:
    m = "18446744073709551616::UHUGEINT"
    return f"""(SELECT xor(c, c >> 31) FROM (SELECT (xor(b, b >> 27) * 10723151780598845931::UHUGEINT) % {m} AS c FROM (SELECT (xor(a, a >> 30) * 13787848793156543929::UHUGEINT) % {m} AS b FROM (SELECT ({x} + 11400714819323198485::UHUGEINT) % {m} AS a))))"""


@query("fn25_random", f"WITH r AS (SELECT particle_id, {_mix_sql('CAST(particle_id AS UHUGEINT)')} AS v FROM (SELECT DISTINCT particle_id FROM particles)) SELECT particle_id, CAST(v AS DECIMAL(20, 0)) AS bits, CAST(v >> 11 AS DOUBLE) / 9007199254740992 AS u01 FROM r")
def fn25(t):
    """Counter-based random bits and uniforms."""
    p = t.particles.select("particle_id").distinct()
    return p.select("particle_id", R.unsigned(R.mixed(F.col("particle_id"))).alias("bits"), R.uniform(F.col("particle_id")).alias("u01"))


@query("fn26_birth_ids", f"WITH r AS (SELECT gas_cell_id, {_mix_sql('CAST(gas_cell_id AS UHUGEINT)')} AS v FROM (SELECT DISTINCT gas_cell_id FROM cells)) SELECT gas_cell_id, CAST(v | 9223372036854775808::UHUGEINT AS DECIMAL(20, 0)) AS new_id FROM r")
def fn26(t):
    """Ids for generated particles, top bit set."""
    return t.cells.select("gas_cell_id").distinct().select("gas_cell_id", R.unsigned(R.tagged_id(F.col("gas_cell_id"))).alias("new_id"))


@query("fn28_sha256", "SELECT DISTINCT source_file_index, sha256(run_name) AS digest FROM ic_files")
def fn28(t):
    """SHA-256 of a text."""
    return t.ic_files.select("source_file_index", F.sha2("run_name", 256).alias("digest")).distinct()


@query("fn30_normalize", "SELECT dataset_path, trim(regexp_replace(lower(trim(dataset_path)), '[^a-z0-9]+', '_', 'g'), '_') AS stem FROM (SELECT DISTINCT dataset_path FROM ic_fields)")
def fn30(t):
    """A file stem from a path: lower case, other characters as single underscores."""
    stem = F.trim(F.regexp_replace(F.lower(F.trim("dataset_path")), "[^a-z0-9]+", "_"), F.lit("_"))
    return t.ic_fields.select("dataset_path").distinct().select("dataset_path", stem.alias("stem"))


@query("fn32_utc_stamp", "SELECT DISTINCT source_file_index, strftime(written_at, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM ic_files")
def fn32(t):
    """ISO-8601 stamp in UTC."""
    return t.ic_files.select("source_file_index", F.date_format("written_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp")).distinct()


@query("fn34_window", "SELECT i AS mode, round(CASE WHEN i = 0 THEN 1 ELSE sin(pi() * i / 64) / (pi() * i / 64) END, 12) AS w, round(pow(CASE WHEN i = 0 THEN 1 ELSE sin(pi() * i / 64) / (pi() * i / 64) END, 2), 12) AS w_cic FROM range(33) r(i)")
def fn34(t):
    """Assignment window per mode."""
    from nebulith.operators.spectrum import sinc

    s = sinc(math.pi * F.col("id") / 64)
    return rounded(t.spark.range(33).select(F.col("id").alias("mode"), s.alias("w"), (s * s).alias("w_cic")), w=12, w_cic=12)


_SSP = "CASE " + " ".join(
    f"WHEN {{a}} > {x0!r} THEN {y0!r} + least({'(ln({a}) - ln(' + repr(x0) + ')) / (ln(' + repr(x1) + ') - ln(' + repr(x0) + '))' if x0 > 0 else '({a} - ' + repr(x0) + ') / ' + repr(x1 - x0)}, 1) * {y1 - y0!r}"
    for (x0, y0), (x1, y1) in reversed(list(zip([(r[0], r[1]) for r in T.SSP_ROWS], [(r[0], r[1]) for r in T.SSP_ROWS][1:])))
) + " ELSE 0.0 END"


@query("jn09_table_lookup", f"WITH s AS ({STARS_SQL}) SELECT star_id, round({_SSP.format(a='age_years')}, 10) AS returned FROM s")
def jn09(t):
    """Returned fraction at the age of each star, logarithmic in age except in the first bracket."""
    return rounded(stars(t).select("star_id", T.ssp(F.col("age_years"), 1).alias("returned")), returned=10)


@query("jn09_range_lookup", "WITH s AS (SELECT DISTINCT source_file_index, scale_factor, redshift FROM ic_files), g AS (SELECT i * 0.25 AS x, sqrt(i * 0.25) AS y FROM range(29) r(i)), v AS (SELECT *, least(greatest(1 / scale_factor, 0), 7) AS q FROM s) SELECT source_file_index, round(g.y + (q - g.x) / 0.25 * (sqrt(g.x + 0.25) - g.y), 9) AS y FROM v JOIN g ON g.x = least(floor(q / 0.25), 27) * 0.25")
def jn09r(t):
    """As-of interpolation by a range join with a table's intervals."""
    table = t.spark.range(29).select((F.col("id") * 0.25).alias("tx"), F.sqrt(F.col("id") * 0.25).alias("ty"))
    points = t.ic_files.select("source_file_index", (1 / F.col("scale_factor")).alias("q")).distinct()
    return rounded(T.interpolate_join(points, table, "q", "tx", "ty", "y").select("source_file_index", "y"), y=9)


@query("wn07_interval_difference", f"WITH s AS ({STARS_SQL}) SELECT star_id, round(greatest(({_SSP.format(a='(age_years + 1e8)')}) - ({_SSP.format(a='age_years')}), 0) * birth_mass, 7) AS returned FROM s")
def wn07(t):
    """Mass returned over the next 1e8 years."""
    return rounded(stars(t).select("star_id", T.ssp_interval(F.col("age_years"), F.col("age_years") + 1e8, F.col("birth_mass"), 1).alias("returned")), returned=7)


@query("wn04_derivative", "WITH g AS (SELECT i, exp(i / 10.0) AS x, pow(exp(i / 10.0), 1.4) AS y FROM range(40) r(i)) SELECT CAST(i AS BIGINT) AS id, round((coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y)) / (coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)), 8) AS derivative FROM g WINDOW w AS (ORDER BY i)")
def wn04(t):
    """Derivative of a tabulated equation of state."""
    g = t.spark.range(40).withColumn("x", F.exp(F.col("id") / 10)).withColumn("y", F.pow("x", F.lit(1.4)))
    return rounded(T.central_derivative(g, "id", "x", "y").select("id", "derivative"), derivative=8)
