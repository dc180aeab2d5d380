"""Queries: step pipeline, timeline, stencils and conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from nebulith.functions.cosmology import Background
from nebulith.operators import steps
from nebulith.operators.base import finite
from nebulith.plans.catalog import CC, CP, query, rounded
from nebulith.sources.convert import convert

_BG = Background()
_H0 = repr(_BG.hubble0)
_OK = "isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(vx) AND isfinite(vy) AND isfinite(vz)"


@query("tm12_kick_drift_kick", f"""WITH h AS (SELECT particle_id, species_tag, x, vx + 0.5 * (50 - x) * 0.01 AS v FROM {CP} WHERE {_OK}), d AS (SELECT particle_id, CASE WHEN species_tag <> 1 THEN x + v * 0.02 ELSE x END AS x, v FROM h)
SELECT particle_id, round(x, 8) AS x, round(v + 0.5 * (50 - x) * 0.01, 8) AS vx FROM d""")
def tm12(t):
    """One kick-drift-kick step in a central force, through the stage pipeline."""
    p = t.current_particles.where(finite("x", "y", "z", "vx", "vy", "vz")).select("particle_id", "species_tag", "x", "y", "z", "vx", "vy", "vz")
    out = steps.kick_drift_kick(p, lambda df: steps.central_force(df, 50.0, 0.5), 0.02)
    return rounded(out.select("particle_id", "x", "vx"), x=8, vx=8)


def _sum(lo: str, hi: str, power: int) -> str:
    a = f"({lo} + ({hi} - {lo}) / 32 * (i + 0.5))"
    return f"list_sum([({hi} - {lo}) / 32 / (pow({a}, {power}) * {_H0} * sqrt(0.3 / pow({a}, 3) + 0.7)) FOR i IN range(32)])"


@query("tm09_timeline", f"""WITH s AS (SELECT k AS step, 0.1 * exp(k * 0.02) AS a0, 0.1 * exp(k * 0.02) * exp(0.01) AS am, 0.1 * exp(k * 0.02) * exp(0.02) AS a1 FROM range(100) r(k))
SELECT step, round(a0, 12) AS a_begin, round(a1, 12) AS a_end, round({_sum('a0', 'a1', 1)} / 1e15, 9) AS dt15, round({_sum('a0', 'a1', 3)} / 1e18, 9) AS drift18, round({_sum('a0', 'am', 2)} / am / 1e17, 9) AS kick17, round(a0 / a1, 12) AS drag FROM s""")
def tm09(t):
    """Begin, end, time, drift, kick and drag of a hundred steps."""
    s = steps.timeline(t.spark, _BG, 0.1, 0.02, 100)
    out = s.select("step", "a_begin", "a_end", (F.col("dt") / 1e15).alias("dt15"), (F.col("drift") / 1e18).alias("drift18"), (F.col("kick_1") / 1e17).alias("kick17"), "drag")
    return rounded(out, a_begin=12, a_end=12, dt15=9, drift18=9, kick17=9, drag=12)


@query("fn15_stencils", f"""WITH p AS (SELECT particle_id, (x / 100 - floor(x / 100)) * 16 AS q FROM {CP} WHERE isfinite(x)), s AS (SELECT *, q - floor(q) AS f, q - floor(q + 0.5) AS o FROM p)
SELECT particle_id, round(1 - f, 9) AS cic_0, round(f, 9) AS cic_1, round(0.5 * pow(0.5 - o, 2), 9) AS tsc_0, round(0.75 - o * o, 9) AS tsc_1, round(0.5 * pow(0.5 + o, 2), 9) AS tsc_2 FROM s""")
def fn15(t):
    """Two- and three-point weights along an axis of a 16³ mesh."""
    q = (F.col("x") / 100 - F.floor(F.col("x") / 100)) * 16
    f, o = q - F.floor(q), q - F.floor(q + 0.5)
    out = t.current_particles.where(finite("x")).select("particle_id", (1 - f).alias("cic_0"), f.alias("cic_1"), (0.5 * (0.5 - o) ** 2).alias("tsc_0"), (0.75 - o * o).alias("tsc_1"), (0.5 * (0.5 + o) ** 2).alias("tsc_2"))
    return rounded(out, cic_0=9, cic_1=9, tsc_0=9, tsc_1=9, tsc_2=9)


@query("io34_conversion", f"SELECT particle_id, x - 100 * floor(x / 100) AS x, coalesce(mass, 0.01) AS mass FROM {CP} WHERE {_OK} AND isfinite(coalesce(mass, 0.01)) AND coalesce(mass, 0.01) > 0")
def io34(t):
    """Records under alias names converted, wrapped and checked."""
    p = t.current_particles.select(F.col("particle_id").alias("ParticleIDs"), F.col("x").alias("pos_x"), "y", "z", F.col("vx").alias("vel_x"), "vy", "vz", F.col("mass").alias("Masses"), "species_tag")
    good, _ = convert(p, 100.0, mass=0.01)
    return good.select("particle_id", "x", "mass")


@query("fn35_checked_arithmetic", f"SELECT gas_cell_id, gas_cell_id * 1000 AS product, gas_cell_id <= 9223372036854775807 // 1000 AS fits FROM {CC}")
def fn35(t):
    """Checked products: an overflow gives null instead of a wrapped value."""
    c = t.current_cells
    return c.select("gas_cell_id", F.try_multiply(F.col("gas_cell_id"), F.lit(1000).cast("long")).alias("product"), F.try_multiply(F.col("gas_cell_id"), F.lit(1000).cast("long")).isNotNull().alias("fits"))
