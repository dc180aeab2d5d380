"""Queries: health, budgets, grids and reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from nebulith.operators import diagnostics as D
from nebulith.plans.catalog import CC, CP, query, rounded
from nebulith.plans.frames import STARS_SQL, stars

BOX = 100.0
_OK = "isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(vx) AND isfinite(vy) AND isfinite(vz) AND isfinite(mass)"


@query("ag01_run_health", f"""
SELECT snap_step, count(*) AS n_particles, count(DISTINCT particle_id) AS n_ids, count(*) FILTER (NOT coalesce({_OK}, false)) AS non_finite,
  count(*) FILTER (isfinite(mass) AND mass <= 0) AS non_positive_mass, count(*) FILTER (softening IS NOT NULL AND (NOT isfinite(softening) OR softening < 0)) AS bad_softening,
  count(*) = count(DISTINCT particle_id) AS unique_ids FROM particles GROUP BY snap_step""")
def ag01(t):
    """Run-health counters per snapshot, over all rows as stored."""
    return D.run_health(t.particles, "snap_step")


@query("ag01_cell_health", "SELECT count(*) AS n_cells, count(*) FILTER (NOT coalesce(isfinite(cx) AND isfinite(cy) AND isfinite(cz) AND isfinite(mass) AND isfinite(density), false)) AS non_finite FROM cells")
def ag01c(t):
    return D.cell_health(t.cells)


@query("ag02_angular_momentum", f"""
WITH p AS (SELECT species_tag, mass * (y * vz - z * vy) AS lx, mass * (z * vx - x * vz) AS ly, mass * (x * vy - y * vx) AS lz FROM {CP} WHERE {_OK})
SELECT 'total' AS class, count(*) AS n, round(sum(lx), 3) AS lx, round(sum(ly), 3) AS ly, round(sum(lz), 3) AS lz FROM p
UNION ALL SELECT ['dark_matter', 'gas', 'star', 'black_hole'][species_tag + 1], count(*), round(sum(lx), 3), round(sum(ly), 3), round(sum(lz), 3) FROM p WHERE species_tag < 4 GROUP BY species_tag""")
def ag02(t):
    """Angular momentum, total and per species."""
    return rounded(D.angular_momentum(t.current_particles), lx=3, ly=3, lz=3)


@query("ag03_star_formation_history", f"""
WITH s AS ({STARS_SQL}), h AS (SELECT least(CAST(floor(formation_a * 32) AS INT), 31) AS bin, count(*) AS n, sum(birth_mass) AS m FROM s GROUP BY 1)
SELECT CAST(b AS INT) AS bin, coalesce(n, 0) AS n_stars, round(coalesce(m, 0), 4) AS birth_mass FROM range(32) r(b) LEFT JOIN h ON h.bin = b""")
def ag03(t):
    """Birth mass per bin of scale factor; empty bins stay."""
    return rounded(D.star_formation_history(stars(t), 32), birth_mass=4)


@query("ag04_gas_slice", f"""
WITH c AS (SELECT least(CAST(floor(least(greatest(cx / 100, 0), 1) * 16) AS INT), 15) AS ix, least(CAST(floor(least(greatest(cy / 100, 0), 1) * 16) AS INT), 15) AS iy, density
  FROM {CC} WHERE isfinite(cx) AND isfinite(cy) AND isfinite(cz) AND isfinite(density) AND abs(cz - 50.0) <= 100.0 / 32), m AS (SELECT ix, iy, avg(density) AS d FROM c GROUP BY ALL)
SELECT CAST(a AS INT) AS ix, CAST(b AS INT) AS iy, round(coalesce(d, 0), 6) AS density FROM range(16) r(a), range(16) s(b) LEFT JOIN m ON m.ix = a AND m.iy = b""")
def ag04(t):
    """Mean density in the middle plane."""
    return rounded(D.gas_slice(t.current_cells, 16, BOX), density=6)


@query("ag05_gas_projection", f"""
WITH c AS (SELECT least(CAST(floor(least(greatest(cx / 100, 0), 1) * 16) AS INT), 15) AS ix, least(CAST(floor(least(greatest(cy / 100, 0), 1) * 16) AS INT), 15) AS iy, density
  FROM {CC} WHERE isfinite(cx) AND isfinite(cy) AND isfinite(cz) AND isfinite(density)), m AS (SELECT ix, iy, sum(density) AS d FROM c GROUP BY ALL)
SELECT CAST(a AS INT) AS ix, CAST(b AS INT) AS iy, round(coalesce(d, 0), 4) AS density FROM range(16) r(a), range(16) s(b) LEFT JOIN m ON m.ix = a AND m.iy = b""")
def ag05(t):
    """Summed density along z."""
    return rounded(D.gas_projection(t.current_cells, 16, BOX), density=4)


_METAL = f"""
WITH c AS (SELECT *, coalesce(isfinite(mass) AND isfinite(metal_mass) AND mass >= 0 AND metal_mass >= 0 AND metal_mass <= mass, false) AS ok, CASE WHEN mass > 0 THEN metal_mass / mass ELSE 0 END AS zz FROM {CC}),
g AS (SELECT coalesce(sum(metal_mass) FILTER (ok), 0) AS metals, coalesce(sum(mass) FILTER (ok), 0) AS gas, coalesce(min(zz) FILTER (ok), 0) AS z_min, coalesce(max(zz) FILTER (ok), 0) AS z_max,
  coalesce(sum(mass) FILTER (ok AND metal_mass = 0), 0) AS free, count(*) FILTER (NOT ok) AS n_invalid FROM c),
s AS ({STARS_SQL}),
b AS (SELECT sum(birth_mass * metallicity) AS birth, sum(greatest(birth_mass * metallicity - greatest(returned_metals - new_metals, 0), 0)) AS locked, sum(new_metals) AS new_metals,
  sum(returned_metals) AS returned, sum(deposited_metals) AS deposited, sum(carry_metals) AS carried FROM s)
"""


@query("ag06_gas_metal_budget", _METAL + "SELECT round(metals, 8) AS gas_metals, round(z_min, 10) AS z_min, round(z_max, 10) AS z_max, round(metals / gas, 10) AS z_mean, round(free / gas, 10) AS metal_free_fraction, n_invalid FROM g")
def ag06(t):
    """Gas metal budget."""
    return rounded(D.gas_metal_budget(t.current_cells), gas_metals=8, z_min=10, z_max=10, z_mean=10, metal_free_fraction=10)


@query("ag06_star_metal_budget", _METAL + "SELECT round(birth, 4) AS birth_metals, round(locked, 4) AS locked_metals, round(new_metals, 4) AS new_metals, round(returned, 4) AS returned_metals, round(deposited, 4) AS deposited_metals, round(carried, 4) AS carried_metals, round(returned - deposited - carried, 3) AS deposition_residual FROM b")
def ag06s(t):
    """Stellar metal budget."""
    return rounded(D.star_metal_budget(stars(t)), birth_metals=4, locked_metals=4, new_metals=4, returned_metals=4, deposited_metals=4, carried_metals=4, deposition_residual=3)


@query("ag07_metal_audit", _METAL + "SELECT round(metals + locked + carried - (10.0 + b.new_metals - 0.5), 3) AS residual FROM g, b")
def ag07(t):
    """Metals accounted for against initial, new and escaped metals."""
    return rounded(D.metal_audit(D.gas_metal_budget(t.current_cells), D.star_metal_budget(stars(t)), 10.0, 0.5), residual=3)


_W = f"w AS (SELECT x / 100 - floor(x / 100) AS x, y / 100 - floor(y / 100) AS y, z / 100 - floor(z / 100) AS z, mass FROM {CP} WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(mass))"


@query("ag08_mass_ngp", f"WITH {_W} SELECT CAST(floor(x * 16) AS INT) % 16 AS ix, CAST(floor(y * 16) AS INT) % 16 AS iy, CAST(floor(z * 16) AS INT) % 16 AS iz, round(sum(mass), 8) AS mass FROM w GROUP BY ALL")
def ag08(t):
    """Mass in the floor cell of a 16³ mesh."""
    return rounded(D.mass_on_grid(t.current_particles, 16, BOX, "ngp"), mass=8)


@query("ag09_mass_cic", f"""WITH {_W}, o AS (SELECT unnest([0, 1]) AS o)
SELECT (CAST(floor(x * 16) AS INT) + a.o) % 16 AS ix, (CAST(floor(y * 16) AS INT) + b.o) % 16 AS iy, (CAST(floor(z * 16) AS INT) + c.o) % 16 AS iz,
 round(sum(mass * abs(1 - a.o - (x * 16 - floor(x * 16))) * abs(1 - b.o - (y * 16 - floor(y * 16))) * abs(1 - c.o - (z * 16 - floor(z * 16)))), 8) AS mass FROM w, o a, o b, o c GROUP BY ALL""")
def ag09(t):
    """Mass by cloud-in-cell weights on a 16³ mesh."""
    return rounded(D.mass_on_grid(t.current_particles, 16, BOX, "cic"), mass=8)


@query("ag18_identity_summary", f"""
SELECT count(*) AS n, CAST(CAST(sum(particle_id) AS HUGEINT) % 18446744073709551616 AS DECIMAL(20,0)) AS id_sum, CAST(sum(CAST(particle_id AS HUGEINT) * particle_id) % 18446744073709551616 AS DECIMAL(20,0)) AS id_square_sum,
 bit_xor(particle_id) AS id_xor, count(*) = count(DISTINCT particle_id) AS unique_ids FROM {CP}""")
def ag18(t):
    """Identity summary of the particle ids."""
    return D.identity_summary(t.current_particles, "particle_id")


@query("ag23_conserved_totals", f"""
SELECT round(sum(mass), 6) AS mass, round(sum(mass * vx), 4) AS px, round(sum(mass * vy), 4) AS py, round(sum(mass * vz), 4) AS pz, round(sum(0.5 * mass * (vx * vx + vy * vy + vz * vz)), 2) AS kinetic,
 round(sum(mass * internal_energy), 4) AS internal, round(sum(0.5 * mass * (vx * vx + vy * vy + vz * vz) + mass * internal_energy), 2) AS total_energy, round(sum(metal_mass), 8) AS metals
FROM {CC} WHERE isfinite(mass) AND isfinite(vx) AND isfinite(vy) AND isfinite(vz) AND isfinite(internal_energy)""")
def ag23(t):
    """Conserved totals of the gas."""
    return rounded(D.conserved_totals(t.current_cells), mass=6, px=4, py=4, pz=4, kinetic=2, internal=4, total_energy=2, metals=8)


@query("ag24_bounds", "SELECT min(x) FILTER (ok) AS min_x, min(y) FILTER (ok) AS min_y, min(z) FILTER (ok) AS min_z, max(x) FILTER (ok) AS max_x, max(y) FILTER (ok) AS max_y, max(z) FILTER (ok) AS max_z, count(*) FILTER (NOT ok) AS n_not_finite FROM (SELECT *, coalesce(isfinite(x) AND isfinite(y) AND isfinite(z), false) AS ok FROM particles)")
def ag24(t):
    """Bounds of all finite positions."""
    return D.bounds(t.particles, ("x", "y", "z"))


@query("ag26_patch_totals", f"SELECT patch_id, count(*) AS n_cells, round(sum(mass), 8) AS mass, round(sum(mass * vx), 6) AS px, round(sum(metal_mass), 10) AS metals FROM {CC} WHERE isfinite(mass) AND isfinite(vx) GROUP BY patch_id")
def ag26(t):
    """Conserved sums per patch; a heavy patch is reduced before the shuffle."""
    c = t.current_cells.where(D.finite("mass", "vx"))
    out = c.groupBy("patch_id").agg(F.count("*").alias("n_cells"), F.sum("mass").alias("mass"), F.sum(F.col("mass") * F.col("vx")).alias("px"), F.sum("metal_mass").alias("metals"))
    return rounded(out, mass=8, px=6, metals=10)


@query("ag27_patch_refinement", f"""
SELECT patch_id, CASE WHEN bool_or(mass > 0.012) THEN 'refine' WHEN bool_and(mass < 0.010) THEN 'derefine' ELSE 'keep' END AS decision FROM {CC} WHERE isfinite(mass) GROUP BY patch_id""")
def ag27(t):
    """Any cell that asks to refine refines its patch; all must ask to derefine it."""
    from nebulith.operators.amr import patch_decision

    return patch_decision(t.current_cells.where(D.finite("mass")), F.col("mass") > 0.012, F.col("mass") < 0.010)


_MICRO = lambda c: f"CASE WHEN {c} IS NULL THEN 'null' WHEN isfinite({c}) THEN CAST(CAST(floor({c} * 1e6) AS BIGINT) AS VARCHAR) ELSE 'nan' END"


@query("ag31_state_digest", f"SELECT bit_xor(CAST(('0x' || substr(md5('' || particle_id || '|' || {_MICRO('x')} || '|' || {_MICRO('y')} || '|' || {_MICRO('z')} || '|' || {_MICRO('mass')}), 1, 15)) AS BIGINT)) AS digest, count(*) AS n FROM {CP}")
def ag31(t):
    """Digest of the particle state in whole millionths, so that other engines get the same."""
    return D.portable_digest(t.current_particles, ["particle_id", "x", "y", "z", "mass"])


@query("ag32_rank_reduce", f"SELECT owning_rank, count(*) AS n, max(particle_id) AS max_id, bit_xor(particle_id) AS id_xor, sum(time_bin) AS bin_sum FROM {CP} GROUP BY owning_rank")
def ag32(t):
    """Sum, maximum and exclusive or per rank, as an all-reduce would give them."""
    return t.current_particles.groupBy("owning_rank").agg(F.count("*").alias("n"), F.max("particle_id").alias("max_id"), F.bit_xor("particle_id").alias("id_xor"), F.sum("time_bin").alias("bin_sum"))
