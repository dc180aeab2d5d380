"""Queries: gravity, gas dynamics and adaptive mesh."""

from __future__ import annotations

from pyspark.sql import functions as F

from nebulith.operators import amr as A
from nebulith.operators import gravity as G
from nebulith.operators import hydro_step as S
from nebulith.operators.base import finite
from nebulith.plans.catalog import CC, CG, CP, query, rounded

BOX, NEWTON = 100.0, 43.0
_P = f"p AS (SELECT particle_id AS item, x - 100 * floor(x / 100) AS x, y - 100 * floor(y / 100) AS y, z - 100 * floor(z / 100) AS z, mass, coalesce(softening, 0.5) AS eps, species_tag, snap_step FROM {CP} WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(mass))"
_DEPTH = 6


def _points(t):
    p = t.current_particles.where(finite("x", "y", "z", "mass"))
    return p.select(F.col("particle_id").alias("item"), *[(F.col(c) - 100 * F.floor(F.col(c) / 100)).alias(c) for c in "xyz"], "mass", F.coalesce("softening", F.lit(0.5)).alias("eps"), "species_tag", "snap_step")


def _asked(t):
    """Targets of a direct sum: every particle whose id is divisible by 20, against all particles."""
    return _points(t).where("item % 20 = 0").select(F.col("item").alias("target"), "x", "y", "z", "eps")


def _sp(c: str, shift: int) -> str:
    return " | ".join(f"(((least(CAST(floor({c} / 100 * 64) AS BIGINT), 63) >> {i}) & 1) << {3 * i + shift})" for i in range(_DEPTH))


@query("gr01_tree_nodes", f"""WITH {_P}, k AS (SELECT *, ({_sp('x', 2)}) | ({_sp('y', 1)}) | ({_sp('z', 0)}) AS key FROM p), l AS (SELECT CAST(l AS INT) AS level FROM range({_DEPTH + 1}) r(l)),
a AS (SELECT level, key >> (3 * ({_DEPTH} - level)) AS prefix, count(*) AS n, sum(mass) AS mass, sum(mass * x) AS sx FROM k, l GROUP BY ALL)
SELECT c.level, c.prefix, c.n, round(c.mass, 8) AS mass, round(c.sx, 6) AS sx, c.n <= 16 OR c.level = {_DEPTH} AS is_leaf FROM a c LEFT JOIN a u ON u.level = c.level - 1 AND u.prefix = c.prefix >> 3 WHERE c.level = 0 OR u.n > 16""")
def gr01(t):
    """Octree nodes as curve prefixes with their moments."""
    return rounded(G.tree_nodes(_points(t), _DEPTH, BOX).select("level", "prefix", "n", "mass", "sx", "is_leaf"), mass=8, sx=6)


@query("ag25_node_multipoles", f"""WITH {_P}, k AS (SELECT *, ({_sp('x', 2)}) | ({_sp('y', 1)}) | ({_sp('z', 0)}) AS key FROM p)
SELECT key >> 9 AS prefix, round(sum(mass * x) / sum(mass), 8) AS com_x, round(sum(mass * x * y) - sum(mass * x) * sum(mass * y) / sum(mass), 5) AS qxy, min(eps) AS eps_min, max(eps) AS eps_max FROM k GROUP BY 1""")
def ag25(t):
    """Centre of mass and a second moment about it, per node of level 3, by the additive sums."""
    points = _points(t)
    nodes = G.tree_nodes(points, _DEPTH, BOX, leaf_size=0).where("level = 3")
    return rounded(nodes.select("prefix", (F.col("sx") / F.col("mass")).alias("com_x"), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("mass")).alias("qxy"), "eps_min", "eps_max"), com_x=8, qxy=5)


@query("gr04_tree_acceleration")
def gr04(t):
    """Tree forces on all particles from all particles; checked against the direct sum in the tests."""
    from nebulith.operators.tree_walk import tree_walk
    from nebulith.runtime import Scratch

    points = Scratch(t.spark, "points").write(_points(t))
    depth = G.tree_depth(points.count())
    return tree_walk(points.select(F.col("item").alias("target"), "x", "y", "z", "eps"), points, BOX, depth, NEWTON)


_DIRECT = f"{_P}, h AS (SELECT * FROM p WHERE item % 20 = 0), acc AS (SELECT h.item AS target, " + ", ".join(f"sum({NEWTON} * p.mass * (p.{c} - h.{c}) * pow(pow(p.x - h.x, 2) + pow(p.y - h.y, 2) + pow(p.z - h.z, 2) + pow(greatest(h.eps, p.eps), 2), -1.5)) AS a{c}" for c in "xyz") + " FROM h JOIN p ON p.item <> h.item GROUP BY h.item)"


def _direct(t):
    return G.direct_acceleration(_asked(t), _points(t).select("item", "x", "y", "z", "mass", "eps"), NEWTON)


@query("gr03_direct_acceleration", f"WITH {_DIRECT} SELECT target, round(ax, 6) AS ax, round(ay, 6) AS ay, round(az, 6) AS az FROM acc")
def gr03(t):
    """Direct softened sums for every twentieth particle by id, all particles as sources."""
    return rounded(_direct(t), ax=6, ay=6, az=6)


_TS = "[{{'i': floor({c} * 16 + 0.5) - 1, 'w': 0.5 * pow(0.5 - ({c} * 16 - floor({c} * 16 + 0.5)), 2)}}, {{'i': floor({c} * 16 + 0.5), 'w': 0.75 - pow({c} * 16 - floor({c} * 16 + 0.5), 2)}}, {{'i': floor({c} * 16 + 0.5) + 1, 'w': 0.5 * pow(0.5 + ({c} * 16 - floor({c} * 16 + 0.5)), 2)}}]"


@query("gr05_mesh_density", f"""WITH {_P}, f AS (SELECT x / 100 AS x, y / 100 AS y, z / 100 AS z, mass FROM p), a AS (SELECT mass, unnest({_TS.format(c='x')}) AS px, y, z FROM f), b AS (SELECT mass, px, unnest({_TS.format(c='y')}) AS py, z FROM a), c AS (SELECT mass, px, py, unnest({_TS.format(c='z')}) AS pz FROM b)
SELECT (CAST(px.i AS INT) + 16) % 16 AS ix, (CAST(py.i AS INT) + 16) % 16 AS iy, (CAST(pz.i AS INT) + 16) % 16 AS iz, round(sum(mass * px.w * py.w * pz.w) / pow(6.25, 3), 9) AS density FROM c GROUP BY ALL""")
def gr05(t):
    """Three-point density on a 16³ mesh."""
    return rounded(G.mesh_density(_points(t), 16, BOX, "tsc"), density=9)


@query("gr06_poisson_periodic")
def gr06(t):
    """Potential and forces on a 64³ mesh, too large for sums over all modes; gr06_poisson_small has the SQL."""
    return G.poisson_periodic(G.mesh_density(_points(t), 64, BOX), 64, BOX, NEWTON)


def _isolated_sql() -> str:
    from nebulith.plans.reference_k import isolated_sql

    return isolated_sql(16)


@query("gr07_poisson_isolated", _isolated_sql())
def gr07(t):
    """Isolated potential and its forces on a 16³ mesh. (The SQL sums over all pairs of mesh points.)"""
    return rounded(G.poisson_isolated(G.mesh_density(_points(t), 16, BOX), 16, BOX, NEWTON), phi=5, fx=5, fy=5, fz=5)


@query("gr08_mesh_gather", f"""WITH {_P}, m AS (SELECT CAST(i // 64 AS INT) AS ix, CAST((i // 8) % 8 AS INT) AS iy, CAST(i % 8 AS INT) AS iz, sin(i) AS fx FROM range(512) r(i)), o AS (SELECT unnest([0, 1]) AS o), f AS (SELECT item, x / 100 * 8 AS x, y / 100 * 8 AS y, z / 100 * 8 AS z FROM p)
SELECT item, round(sum(fx * abs(1 - a.o - (x - floor(x))) * abs(1 - b.o - (y - floor(y))) * abs(1 - c.o - (z - floor(z)))), 9) AS fx FROM f, o a, o b, o c JOIN m ON ix = (CAST(floor(x) AS INT) + a.o) % 8 AND iy = (CAST(floor(y) AS INT) + b.o) % 8 AND iz = (CAST(floor(z) AS INT) + c.o) % 8 GROUP BY item""")
def gr08(t):
    """Mesh values gathered at the particles."""
    i = F.col("id")
    mesh = t.spark.range(512).select(F.floor(i / 64).cast("int").alias("ix"), (F.floor(i / 8) % 8).cast("int").alias("iy"), (i % 8).cast("int").alias("iz"), F.sin(i.cast("double")).alias("fx"))
    return rounded(G.interpolate_mesh(_points(t), mesh, 8, BOX, ("fx",)), fx=9)


@query("gr10_mesh_acceleration")
def gr10(t):
    """Assign, solve and interpolate on a 64³ mesh; gr10_mesh_small has the SQL."""
    return G.mesh_acceleration(_points(t), 64, BOX, NEWTON)


@query("gr11_tree_mesh")
def gr11(t):
    """Long range from the mesh plus short-range pairs within the cutoff, snapshot by snapshot for the pairs."""
    return G.tree_mesh_acceleration(_points(t), 32, BOX, NEWTON, 0.6, 2.0, "snap_step")


@query("gr18_zoom_correction")
def gr18(t):
    """A second mesh for a chosen region: the particles within it, on a mesh of an eighth of the box."""
    inner = _points(t).where((F.col("x") < 50) & (F.col("y") < 50) & (F.col("z") < 50))
    return G.mesh_acceleration(inner, 32, 50.0, NEWTON)


@query("gr13_slab_owner", "SELECT CAST(i AS BIGINT) AS plane, CAST(CASE WHEN i < 22 * 6 THEN i // 6 ELSE 22 + (i - 132) // 5 END AS INT) AS owner FROM range(132 + 5 * 2) r(i)")
def gr13(t):
    """Owners of 142 mesh planes on 24 ranks."""
    return t.spark.range(142).select(F.col("id").alias("plane"), G.slab_owner(F.col("id"), 142, 24).alias("owner"))


@query("gr16_kick", f"WITH {_DIRECT} SELECT particle_id, round(CASE WHEN target IS NOT NULL THEN vx * 0.99 + ax * 0.001 ELSE vx END, 8) AS vx, round(CASE WHEN target IS NOT NULL THEN vz * 0.99 + az * 0.001 ELSE vz END, 8) AS vz FROM {CP} c LEFT JOIN acc ON target = particle_id WHERE isfinite(vx) AND isfinite(vy) AND isfinite(vz)")
def gr16(t):
    """Kick of an active set by its direct accelerations; the others keep their velocity."""
    p = t.current_particles.where(finite("vx", "vy", "vz")).select("particle_id", "vx", "vy", "vz")
    return rounded(G.kick(p, _direct(t).withColumnRenamed("target", "particle_id"), 0.99, 0.001).select("particle_id", "vx", "vz"), vx=8, vz=8)


@query("gr17_drift", f"SELECT particle_id, round(CASE WHEN species_tag <> 1 THEN x + vx * 0.01 ELSE x END, 9) AS x FROM {CP} WHERE isfinite(x) AND isfinite(vx)")
def gr17(t):
    """Drift of all particles but gas, without a wrap."""
    return rounded(G.drift(t.current_particles.where(finite("x", "vx")), 0.01).select("particle_id", "x"), x=9)


@query("gr19_gravity_health", f"WITH {_DIRECT}, s AS (SELECT sqrt(ax * ax + ay * ay + az * az) AS a FROM acc) SELECT count(*) AS n, count(*) FILTER (NOT coalesce(isfinite(a), false)) AS non_finite, round(max(a), 4) AS largest, count(*) FILTER (a > 2) AS over_limit FROM s")
def gr19(t):
    """Finite checks and a limit on the direct accelerations of an active set."""
    return rounded(G.gravity_health(_direct(t), 2.0), largest=4)


_N, _GAMMA, _DT = 8, 1.4, 0.002
_DX = BOX / _N
_GRID = f"""g AS (SELECT CAST(i // 64 AS INT) AS ix, CAST((i // 8) % 8 AS INT) AS iy, CAST(i % 8 AS INT) AS iz FROM range(512) r(i)),
m AS (SELECT CAST(floor((x / 100 - floor(x / 100)) * 8) AS INT) AS ix, CAST(floor((y / 100 - floor(y / 100)) * 8) AS INT) AS iy, CAST(floor((z / 100 - floor(z / 100)) * 8) AS INT) AS iz, sum(mass) AS m, sum(mass * vx) AS px, sum(mass * vy) AS py, sum(mass * vz) AS pz, avg(time_bin) AS b
  FROM {CP} WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(vx) AND isfinite(vy) AND isfinite(vz) AND isfinite(mass) GROUP BY 1, 2, 3),
s AS (SELECT g.*, coalesce(m, 0) + 0.01 AS rho, coalesce(px, 0) / (coalesce(m, 0) + 0.01) / 100 AS u, coalesce(py, 0) / (coalesce(m, 0) + 0.01) / 100 AS v, coalesce(pz, 0) / (coalesce(m, 0) + 0.01) / 100 AS w, 1 + 2 * (coalesce(m, 0) + 0.01) AS p, coalesce(b, 0) / 100 AS z FROM g LEFT JOIN m USING (ix, iy, iz))"""


def _grid(t):
    return S.grid_state(t.current_particles, _N, BOX)


@query("hy01_patch_geometry", "SELECT (CAST(i // 64 AS INT) * 8 + CAST((i // 8) % 8 AS INT)) * 8 + CAST(i % 8 AS INT) AS owner, CAST(a AS INT) AS axis, CASE a WHEN 0 THEN (((i // 64 + 1) % 8) * 8 + (i // 8) % 8) * 8 + i % 8 WHEN 1 THEN ((i // 64) * 8 + ((i // 8) % 8 + 1) % 8) * 8 + i % 8 ELSE ((i // 64) * 8 + (i // 8) % 8) * 8 + (i % 8 + 1) % 8 END AS neighbor FROM range(512) r(i), range(3) s(a)")
def hy01(t):
    """Faces of an 8³ patch."""
    from nebulith.operators.spatial import grid_faces

    i = F.col("id")
    cells = t.spark.range(512).select(F.floor(i / 64).cast("int").alias("ix"), (F.floor(i / 8) % 8).cast("int").alias("iy"), (i % 8).cast("int").alias("iz"))
    return grid_faces(cells, 8).select("owner", "axis", F.col("neighbor").cast("long").alias("neighbor"))


@query("hy02_ghost_fill", f"WITH {_GRID} SELECT a.ix, a.iy, a.iz, round(CASE WHEN a.ix = 0 THEN -a.u ELSE l.u END, 8) AS lo_u, round(CASE WHEN a.ix = 7 THEN a.rho ELSE h.rho END, 8) AS hi_rho FROM s a JOIN s l ON l.ix = (a.ix + 7) % 8 AND l.iy = a.iy AND l.iz = a.iz JOIN s h ON h.ix = (a.ix + 1) % 8 AND h.iy = a.iy AND h.iz = a.iz")
def hy02(t):
    """Reflective ghosts along x: the normal velocity turned round."""
    out = S.neighbours(_grid(t), _N, 0, "reflective")
    return rounded(out.select("ix", "iy", "iz", F.col("lo.u").alias("lo_u"), F.col("hi.rho").alias("hi_rho")), lo_u=8, hi_rho=8)


@query("hy04_constant_reconstruction", f"WITH {_GRID} SELECT ix, iy, iz, round(rho, 8) AS left_rho, round(p, 8) AS right_p FROM s")
def hy04(t):
    """Piecewise-constant face states."""
    r = S.reconstruct(_grid(t), _N, 0, None)
    return rounded(r.select("ix", "iy", "iz", F.col("at_lo.rho").alias("left_rho"), F.col("at_hi.p").alias("right_p")), left_rho=8, right_p=8)


_MM = "CASE WHEN ({a}) * ({b}) <= 0 THEN 0 WHEN abs({a}) < abs({b}) THEN {a} ELSE {b} END"


@query("hy05_muscl", f"""WITH {_GRID}, d AS (SELECT a.*, {_MM.format(a='a.rho - l.rho', b='h.rho - a.rho')} AS sr, {_MM.format(a='a.u - l.u', b='h.u - a.u')} AS su, {_MM.format(a='a.p - l.p', b='h.p - a.p')} AS sp FROM s a JOIN s l ON l.ix = (a.ix + 7) % 8 AND l.iy = a.iy AND l.iz = a.iz JOIN s h ON h.ix = (a.ix + 1) % 8 AND h.iy = a.iy AND h.iz = a.iz)
SELECT ix, iy, iz, round(greatest(rho + 0.5 * sr + 0.5 * 0.01 * (-u * sr - rho * su), 1e-12), 8) AS hi_rho, round(u + 0.5 * su + 0.5 * 0.01 * (-u * su - sp / rho), 8) AS hi_u, round(greatest(p + 0.5 * sp + 0.5 * 0.01 * (-u * sp - 1.4 * p * su), 1e-12), 7) AS hi_p FROM d""")
def hy05(t):
    """Limited slopes with a half-step predictor at the upper faces."""
    r = S.reconstruct(_grid(t), _N, 0, "minmod", 0.01, _GAMMA)
    return rounded(r.select("ix", "iy", "iz", F.col("at_hi.rho").alias("hi_rho"), F.col("at_hi.u").alias("hi_u"), F.col("at_hi.p").alias("hi_p")), hi_rho=8, hi_u=8, hi_p=7)


def _axis_flux(axis: int) -> str:
    n = "uvw"[axis]
    j = " AND ".join(f"b.{c} = (a.{c} + 1) % 8" if i == axis else f"b.{c} = a.{c}" for i, c in enumerate(("ix", "iy", "iz")))
    return f"""w{axis} AS (SELECT a.ix, a.iy, a.iz, a.rho AS rl, b.rho AS rr, a.{n} AS ul, b.{n} AS ur, a.p AS pl, b.p AS pr, a.p / 0.4 + 0.5 * a.rho * (a.u * a.u + a.v * a.v + a.w * a.w) AS el, b.p / 0.4 + 0.5 * b.rho * (b.u * b.u + b.v * b.v + b.w * b.w) AS er,
 least(a.{n} - sqrt(1.4 * a.p / a.rho), b.{n} - sqrt(1.4 * b.p / b.rho)) AS sl, greatest(a.{n} + sqrt(1.4 * a.p / a.rho), b.{n} + sqrt(1.4 * b.p / b.rho)) AS sr FROM s a JOIN s b ON {j}),
f{axis} AS (SELECT ix, iy, iz, CASE WHEN sl >= 0 THEN rl * ul WHEN sr <= 0 THEN rr * ur ELSE (sr * rl * ul - sl * rr * ur + sl * sr * (rr - rl)) / (sr - sl) END AS d,
 CASE WHEN sl >= 0 THEN (el + pl) * ul WHEN sr <= 0 THEN (er + pr) * ur ELSE (sr * (el + pl) * ul - sl * (er + pr) * ur + sl * sr * (er - el)) / (sr - sl) END AS e FROM w{axis})"""


_BACK = [" AND ".join(f"b{a}.{c} = (s.{c} + 7) % 8" if i == a else f"b{a}.{c} = s.{c}" for i, c in enumerate(("ix", "iy", "iz"))) for a in range(3)]
_ADV = f"""WITH {_GRID}, {_axis_flux(0)}, {_axis_flux(1)}, {_axis_flux(2)}
SELECT s.ix, s.iy, s.iz, round(s.rho + {_DT} / {_DX} * (b0.d - a0.d + b1.d - a1.d + b2.d - a2.d), 8) AS rho, round(s.p / 0.4 + 0.5 * s.rho * (s.u * s.u + s.v * s.v + s.w * s.w) + {_DT} / {_DX} * (b0.e - a0.e + b1.e - a1.e + b2.e - a2.e), 7) AS energy FROM s
{" ".join(f"JOIN f{a} a{a} ON a{a}.ix = s.ix AND a{a}.iy = s.iy AND a{a}.iz = s.iz JOIN f{a} b{a} ON {_BACK[a]}" for a in range(3))}"""


@query("hy06_finite_volume_step", _ADV)
def hy06(t):
    """One first-order step on an 8³ periodic grid."""
    new = S.advance(_grid(t), _N, _DX, _DT, _GAMMA)
    e = F.col("p") / (_GAMMA - 1) + 0.5 * F.col("rho") * (F.col("u") ** 2 + F.col("v") ** 2 + F.col("w") ** 2)
    return rounded(new.select("ix", "iy", "iz", "rho", e.alias("energy")), rho=8, energy=7)


@query("hy06_second_order_steps")
def hy06s(t):
    """Two steps with limited slopes and three-wave fluxes; totals are checked in the tests."""
    return S.evolve(_grid(t), _N, _DX, _DT, _GAMMA, 2, "hllc", "mc")


@query("hy07_comoving_source", f"WITH {_GRID} SELECT ix, iy, iz, round(rho * 0.1 - 0.07 * rho * u, 9) AS mx, round(rho * (u * 0.1 + v * 0.2 + w * 0.3) - 2 * 0.07 * 0.5 * rho * (u * u + v * v + w * w) - 3 * 0.07 * p, 8) AS e FROM s")
def hy07(t):
    """Gravity's work and the Hubble drag as rates."""
    q = {c: F.col(c) for c in ("rho", "u", "v", "w", "p", "z")}
    src = S.comoving_sources(q, (F.lit(0.1), F.lit(0.2), F.lit(0.3)), F.lit(0.07), _GAMMA)
    return rounded(_grid(t).select("ix", "iy", "iz", src["mx"].alias("mx"), src["e"].alias("e")), mx=9, e=8)


_AC = f"c AS (SELECT gas_cell_id AS key, patch_id, cx, cy, cz, mass, metal_mass, density, cbrt(mass / density) AS width, 0 AS level FROM {CC} WHERE isfinite(cx) AND isfinite(cy) AND isfinite(cz) AND isfinite(mass) AND isfinite(density) AND isfinite(metal_mass) AND density > 0 AND mass > 0)"


def _cells(t):
    c = t.current_cells.where(finite("cx", "cy", "cz", "mass", "density", "metal_mass") & (F.col("density") > 0) & (F.col("mass") > 0))
    return c.select(F.col("gas_cell_id").alias("key"), "patch_id", "cx", "cy", "cz", "mass", "metal_mass", "density", F.cbrt(F.col("mass") / F.col("density")).alias("width"), F.lit(0).alias("level"))


@query("am01_refinement_test", f"WITH {_AC} SELECT key, mass > 0.012 OR density / 10 > 1.5 OR width * 100 < 5 AS refine, mass < 0.006 AND density / 10 < 0.75 AND width * 100 > 10 AS derefine FROM c")
def am01(t):
    """Refinement by mass, a gradient and the Jeans number, with hysteresis."""
    up, down = A.refinement_flag(F.col("mass"), F.col("density") / 10, F.col("width") * 100, {"mass": 0.012, "gradient": 1.5, "jeans": 5.0})
    return _cells(t).select("key", up.alias("refine"), down.alias("derefine"))


@query("am02_refine", f"WITH {_AC} SELECT (key << 3) | o AS key, key AS parent_key, CAST(o AS INT) AS octant, round(cx + ((o & 1) - 0.5) * width / 2, 9) AS cx, round(cz + (((o >> 2) & 1) - 0.5) * width / 2, 9) AS cz, round(mass / 8, 12) AS mass FROM c, range(8) r(o)")
def am02(t):
    """Eight children of every cell."""
    out = A.refine_cells(_cells(t), ("mass", "metal_mass"))
    return rounded(out.select("key", "parent_key", "octant", "cx", "cz", "mass"), cx=9, cz=9, mass=12)


@query("am03_derefine", f"WITH {_AC} SELECT key, round(mass, 10) AS mass, round(metal_mass, 12) AS metal_mass, 0 AS level FROM c")
def am03(t):
    """Children restricted into their parents give the parents back."""
    back = A.derefine_cells(A.refine_cells(_cells(t), ("mass", "metal_mass")), ("mass", "metal_mass"))
    return rounded(back.select("key", "mass", "metal_mass", "level"), mass=10, metal_mass=12)


@query("am04_regrid", f"""WITH {_AC}, d AS (SELECT patch_id, bool_or(mass > 0.0125) AS r FROM c GROUP BY 1), j AS (SELECT c.*, r FROM c JOIN d ON c.patch_id IS NOT DISTINCT FROM d.patch_id)
SELECT level, count(*) AS n, round(sum(mass), 8) AS mass FROM (SELECT level, mass FROM j WHERE NOT r OR patch_id IS NULL UNION ALL SELECT level + 1, mass / 8 FROM j, range(8) WHERE r AND patch_id IS NOT NULL) GROUP BY 1""")
def am04(t):
    """Patches regridded by their decision; mass stays."""
    cells = _cells(t)
    new = A.regrid(cells, A.patch_decision(cells, F.col("mass") > 0.0125, F.lit(False)), ("mass", "metal_mass"))
    return rounded(new.groupBy("level").agg(F.count("*").alias("n"), F.sum("mass").alias("mass")), mass=8)


_FX = f"fx AS (SELECT owner_gas_cell_id AS key, CASE WHEN boundary_class = 'coarse_fine' THEN 'fine' ELSE 'coarse' END AS side, 0.25 * (1 + ghost_slot % 4) AS area, (ghost_id % 100) / 10.0 AS mass, (ghost_id % 37) / 7.0 AS energy FROM {CG} WHERE owner_gas_cell_id IS NOT NULL)"
_REG = f"{_FX}, su AS (SELECT key, sum(CASE WHEN side = 'coarse' THEN area ELSE 0 END) AS ca, sum(CASE WHEN side = 'fine' THEN area ELSE 0 END) AS fa, sum(CASE WHEN side = 'fine' THEN mass * area ELSE -mass * area END) AS dm, sum(CASE WHEN side = 'fine' THEN energy * area ELSE -energy * area END) AS de FROM fx GROUP BY key)"


def _register(t):
    g = t.current_amr_ghosts.where("owner_gas_cell_id IS NOT NULL")
    f = g.select(F.col("owner_gas_cell_id").alias("key"), F.when(F.col("boundary_class") == "coarse_fine", "fine").otherwise("coarse").alias("side"), (0.25 * (1 + F.col("ghost_slot") % 4)).alias("area"), ((F.col("ghost_id") % 100) / 10.0).alias("mass"), ((F.col("ghost_id") % 37) / 7.0).alias("energy"))
    return A.flux_register(f, ("mass", "energy"))


@query("am05_flux_register", f"WITH {_REG} SELECT key, ca AS coarse_area, fa AS fine_area, round(dm / CASE WHEN ca > 0 THEN ca ELSE fa END, 9) AS d_mass, round(de / CASE WHEN ca > 0 THEN ca ELSE fa END, 9) AS d_energy FROM su")
def am05(t):
    """Coarse against fine fluxes per coarse face."""
    return rounded(_register(t), d_mass=9, d_energy=9)


@query("am06_reflux", f"WITH {_REG}, {_AC} SELECT c.key, round(c.mass - coalesce(dm / CASE WHEN ca > 0 THEN ca ELSE fa END * CASE WHEN ca > 0 THEN ca ELSE fa END * 0.01, 0) / (c.mass / c.density), 7) AS mass FROM c LEFT JOIN su ON su.key = c.key")
def am06(t):
    """Cells corrected by their registers."""
    cells = _cells(t).withColumn("volume", F.col("mass") / F.col("density"))
    return rounded(A.reflux(cells, _register(t), {"mass": "mass"}, 0.01).select("key", "mass"), mass=7)


@query("am07_pending_registers", f"WITH {_FX}, a AS (SELECT key, mass, energy, CASE WHEN side = 'coarse' THEN 1 ELSE 2 END AS covered, 4 AS needed FROM fx) SELECT key, round(sum(mass), 8) AS mass, round(sum(energy), 8) AS energy, CAST(sum(covered) AS BIGINT) AS covered, max(needed) AS needed, sum(covered) >= 4 AS complete FROM a GROUP BY key")
def am07(t):
    """Register integrals merged until a face is covered."""
    g = t.current_amr_ghosts.where("owner_gas_cell_id IS NOT NULL")
    rows = g.select(F.col("owner_gas_cell_id").alias("key"), ((F.col("ghost_id") % 100) / 10.0).alias("mass"), ((F.col("ghost_id") % 37) / 7.0).alias("energy"), F.when(F.col("boundary_class") == "coarse_fine", 2).otherwise(1).alias("covered"), F.lit(4).alias("needed"))
    coarse = g.select("ghost_id").limit(0).select(F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("mass"), F.lit(0.0).alias("energy"), F.lit(0).alias("covered"), F.lit(0).alias("needed"))
    return rounded(A.merge_pending(coarse, rows, ("mass", "energy")), mass=8, energy=8)


_HIST = f"h AS (SELECT patch_id, snap_step, avg(density) AS d, avg(density * vx) AS mx FROM {CC} WHERE isfinite(density) AND isfinite(vx) AND patch_id IS NOT NULL GROUP BY 1, 2)"


@query("am08_temporal_ghosts", f"WITH {_HIST}, b AS (SELECT patch_id, min(snap_step) AS t0, max(snap_step) AS t1, arg_min(d, snap_step) AS d0, arg_max(d, snap_step) AS d1, arg_min(mx, snap_step) AS m0, arg_max(mx, snap_step) AS m1 FROM h GROUP BY 1 HAVING count(*) > 1) SELECT patch_id, round(d0 + (d1 - d0) * 0.25, 8) AS d, round(m0 + (m1 - m0) * 0.25, 6) AS mx FROM b")
def am08(t):
    """Conserved states of the patches a quarter of the way from their first to their last snapshot, after the guards against a stale history."""
    c = t.current_cells.where(finite("density", "vx") & F.col("patch_id").isNotNull())
    state = c.groupBy("patch_id", "snap_step").agg(F.avg("density").alias("d"), F.avg(F.col("density") * F.col("vx")).alias("mx"))
    ends = state.groupBy("patch_id").agg(F.min("snap_step").alias("first"), F.max("snap_step").alias("last")).where("first < last")
    now = A.fingerprint(t.current_cells.where("patch_id IS NOT NULL"), "patch_id", ["gas_cell_id"]).select("patch_id", F.col("digest").alias("fingerprint"), F.col("n").alias("generation"))
    at = lambda c: state.join(ends, "patch_id").where(F.col("snap_step") == F.col(c)).join(now, "patch_id").select(F.col("patch_id").alias("key"), "patch_id", F.col("snap_step").cast("double").alias("t"), "fingerprint", "generation", "d", "mx")
    ghosts = A.temporal_ghosts(at("first"), at("last"), now, F.col("_t0") + 0.25 * (F.col("_t1") - F.col("_t0")), ("d", "mx"))
    return rounded(ghosts.select("patch_id", "d", "mx"), d=8, mx=6)


@query("jn08_ghost_sources", f"""WITH g AS (SELECT * FROM {CG}), c AS (SELECT gas_cell_id, patch_id, CASE WHEN NOT isnan(density) THEN density END AS d FROM {CC}), pa AS (SELECT patch_id, avg(d) AS m FROM c WHERE d IS NOT NULL GROUP BY 1)
SELECT g.ghost_id, CASE WHEN s.d IS NOT NULL THEN 'cell' WHEN pa.m IS NOT NULL THEN 'patch' WHEN o.d IS NOT NULL THEN 'owner' ELSE 'none' END AS how, round(coalesce(s.d, pa.m, o.d), 8) AS filled
FROM g LEFT JOIN c s ON s.gas_cell_id = g.source_gas_cell_id LEFT JOIN pa ON pa.patch_id = g.source_patch_id LEFT JOIN c o ON o.gas_cell_id = g.owner_gas_cell_id""")
def jn08(t):
    """Ghost values by priority of their sources."""
    return rounded(A.ghost_sources(t.current_amr_ghosts, t.current_cells.select("gas_cell_id", "patch_id", "density"), "density").select("ghost_id", "how", "filled"), filled=8)


@query("am14_patch_rows", f"WITH {_AC}, i AS (SELECT *, floor(cx / 12.5) AS a, floor(cy / 12.5) AS b, floor(cz / 12.5) AS d FROM c), l AS (SELECT patch_id, CASE WHEN a BETWEEN 0 AND 7 AND b BETWEEN 0 AND 7 AND d BETWEEN 0 AND 7 THEN (a * 8 + b) * 8 + d END AS local FROM i) SELECT patch_id, count(*) AS n_rows, count(DISTINCT local) AS n_places, count(local) - count(DISTINCT local) AS n_doubles, count(*) FILTER (local IS NULL) AS n_outside, count(DISTINCT local) = 512 AS complete FROM l GROUP BY 1")
def am14(t):
    """Rows within patches and their coverage."""
    return A.coverage(A.local_index(_cells(t), (F.lit(0.0), F.lit(0.0), F.lit(0.0)), F.lit(12.5), 8), 8)


@query("am15_axis_layout", f"SELECT round(cx, 6) AS coordinate, row_number() OVER (ORDER BY round(cx, 6)) - 1 AS index FROM (SELECT DISTINCT round(cx, 6) AS cx FROM {CC} WHERE isfinite(cx))")
def am15(t):
    """Coordinates of an axis in order."""
    return A.axis_layout(t.current_cells, "cx")


_MICRO = lambda c: f"CASE WHEN {c} IS NULL THEN 'null' WHEN isfinite({c}) THEN CAST(CAST(floor({c} * 1e6) AS BIGINT) AS VARCHAR) ELSE 'nan' END"
_HASH = "CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)"


@query("am16_fingerprint", f"SELECT patch_id, bit_xor({_HASH.format(text=chr(39) + chr(39) + ' || gas_cell_id || ' + ' || '.join(chr(39) + '|' + chr(39) + ' || ' + _MICRO(c) for c in ('cx', 'cy', 'cz')))}) AS digest, count(*) AS n FROM {CC} GROUP BY patch_id")
def am16(t):
    """Geometry digest per patch in whole millionths of a length, so that other engines get the same."""
    from nebulith.operators.diagnostics import portable_digest

    return portable_digest(t.current_cells, ["gas_cell_id", "cx", "cy", "cz"], "patch_id")
