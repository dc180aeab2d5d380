"""Queries: spatial joins, groups and spectra."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from nebulith.operators import halos as H
from nebulith.operators import spatial, spectrum
from nebulith.operators.base import finite
from nebulith.operators.state import periodic_wrap
from nebulith.plans.catalog import CC, CP, query, rounded

BOX, LINK, LEAST = 100.0, 0.2, 3

_D2 = "pow(least(abs(n.x - g.x), 100 - abs(n.x - g.x)), 2) + pow(least(abs(n.y - g.y), 100 - abs(n.y - g.y)), 2) + pow(least(abs(n.z - g.z), 100 - abs(n.z - g.z)), 2)"
_PAIRS = f"""p AS (SELECT particle_id, snap_step, x - 100 * floor(x / 100) AS x, y - 100 * floor(y / 100) AS y, z - 100 * floor(z / 100) AS z, vx, vy, vz, mass FROM {CP}
  WHERE species_tag IN (0, 1, 2) AND isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(vx) AND isfinite(vy) AND isfinite(vz) AND isfinite(mass)),
len AS (SELECT snap_step, {LINK} * 100 / pow(count(*), 1.0 / 3) AS b FROM p GROUP BY 1),
g AS (SELECT *, CAST(floor(x / 5) AS INT) % 20 AS i, CAST(floor(y / 5) AS INT) % 20 AS j, CAST(floor(z / 5) AS INT) % 20 AS k FROM p), o AS (SELECT unnest([-1, 0, 1]) AS o),
n AS (SELECT g.*, (i + a.o + 20) % 20 AS ni, (j + b.o + 20) % 20 AS nj, (k + c.o + 20) % 20 AS nk FROM g, o a, o b, o c),
pairs AS (SELECT n.snap_step, n.particle_id AS a, g.particle_id AS b FROM n JOIN g ON n.snap_step = g.snap_step AND n.ni = g.i AND n.nj = g.j AND n.nk = g.k AND n.particle_id < g.particle_id
  JOIN len ON len.snap_step = n.snap_step WHERE {_D2} <= len.b * len.b)"""
_MEMBERS = f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
r AS (SELECT a AS v, a AS w FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.w = e.a), lab AS (SELECT v AS particle_id, min(w) AS label FROM r GROUP BY v),
sz AS (SELECT p.snap_step, label, count(*) AS n FROM lab JOIN p USING (particle_id) GROUP BY ALL HAVING count(*) >= {LEAST}),
num AS (SELECT *, (CAST(snap_step AS BIGINT) << 32) | row_number() OVER (PARTITION BY snap_step ORDER BY label) AS halo_id FROM sz),
mem AS (SELECT p.snap_step, lab.particle_id, num.label, num.halo_id FROM lab JOIN p USING (particle_id) JOIN num ON num.label = lab.label)"""
_MI = "CASE WHEN {d} > 50 THEN {d} - 100 WHEN {d} < -50 THEN {d} + 100 ELSE {d} END"
_CAT = _MEMBERS + f""", c AS (SELECT m.snap_step, m.halo_id, m.label, p.mass, p.vx, p.vy, p.vz, {", ".join(f"a.{c} + ({_MI.format(d=f'(p.{c} - a.{c})')}) AS u{c}" for c in "xyz")}
  FROM mem m JOIN p ON p.particle_id = m.particle_id JOIN p a ON a.particle_id = m.label),
cat AS (SELECT snap_step, halo_id, label AS min_particle_id, count(*) AS particle_count, sum(mass) AS mass, {", ".join(f"sum(mass * u{c}) / sum(mass) AS r{c}" for c in "xyz")}, {", ".join(f"sum(mass * v{c}) / sum(mass) AS v_{c}" for c in "xyz")} FROM c GROUP BY ALL)"""


def _points(t):
    p = H.candidates(t.current_particles)
    return p.withColumns({c: F.col(c) - 100 * F.floor(F.col(c) / 100) for c in "xyz"}).select("particle_id", "snap_step", "x", "y", "z", "vx", "vy", "vz", "mass")


def _members(t):
    from nebulith.runtime import Scratch

    points = Scratch(t.spark, "points").write(_points(t))
    return points, H.membership(points, LINK, BOX, LEAST)


@query("jn03_friend_pairs", f"WITH {_PAIRS} SELECT snap_step, a, b FROM pairs")
def jn03(t):
    """Pairs within the linking length of their snapshot, in the periodic box."""
    return H.friend_links(_points(t), LINK, BOX)


PAIR_BLOCKS = 8  # pieces of the asked particles of a snapshot, each against all of its particles


@query("jn04_all_pairs", f"""WITH s AS (SELECT particle_id, snap_step, x - 100 * floor(x / 100) AS x, y - 100 * floor(y / 100) AS y, z - 100 * floor(z / 100) AS z FROM {CP} WHERE isfinite(x) AND isfinite(y) AND isfinite(z))
SELECT n.snap_step, n.particle_id AS a, g.particle_id AS b, round(sqrt({_D2}), 9) AS distance FROM s n JOIN s g ON n.snap_step = g.snap_step AND n.particle_id <> g.particle_id WHERE n.particle_id % 20 = 0 AND {_D2} <= 1""")
def jn04(t):
    """Theta join by distance without the sweep: every particle whose id is divisible by 20 is tested against all particles of its snapshot, in blocks."""
    p = t.current_particles.where(finite("x", "y", "z"))
    p = p.select("snap_step", F.col("particle_id").alias("id"), *[periodic_wrap(F.col(c), BOX).alias(c) for c in "xyz"])
    a = p.where("id % 20 = 0").select("snap_step", F.pmod(F.xxhash64("id"), F.lit(PAIR_BLOCKS)).alias("block"), F.col("id").alias("a"), *[F.col(c).alias(f"{c}a") for c in "xyz"])
    b = p.select("snap_step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PAIR_BLOCKS - 1).cast("long"))).alias("block"), F.col("id").alias("b"), *[F.col(c).alias(f"{c}b") for c in "xyz"])
    apart = [F.abs(F.col(f"{c}a") - F.col(f"{c}b")) for c in "xyz"]
    d2 = sum((F.pow(F.least(d, BOX - d), 2) for d in apart), F.lit(0.0))
    pairs = a.join(b, ["snap_step", "block"]).where(F.col("a") != F.col("b")).withColumn("d2", d2).where("d2 <= 1")
    return rounded(pairs.select("snap_step", "a", "b", F.sqrt("d2").alias("distance")), distance=9)


_STARS = f"s AS (SELECT snap_step, particle_id AS star, x, y, z FROM {CP} WHERE species_tag = 2 AND isfinite(x) AND isfinite(y) AND isfinite(z)), c AS (SELECT snap_step, gas_cell_id AS cell, cx, cy, cz FROM {CC} WHERE isfinite(cx) AND isfinite(cy) AND isfinite(cz))"
_NEAR = f"{_STARS}, d AS (SELECT s.snap_step, star, cell, pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2) AS d2 FROM s JOIN c USING (snap_step)), k AS (SELECT *, row_number() OVER (PARTITION BY snap_step, star ORDER BY d2, cell) AS rank FROM d QUALIFY rank <= 4)"


def _nearest(t):
    stars = t.current_particles.where("species_tag = 2").select("snap_step", F.col("particle_id").alias("star"), "x", "y", "z")
    cells = t.current_cells.select("snap_step", F.col("gas_cell_id").alias("cell"), "cx", "cy", "cz")
    return spatial.nearest_cells(stars, cells, 4, BOX, "snap_step")


@query("jn05_nearest_cells", f"WITH {_NEAR} SELECT snap_step, star, cell, round(d2, 8) AS d2, rank FROM k")
def jn05(t):
    """The four nearest gas cells of every star; not periodic, ties by cell id."""
    return rounded(_nearest(t), d2=8)


@query("jn05_feedback_weights", f"WITH {_NEAR}, w AS (SELECT *, 1 / sqrt(greatest(d2, 1e-12)) AS w FROM k) SELECT snap_step, star, cell, round(w / sum(w) OVER (PARTITION BY snap_step, star), 9) AS weight FROM w")
def jn05w(t):
    """Normalised inverse-distance weights of the four nearest cells."""
    return rounded(spatial.feedback_weights(_nearest(t), ["snap_step", "star"]).select("snap_step", "star", "cell", "weight"), weight=9)


_PATCH = f"pt AS (SELECT patch_id AS patch, patch_id % 3 AS level, avg(cx) - 12.0 / (1 + patch_id % 3) AS ox, avg(cy) - 12.0 / (1 + patch_id % 3) AS oy, avg(cz) - 12.0 / (1 + patch_id % 3) AS oz, 24.0 / (1 + patch_id % 3) AS e FROM {CC} WHERE patch_id IS NOT NULL AND isfinite(cx) AND isfinite(cy) AND isfinite(cz) GROUP BY patch_id)"


@query("jn06_point_in_patch", f"""WITH {_PATCH}, p AS (SELECT particle_id AS point, x - 100 * floor(x / 100) AS x, y - 100 * floor(y / 100) AS y, z - 100 * floor(z / 100) AS z FROM {CP} WHERE isfinite(x) AND isfinite(y) AND isfinite(z))
SELECT point, CAST(arg_min(patch, (-level, patch)) AS BIGINT) AS patch, CAST(max(level) AS INT) AS level FROM p JOIN pt ON x >= ox AND x < ox + e AND y >= oy AND y < oy + e AND z >= oz AND z < oz + e GROUP BY point""")
def jn06(t):
    """The finest of overlapping patches that contains each particle; a patch lies around its cells' mean place, smaller the higher its level."""
    level = (F.col("patch_id") % 3).cast("int")
    half = 12.0 / (1 + level)
    c = t.current_cells.where(finite("cx", "cy", "cz") & F.col("patch_id").isNotNull()).groupBy("patch_id").agg(*[F.avg(f"c{c}").alias(f"m{c}") for c in "xyz"])
    patches = c.select(F.col("patch_id").alias("patch"), level.alias("level"), *[(F.col(f"m{c}") - half).alias(f"o{c}") for c in "xyz"], *[(2 * half).alias(f"e{c}") for c in "xyz"])
    p = t.current_particles.where(finite("x", "y", "z"))
    points = p.select(F.col("particle_id").alias("point"), *[(F.col(c) - 100 * F.floor(F.col(c) / 100)).alias(c) for c in "xyz"])
    return spatial.points_in_patches(points, patches, BOX, 10.0)


@query("jn07_face_neighbors", """WITH c AS (SELECT DISTINCT cell_key AS k FROM cell_members WHERE cell_key IS NOT NULL), i AS (SELECT k // 1024 AS ix, (k // 32) % 32 AS iy, k % 32 AS iz FROM c), a AS (SELECT unnest([0, 1, 2]) AS axis),
n AS (SELECT *, ix + CASE WHEN axis = 0 THEN 1 ELSE 0 END AS jx, iy + CASE WHEN axis = 1 THEN 1 ELSE 0 END AS jy, iz + CASE WHEN axis = 2 THEN 1 ELSE 0 END AS jz FROM i, a)
SELECT (ix * 32 + iy) * 32 + iz AS owner, ((jx % 32) * 32 + jy % 32) * 32 + jz % 32 AS neighbor, axis, CASE WHEN jx >= 32 OR jy >= 32 OR jz >= 32 THEN 'periodic' ELSE 'interior' END AS boundary FROM n""")
def jn07(t):
    """Upper faces of all occupied cells and the cells across them."""
    k = F.col("cell_key")
    cells = t.cell_members.where(k.isNotNull()).select(k).distinct().select(F.floor(k / 1024).alias("ix"), (F.floor(k / 32) % 32).alias("iy"), (k % 32).alias("iz"))
    return spatial.grid_faces(cells, 32)


@query("ag13_components", f"WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r AS (SELECT a AS v, a AS w FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.w = e.a) SELECT v AS vertex, min(w) AS label FROM r GROUP BY v")
def ag13(t):
    """Components of the friend links."""
    from nebulith.operators.groups import components

    return components(H.friend_links(_points(t), LINK, BOX).select("a", "b"))


_R = ", ".join(f"round(CASE WHEN r{c} - 100 * floor(r{c} / 100) >= 100 THEN 0 ELSE r{c} - 100 * floor(r{c} / 100) END, 7) AS com_{c}" for c in "xyz") + ", " + ", ".join(f"round(v_{c}, 7) AS v_{c}" for c in "xyz")


@query("ag14_halo_catalogue", _CAT + f" SELECT snap_step, halo_id, min_particle_id, particle_count, round(mass, 8) AS mass, {_R} FROM cat")
def ag14(t):
    """Friends-of-friends catalogue of all snapshots."""
    points, members = _members(t)
    return rounded(H.catalogue(points, members, BOX), mass=8, com_x=7, com_y=7, com_z=7, v_x=7, v_y=7, v_z=7)


@query("ag15_subhalos", "SELECT snap_step, particle_id AS halo_id FROM particles WHERE false")
def ag15(t):
    """Subhalo candidates: none, by policy."""
    return H.subhalo_candidates(t.particles.select("snap_step", F.col("particle_id").alias("halo_id")))


@query("wn03_halo_ordinals", _MEMBERS + " SELECT snap_step, halo_id, label, halo_id & 4294967295 AS ordinal FROM num")
def wn03(t):
    """Halo numbers by least particle id."""
    _, members = _members(t)
    return members.select("snap_step", "halo_id", "label", F.col("ordinal").cast("long").alias("ordinal")).distinct()


@query("jn10_merger_nodes", _CAT + """, st AS (SELECT snap_step, max(b) AS before FROM (SELECT DISTINCT snap_step FROM cat), LATERAL (SELECT snap_step AS b FROM cat) x WHERE b < snap_step GROUP BY 1)
SELECT c.halo_id AS tree_node_id, c.halo_id, c.snap_step, o.halo_id AS descendant_tree_node_id, o.halo_id IS NOT NULL AS has_descendant
FROM cat c LEFT JOIN st USING (snap_step) LEFT JOIN cat o ON o.halo_id = ((CAST(st.before AS BIGINT) << 32) | (c.halo_id & 4294967295))""")
def jn10(t):
    """Nodes of the merger scaffold."""
    points, members = _members(t)
    return H.merger_nodes(H.catalogue(points, members, BOX).select("snap_step", "halo_id"))


@query("jn11_membership", _MEMBERS + " SELECT p.snap_step, p.particle_id, mem.halo_id FROM p LEFT JOIN mem USING (particle_id)")
def jn11(t):
    """Every candidate with its halo, null where it is in none."""
    points, members = _members(t)
    return H.broadcast_labels(points, members)


_N, _BINS = 8, 6
_BASE = 2 * math.pi / BOX
_WIDTH = math.sqrt(3.0) * (_N // 2) * _BASE / _BINS


def _spectrum_sql(scheme: str, exponent: int, subtract: bool, keep_empty: bool) -> str:
    w = f"w AS (SELECT x / 100 - floor(x / 100) AS x, y / 100 - floor(y / 100) AS y, z / 100 - floor(z / 100) AS z, mass FROM {CP} WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(mass))"
    cell = lambda c, o: f"(CAST(floor({c} * {_N}) AS INT) + {o}) % {_N}"
    if scheme == "cic":
        wt = lambda c, o: f"abs(1 - {o} - ({c} * {_N} - floor({c} * {_N})))"
        grid = f"o AS (SELECT unnest([0, 1]) AS o), m AS (SELECT {cell('x', 'a.o')} AS ix, {cell('y', 'b.o')} AS iy, {cell('z', 'c.o')} AS iz, sum(mass * {wt('x', 'a.o')} * {wt('y', 'b.o')} * {wt('z', 'c.o')}) AS mass FROM w, o a, o b, o c GROUP BY ALL)"
    else:
        grid = f"m AS (SELECT {cell('x', 0)} AS ix, {cell('y', 0)} AS iy, {cell('z', 0)} AS iz, sum(mass) AS mass FROM w GROUP BY ALL)"
    sc = lambda v: f"CASE WHEN {v} = 0 THEN 1 ELSE sin(pi() * {v} / {_N}) / (pi() * {v} / {_N}) END"
    power = f"{BOX**3} * (re * re + im * im)"
    if exponent:
        power += f" / greatest(pow(({sc('kx')}) * ({sc('ky')}) * ({sc('kz')}), {2 * exponent}), 1e-24)"
    if subtract:
        power += f" - (SELECT {BOX**3} * sum(mass * mass) / (sum(mass) * sum(mass)) FROM w)"
    tail = "" if keep_empty else " WHERE mode_count > 0"
    return f"""WITH {w}, {grid}, t AS (SELECT sum(mass) AS total FROM m),
n AS (SELECT CAST(a AS INT) AS nx, CAST(b AS INT) AS ny, CAST(c AS INT) AS nz FROM range({_N}) r(a), range({_N}) s(b), range({_N}) u(c) WHERE a + b + c > 0),
d AS (SELECT nx, ny, nz, sum(mass / total * cos(2 * pi() / {_N} * (ix * nx + iy * ny + iz * nz))) AS re, sum(-mass / total * sin(2 * pi() / {_N} * (ix * nx + iy * ny + iz * nz))) AS im FROM n, m, t GROUP BY ALL),
k AS (SELECT re, im, CASE WHEN nx <= {_N // 2} THEN nx ELSE nx - {_N} END AS kx, CASE WHEN ny <= {_N // 2} THEN ny ELSE ny - {_N} END AS ky, CASE WHEN nz <= {_N // 2} THEN nz ELSE nz - {_N} END AS kz FROM d),
s AS (SELECT sqrt(CAST(kx * kx + ky * ky + kz * kz AS DOUBLE)) * {_BASE!r} AS k, {power} AS power FROM k),
h AS (SELECT CAST(least(floor(k / {_WIDTH!r}), {_BINS - 1}) AS INT) AS bin, avg(k) AS k_mean, avg(power) AS power, count(*) AS mode_count FROM s GROUP BY 1),
f AS (SELECT CAST(b AS INT) AS bin, round(coalesce(k_mean, (b + 0.5) * {_WIDTH!r}), 9) AS k_center, round(coalesce(power, 0), 3) AS power, coalesce(mode_count, 0) AS mode_count FROM range({_BINS}) r(b) LEFT JOIN h ON h.bin = b)
SELECT * FROM f{tail}"""


@query("ag10_power_spectrum", _spectrum_sql("cic", 2, True, True))
def ag10(t):
    """Deconvolved cloud-in-cell spectrum with the shot noise taken off."""
    return rounded(spectrum.power_spectrum(t.current_particles, _N, _BINS, BOX, "cic", True, True), k_center=9, power=3)


@query("ag11_legacy_spectrum", _spectrum_sql("ngp", 0, False, False))
def ag11(t):
    """Nearest-cell spectrum without empty shells."""
    return rounded(spectrum.legacy_spectrum(t.current_particles, _N, _BINS, BOX), k_center=9, power=3)


@query("ag12_direct_spectrum", _spectrum_sql("cic", 2, False, True))
def ag12(t):
    """The spectrum from direct sums in three distributed steps."""
    return rounded(spectrum.power_spectrum(t.current_particles, _N, _BINS, BOX, "cic", True, False, direct=True), k_center=9, power=3)


@query("ag10_fine_spectrum")
def ag10f(t):
    """A 64³ mesh with 24 shells; too many modes for SQL, checked against the direct sums on a small mesh in the tests."""
    return spectrum.power_spectrum(t.current_particles, 64, 24, BOX, "cic", True, True)
