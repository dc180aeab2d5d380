"""Queries: meshes of several refinement levels made from the gas cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from nebulith.operators import amr_mesh as M
from nebulith.operators import subgrid
from nebulith.plans.catalog import CC, query, rounded

N0, BOX, GAMMA, DT, SPLIT = 8, 100.0, 1.4, 0.002, 1.5
DX = BOX / N0


def _leaves(t):
    return M.two_level_cells(t.current_cells, N0, BOX, SPLIT)


def _at(c: str, n: int) -> str:
    return f"CAST(floor(({c} / 100 - floor({c} / 100)) * {n}) AS INT) % {n}"


_LEAVES = f"""g AS (SELECT {_at('cx', 16)} AS ix, {_at('cy', 16)} AS iy, {_at('cz', 16)} AS iz, sum(mass) AS m, sum(mass * vx) AS px, sum(mass * vy) AS py, sum(mass * vz) AS pz, sum(metal_mass) AS mt
  FROM {CC} WHERE isfinite(cx) AND isfinite(cy) AND isfinite(cz) AND isfinite(mass) AND isfinite(vx) AND isfinite(vy) AND isfinite(vz) AND isfinite(metal_mass) GROUP BY 1, 2, 3),
top AS (SELECT CAST(a AS INT) AS ix, CAST(b AS INT) AS iy, CAST(c AS INT) AS iz FROM range(8) r(a), range(8) s(b), range(8) u(c)),
k AS (SELECT top.ix, top.iy, top.iz, coalesce(sum(m), 0) AS m, coalesce(sum(px), 0) AS px, coalesce(sum(py), 0) AS py, coalesce(sum(pz), 0) AS pz, coalesce(sum(mt), 0) AS mt FROM top LEFT JOIN g ON g.ix // 2 = top.ix AND g.iy // 2 = top.iy AND g.iz // 2 = top.iz GROUP BY ALL),
split AS (SELECT ix, iy, iz FROM k WHERE m > {SPLIT} * (SELECT sum(m) / 512 FROM k)),
raw AS (SELECT 0 AS level, k.* FROM k ANTI JOIN split USING (ix, iy, iz) UNION ALL
  SELECT 1, c.ix, c.iy, c.iz, coalesce(m, 0), coalesce(px, 0), coalesce(py, 0), coalesce(pz, 0), coalesce(mt, 0) FROM (SELECT CAST(ix * 2 + (o & 1) AS INT) AS ix, CAST(iy * 2 + ((o >> 1) & 1) AS INT) AS iy, CAST(iz * 2 + ((o >> 2) & 1) AS INT) AS iz FROM split, range(8) r(o)) c LEFT JOIN g USING (ix, iy, iz)),
w AS (SELECT *, 0.01 + m * CASE level WHEN 1 THEN 8 ELSE 1 END AS rho, m + 0.01 / CASE level WHEN 1 THEN 8 ELSE 1 END AS mm FROM raw),
leaf AS (SELECT (CAST(level AS BIGINT) << 57) | (CAST(ix AS BIGINT) << 38) | (CAST(iy AS BIGINT) << 19) | iz AS key, level, ix, iy, iz, rho, px / mm / 100 AS u, py / mm / 100 AS v, pz / mm / 100 AS w, 1 + 2 * rho AS p, least(mt / mm, 1) AS z FROM w)"""
_FACES = _LEAVES + f""", side AS (SELECT leaf.key, level, axis, sign, (ix + CASE axis WHEN 0 THEN sign ELSE 0 END + (8 << level)) % (8 << level) AS tx, (iy + CASE axis WHEN 1 THEN sign ELSE 0 END + (8 << level)) % (8 << level) AS ty,
  (iz + CASE axis WHEN 2 THEN sign ELSE 0 END + (8 << level)) % (8 << level) AS tz FROM leaf, (SELECT unnest([0, 1, 2]) AS axis), (SELECT unnest([1, -1]) AS sign)),
face AS (SELECT s.key AS own, n.key AS nb, axis, sign, CASE WHEN n.level = s.level THEN 'same' ELSE 'fine' END AS kind, s.level, pow({DX} / (1 << s.level), 2) AS area, {DX} / (1 << s.level) * CASE WHEN n.level = s.level THEN 1 ELSE 1.5 END AS distance
  FROM side s JOIN leaf n ON n.level = s.level AND sign = 1 AND n.ix = tx AND n.iy = ty AND n.iz = tz OR n.level = s.level - 1 AND n.ix = tx // 2 AND n.iy = ty // 2 AND n.iz = tz // 2)"""


@query("am10_leaf_faces", f"WITH {_FACES} SELECT own, nb, axis, sign, kind, level, area, distance FROM face")
def am10(t):
    """Faces of a two-level mesh of the gas cells, within levels and between them."""
    return M.leaf_faces(_leaves(t), N0, BOX)


_E = "({q}.p / 0.4 + 0.5 * {q}.rho * ({q}.u * {q}.u + {q}.v * {q}.v + {q}.w * {q}.w))"
_STEP = f"WITH {_FACES}" + f""", lr AS (SELECT own, nb, axis, sign, f.level, CASE WHEN sign = 1 THEN a ELSE b END AS l, CASE WHEN sign = 1 THEN b ELSE a END AS r FROM face f JOIN leaf a ON a.key = own JOIN leaf b ON b.key = nb),
un AS (SELECT *, CASE axis WHEN 0 THEN l.u WHEN 1 THEN l.v ELSE l.w END AS ul, CASE axis WHEN 0 THEN r.u WHEN 1 THEN r.v ELSE r.w END AS ur, {_E.format(q='l')} AS el, {_E.format(q='r')} AS er FROM lr),
wave AS (SELECT *, least(ul - sqrt(1.4 * l.p / l.rho), ur - sqrt(1.4 * r.p / r.rho)) AS sl, greatest(ul + sqrt(1.4 * l.p / l.rho), ur + sqrt(1.4 * r.p / r.rho)) AS sr FROM un),
flux AS (SELECT own, nb, sign, level, CASE WHEN sl >= 0 THEN l.rho * ul WHEN sr <= 0 THEN r.rho * ur ELSE (sr * l.rho * ul - sl * r.rho * ur + sl * sr * (r.rho - l.rho)) / (sr - sl) END AS d,
  CASE WHEN sl >= 0 THEN (el + l.p) * ul WHEN sr <= 0 THEN (er + r.p) * ur ELSE (sr * (el + l.p) * ul - sl * (er + r.p) * ur + sl * sr * (er - el)) / (sr - sl) END AS e FROM wave),
part AS (SELECT own AS key, -sign * d * pow({DX} / (1 << level), 2) AS d, -sign * e * pow({DX} / (1 << level), 2) AS e FROM flux UNION ALL SELECT nb, sign * d * pow({DX} / (1 << level), 2), sign * e * pow({DX} / (1 << level), 2) FROM flux),
net AS (SELECT key, sum(d) AS d, sum(e) AS e FROM part GROUP BY key)
SELECT level, ix, iy, iz, round(rho + {DT} * d / pow({DX} / (1 << level), 3), 8) AS rho, round({_E.format(q='leaf')} + {DT} * e / pow({DX} / (1 << level), 3), 7) AS energy FROM leaf JOIN net USING (key)"""


def _energy(cells):
    e = F.col("p") / (GAMMA - 1) + 0.5 * F.col("rho") * (F.col("u") ** 2 + F.col("v") ** 2 + F.col("w") ** 2)
    return rounded(cells.select("level", *M.INDEX, "rho", e.alias("energy")), rho=8, energy=7)


@query("am11_synchronous_step", _STEP)
def am11(t):
    """One step of all levels with registers and reflux. (The SQL has no registers: it lets the fine fluxes through the coarse faces at once.)"""
    return _energy(M.advance_synchronous(_leaves(t), N0, BOX, DT, GAMMA))


@query("am12_subcycled_step")
def am12(t):
    """A coarse step and two fine ones with ghosts between the coarse states; conservation and order in time are tested."""
    return _energy(M.advance_subcycled(_leaves(t), N0, BOX, DT, GAMMA))


@query("ph13_leaf_diffusion", f"WITH {_FACES}, q AS (SELECT own, nb, 0.01 * area / distance * (a.z - b.z) AS rate FROM face JOIN leaf a ON a.key = own JOIN leaf b ON b.key = nb), d AS (SELECT own AS cell, -rate AS r FROM q UNION ALL SELECT nb, rate FROM q) SELECT cell, round(sum(r), 9) AS rate FROM d GROUP BY cell")
def ph13(t):
    """Gain of metals per leaf over the faces of all levels."""
    leaves = _leaves(t)
    volume = F.when(F.col("level") == 1, DX**3 / 8).otherwise(DX**3)
    cells = M.keyed(leaves).select(F.col("key").alias("cell"), (F.col("rho") * volume).alias("gas"), (F.col("rho") * F.col("z") * volume).alias("metals"))
    return rounded(subgrid.diffusion_rate(cells, M.diffusion_faces(M.leaf_faces(leaves, N0, BOX), 0.01)), rate=9)
