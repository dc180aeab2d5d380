"""Finite-volume gas dynamics on periodic Cartesian grids held as tables of cells (ix, iy, iz, primitive state)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulith.functions import hydro as H
from nebulith.runtime import Scratch

FIELDS = H.PRIMITIVE
INDEX = ("ix", "iy", "iz")
VELOCITY = ("u", "v", "w")


def neighbours(cells: DataFrame, n: int, axis: int, boundary: str = "periodic") -> DataFrame:
    """Every cell beside its lower and upper neighbour along an axis, as structs ``lo``, ``me`` and ``hi``.

    Open ghosts repeat the cell, reflective ones turn the normal velocity round. Two equi joins on the cell index.
    """
    q = F.struct(*FIELDS)
    move = lambda d: [F.pmod(F.col(c) + d, F.lit(n)).cast("int").alias(c) if a == axis else F.col(c) for a, c in enumerate(INDEX)]
    me = cells.select(*INDEX, q.alias("me"))
    lo, hi = cells.select(*move(1), q.alias("lo")), cells.select(*move(-1), q.alias("hi"))
    out = me.join(lo, list(INDEX)).join(hi, list(INDEX))
    if boundary == "periodic":
        return out
    ghost = F.col("me") if boundary == "open" else F.col("me").withField(VELOCITY[axis], -F.col(f"me.{VELOCITY[axis]}"))
    at = F.col(INDEX[axis])
    return out.withColumns({"lo": F.when(at == 0, ghost).otherwise(F.col("lo")), "hi": F.when(at == n - 1, ghost).otherwise(F.col("hi"))})


def reconstruct(cells: DataFrame, n: int, axis: int, limiter: str | None, dt_over_dx: float = 0.0, gamma: float = 1.4, boundary: str = "periodic") -> DataFrame:
    """States at the lower and upper face of every cell: constant, or limited slopes with a half-step predictor and floors."""
    near = neighbours(cells, n, axis, boundary)
    me = F.col("me")
    if limiter is None:
        return near.select(*INDEX, me.alias("at_lo"), me.alias("at_hi"), "me")
    limit = H.LIMITERS[limiter]
    near = near.withColumns({f"_s{f}": limit(me[f] - F.col(f"lo.{f}"), F.col(f"hi.{f}") - me[f]) for f in FIELDS})
    s = {f: F.col(f"_s{f}") for f in FIELDS}
    normal = VELOCITY[axis]
    un, sn = me[normal], s[normal]
    rate = {f: -un * s[f] for f in FIELDS}
    rate["rho"] = rate["rho"] - me["rho"] * sn
    rate["p"] = rate["p"] - gamma * me["p"] * sn
    rate[normal] = rate[normal] - s["p"] / F.greatest(me["rho"], F.lit(H.SMALL))

    def face(sign: float) -> Column:
        v = {f: me[f] + sign * 0.5 * s[f] + 0.5 * dt_over_dx * rate[f] for f in FIELDS}
        v["rho"], v["p"] = F.greatest(v["rho"], F.lit(1e-12)), F.greatest(v["p"], F.lit(1e-12))
        v["z"] = F.least(F.greatest(v["z"], F.lit(0.0)), F.lit(1.0))
        return H.state(FIELDS, *[v[f] for f in FIELDS])

    return near.select(*INDEX, face(-1.0).alias("at_lo"), face(1.0).alias("at_hi"), "me")


def _turn(q: Column, axis: int) -> Column:
    """The state with the axis' velocity first, as the fluxes want it."""
    order = [VELOCITY[axis], *[v for v in VELOCITY if v != VELOCITY[axis]]]
    return H.state(FIELDS, q["rho"], *[q[v] for v in order], q["p"], q["z"])


def _turn_back(f: Column, axis: int) -> Column:
    names = [VELOCITY[axis], *[v for v in VELOCITY if v != VELOCITY[axis]]]
    m = dict(zip(names, ("mx", "my", "mz")))
    return H.state(H.CONSERVED, f["d"], f[m["u"]], f[m["v"]], f[m["w"]], f["e"], f["zd"])


def face_fluxes(cells: DataFrame, n: int, axis: int, gamma: float, solver: str = "hlle", limiter: str | None = None, dt_over_dx: float = 0.0, boundary: str = "periodic") -> DataFrame:
    """(ix, iy, iz, flux) at the upper face of every cell."""
    rec = reconstruct(cells, n, axis, limiter, dt_over_dx, gamma, boundary)
    nxt = rec.select(*[F.pmod(F.col(c) - 1, F.lit(n)).cast("int").alias(c) if a == axis else F.col(c) for a, c in enumerate(INDEX)], F.col("at_lo").alias("right"))
    faces = rec.select(*INDEX, F.col("at_hi").alias("left")).join(nxt, list(INDEX))
    turned = faces.select(*INDEX, _turn(F.col("left"), axis).alias("l"), _turn(F.col("right"), axis).alias("r"))
    solved = (H.hlle if solver == "hlle" else H.hllc)(turned, "l", "r", gamma, "f")
    return solved.select(*INDEX, _turn_back(F.col("f"), axis).alias("flux"))


def advance(cells: DataFrame, n: int, dx: float, dt: float, gamma: float, solver: str = "hlle", limiter: str | None = None, sources: dict[str, Column] | None = None) -> DataFrame:
    """One conservative step over all three axes: −F at a face's owner and +F at the cell across it, summed per cell, then sources and floors."""
    parts = []
    for axis in range(3):
        f = face_fluxes(cells, n, axis, gamma, solver, limiter, dt / dx)
        out = f.select(*INDEX, *[(-F.col(f"flux.{c}")).alias(c) for c in H.CONSERVED])
        into = f.select(*[F.pmod(F.col(c) + 1, F.lit(n)).cast("int").alias(c) if a == axis else F.col(c) for a, c in enumerate(INDEX)], *[F.col(f"flux.{c}").alias(c) for c in H.CONSERVED])
        parts += [out, into]
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    change = total.groupBy(*INDEX).agg(*[F.sum(c).alias(f"_d{c}") for c in H.CONSERVED])
    q = F.struct(*FIELDS)
    base = cells.select(*INDEX, H.conserved(q, gamma).alias("c"))
    extra = sources or {}
    new = base.join(change, list(INDEX)).select(*INDEX, H.state(H.CONSERVED, *[
        (F.greatest if c == "d" else lambda x, _: x)(F.col(f"c.{c}") + dt / dx * F.col(f"_d{c}") + (dt * extra[c] if c in extra else 0.0), F.lit(H.SMALL)) for c in H.CONSERVED
    ]).alias("c"))
    return new.select(*INDEX, H.primitive(F.col("c"), gamma).alias("q")).select(*INDEX, "q.*")


def evolve(cells: DataFrame, n: int, dx: float, dt: float, gamma: float, steps: int, solver: str = "hlle", limiter: str | None = None) -> DataFrame:
    """Several steps; each is written to the shared folder, so the plan doesn't grow."""
    scratch = Scratch(cells.sparkSession, "hydro")
    now = scratch.write(cells)
    for _ in range(steps):
        nxt = scratch.write(advance(now, n, dx, dt, gamma, solver, limiter))
        scratch.drop(now)
        now = nxt
    return now


def comoving_sources(q: dict[str, Column], gravity: tuple[Column, Column, Column], hubble: Column, gamma: float) -> dict[str, Column]:
    """Gravity's work on momentum and energy and the Hubble drag, per unit of time."""
    rho = q["rho"]
    kinetic = 0.5 * rho * (q["u"] ** 2 + q["v"] ** 2 + q["w"] ** 2)
    work = rho * (q["u"] * gravity[0] + q["v"] * gravity[1] + q["w"] * gravity[2])
    drag = {m: rho * g - hubble * rho * q[v] for m, v, g in zip(("mx", "my", "mz"), VELOCITY, gravity)}
    return drag | {"e": work - 2 * hubble * kinetic - 3 * (gamma - 1) * hubble * q["p"] / (gamma - 1)}


def grid_state(particles: DataFrame, n: int, box: float) -> DataFrame:
    """A gas state on an n³ grid from particles: mass per cell, mean velocity, a pressure and a metal fraction that follow from them."""
    from nebulith.operators.base import finite

    ok = particles.where(finite("x", "y", "z", "vx", "vy", "vz", "mass"))
    idx = [F.floor((F.col(c) / box - F.floor(F.col(c) / box)) * n).cast("int").alias(f"i{c}") for c in "xyz"]
    found = ok.groupBy(*idx).agg(F.sum("mass").alias("m"), *[F.sum(F.col("mass") * F.col(f"v{c}")).alias(f"p{c}") for c in "xyz"], F.avg("time_bin").alias("b"))
    from nebulith.operators.base import dense_bins

    full = dense_bins(found, {"ix": n, "iy": n, "iz": n}, {"m": 0.0, "px": 0.0, "py": 0.0, "pz": 0.0, "b": 0.0})
    m = F.col("m") + 0.01
    return full.select("ix", "iy", "iz", m.alias("rho"), *[(F.col(f"p{c}") / m / 100).alias(v) for c, v in zip("xyz", VELOCITY)], (1 + 2 * m).alias("p"), (F.col("b") / 100).alias("z"))
