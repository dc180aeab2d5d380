"""Gas dynamics on meshes of leaf cells of several refinement levels: faces between levels, synchronous and subcycled steps.

A leaf is (level, ix, iy, iz) on a grid of n0 · 2^level cells per axis; neighbouring leaves differ by one level at most. Everything is
an equi join on packed cell keys and a sum per cell, so a mesh of any size is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulith.functions import hydro as H
from nebulith.operators import amr
from nebulith.operators.base import dense_bins, finite
from nebulith.operators.hydro_step import comoving_sources
from nebulith.runtime import Scratch

INDEX = ("ix", "iy", "iz")
BITS = 19  # of an index in a packed key: at most 2^19 cells per axis on the finest level
RATIO = 2  # cells of a level per cell of the one above, per axis; also the fine substeps of a coarse step


def cell_key(level: Column, ix: Column, iy: Column, iz: Column) -> Column:
    """Level and index in one long."""
    parts = [F.shiftleft(c.cast("long"), BITS * (3 - i)) for i, c in enumerate((level, ix, iy, iz))]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3])


def _finer(n: int, level: Column) -> Column:
    """n · 2^level."""
    return F.call_function("shiftleft", F.lit(n), level)


def keyed(cells: DataFrame) -> DataFrame:
    return cells.withColumn("key", cell_key(*[F.col(c) for c in ("level", *INDEX)]))


def leaf_faces(cells: DataFrame, n0: int, box: float, periodic: bool = True) -> DataFrame:
    """(own, nb, axis, sign, kind, level, area, distance): every face between two leaves once.

    ``same``: both of one level, ``own`` the lower one, sign 1. ``fine``: ``own`` is finer than ``nb``, which lies on its side ``sign``; a coarse
    face so has four rows. ``distance`` is between the centres along the axis. Faces of the box join its opposite sides, or are left
    out. Three equi joins on keys; a leaf has at most 24 faces, so no key is heavy.
    """
    leaves = keyed(cells.select("level", *INDEX))
    sides = leaves.withColumns({"axis": F.explode(F.sequence(F.lit(0), F.lit(2)))}).withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    n = _finer(n0, F.col("level"))
    moved = {f"t{c}": F.col(c) + F.when(F.col("axis") == a, F.col("sign")).otherwise(0) for a, c in enumerate(INDEX)}
    sides = sides.withColumns(moved)
    if not periodic:
        for c in INDEX:
            sides = sides.where((F.col(f"t{c}") >= 0) & (F.col(f"t{c}") < n))
    sides = sides.withColumns({f"t{c}": F.pmod(F.col(f"t{c}"), n) for c in INDEX})
    there = leaves.select(F.col("key").alias("nb"))
    same = sides.where("sign = 1").withColumn("nb", cell_key(F.col("level"), *[F.col(f"t{c}") for c in INDEX])).join(there, "nb").withColumn("kind", F.lit("same"))
    up = sides.where("level > 0").withColumn("nb", cell_key(F.col("level") - 1, *[F.shiftright(F.col(f"t{c}"), 1) for c in INDEX])).join(there, "nb").withColumn("kind", F.lit("fine"))
    width = F.lit(box / n0) / _finer(1, F.col("level"))
    return same.unionByName(up).select(
        F.col("key").alias("own"), "nb", "axis", "sign", "kind", "level", (width * width).alias("area"), F.when(F.col("kind") == "same", width).otherwise(1.5 * width).alias("distance"),
    )


def diffusion_faces(faces: DataFrame, kappa: Column | float) -> DataFrame:
    """(left, right, conductance) of the metal diffusion between leaves: kappa · area / distance."""
    k = kappa if isinstance(kappa, Column) else F.lit(kappa)
    return faces.select(F.col("own").alias("left"), F.col("nb").alias("right"), (k * F.col("area") / F.col("distance")).alias("conductance"))


def _turn(q: Column) -> Column:
    """The state with the velocity along ``axis`` first."""
    a = F.col("axis")
    return H.state(H.PRIMITIVE, q["rho"], F.when(a == 0, q["u"]).when(a == 1, q["v"]).otherwise(q["w"]), F.when(a == 0, q["v"]).otherwise(q["u"]), F.when(a == 2, q["v"]).otherwise(q["w"]), q["p"], q["z"])


def _turn_back(f: Column) -> Column:
    a = F.col("axis")
    return H.state(H.CONSERVED, f["d"], F.when(a == 0, f["mx"]).otherwise(f["my"]), F.when(a == 0, f["my"]).when(a == 1, f["mx"]).otherwise(f["mz"]), F.when(a == 2, f["mx"]).otherwise(f["mz"]), f["e"], f["zd"])


def _solved(sides: DataFrame, gamma: float, solver: str) -> DataFrame:
    """Adds ``flux`` between the primitive states ``l`` and ``r``."""
    turned = sides.withColumns({"l": _turn(F.col("l")), "r": _turn(F.col("r"))})
    out = (H.hlle if solver == "hlle" else H.hllc)(turned, "l", "r", gamma, "f")
    return out.withColumn("flux", _turn_back(F.col("f"))).drop("l", "r", "f", "f_fallback")


class Mesh:
    """Faces of a mesh, written once, and the parts of a step on it."""

    def __init__(self, cells: DataFrame, n0: int, box: float, gamma: float, solver: str = "hlle"):
        self.n0, self.box, self.gamma, self.solver = n0, box, gamma, solver
        self.scratch = Scratch(cells.sparkSession, "amr")
        faces = self.scratch.write(leaf_faces(cells, n0, box))
        self.same, self.between = faces.where("kind = 'same'"), faces.where("kind = 'fine'")

    def width(self, level: Column) -> Column:
        return F.lit(self.box / self.n0) / _finer(1, level)

    def same_fluxes(self, state: DataFrame) -> DataFrame:
        side = lambda k, q: state.select(F.col("key").alias(k), F.col("q").alias(q))
        return _solved(self.same.select("own", "nb", "axis", "level").join(side("own", "l"), "own").join(side("nb", "r"), "nb"), self.gamma, self.solver)

    def _ends(self, fine: DataFrame, coarse: DataFrame) -> DataFrame:
        side = lambda s, k, q: s.select(F.col("key").alias(k), F.col("q").alias(q))
        return self.between.select("own", "nb", "axis", "sign", "level").join(side(fine, "own", "fine"), "own").join(side(coarse, "nb", "coarse"), "nb")

    def fine_fluxes(self, fine: DataFrame, coarse: DataFrame) -> DataFrame:
        """Fluxes through the fine faces of the boundary between levels, the coarse cell's state standing in for its missing children."""
        ends = self._ends(fine, coarse)
        up = F.col("sign") > 0
        return _solved(ends.select("own", "nb", "axis", "sign", "level", F.when(up, F.col("fine")).otherwise(F.col("coarse")).alias("l"), F.when(up, F.col("coarse")).otherwise(F.col("fine")).alias("r")), self.gamma, self.solver)

    def coarse_fluxes(self, fine: DataFrame, coarse: DataFrame) -> DataFrame:
        """Fluxes that the coarse cells see there: the mean conserved state of the four fine neighbours is their ghost."""
        ends = self._ends(fine, coarse).withColumn("c", H.conserved(F.col("fine"), self.gamma))
        ghosts = ends.groupBy("nb", "axis", "sign", "level").agg(F.first("coarse").alias("coarse"), *[F.avg(f"c.{c}").alias(c) for c in H.CONSERVED])
        ghosts = ghosts.withColumn("ghost", H.primitive(H.state(H.CONSERVED, *[F.col(c) for c in H.CONSERVED]), self.gamma))
        up = F.col("sign") > 0
        return _solved(ghosts.select("nb", "axis", "sign", (F.col("level") - 1).alias("level"), F.when(up, F.col("ghost")).otherwise(F.col("coarse")).alias("l"), F.when(up, F.col("coarse")).otherwise(F.col("ghost")).alias("r")), self.gamma, self.solver)

    def changes(self, dt: float, same: DataFrame, fine: DataFrame | None = None, coarse: DataFrame | None = None) -> DataFrame:
        """(key, conserved changes) of the cells that the fluxes leave and enter within ``dt``."""
        parts = []

        def add(fluxes: DataFrame, key: str, sign: Column) -> None:
            by = sign * dt / self.width(F.col("level"))
            parts.append(fluxes.select(F.col(key).alias("key"), *[(by * F.col(f"flux.{c}")).alias(c) for c in H.CONSERVED]))

        add(same, "own", F.lit(-1.0))
        add(same, "nb", F.lit(1.0))
        if fine is not None:
            add(fine, "own", -F.col("sign").cast("double"))
        if coarse is not None:
            add(coarse, "nb", F.col("sign").cast("double"))
        total = parts[0]
        for p in parts[1:]:
            total = total.unionByName(p)
        return total.groupBy("key").agg(*[F.sum(c).alias(f"_{c}") for c in H.CONSERVED])

    def registers(self, fine: DataFrame, coarse: DataFrame, dt_fine: float, dt_coarse: float) -> DataFrame:
        """Flux registers of the coarse faces, out of the coarse cell positive, integrated in time and divided by the coarse step."""
        def rows(fluxes: DataFrame, side: str, dt: float) -> DataFrame:
            out = -F.col("sign") * dt / dt_coarse
            return fluxes.select(
                F.struct("nb", "axis", "sign").alias("key"), F.lit(side).alias("side"), (self.width(F.col("level")) ** 2).alias("area"), *[(out * F.col(f"flux.{c}")).alias(c) for c in H.CONSERVED]
            )

        both = rows(coarse, "coarse", dt_coarse).unionByName(rows(fine, "fine", dt_fine))
        return amr.flux_register(both, H.CONSERVED).withColumn("key", F.col("key.nb"))

    def conserved(self, state: DataFrame) -> DataFrame:
        return state.withColumn("c", H.conserved(F.col("q"), self.gamma)).select("key", "level", *INDEX, *[F.col(f"c.{c}").alias(c) for c in H.CONSERVED])

    def applied(self, state: DataFrame, changes: DataFrame, dt: float, hubble: float) -> DataFrame:
        """Conserved states after the changes and the sources of the expansion."""
        extra: dict[str, Column] = {}
        if hubble:
            extra = comoving_sources({c: F.col(f"q.{c}") for c in H.PRIMITIVE}, (F.lit(0.0),) * 3, F.lit(hubble), self.gamma)
        base = state.withColumn("c", H.conserved(F.col("q"), self.gamma))
        return base.join(changes, "key", "left").select(
            "key", "level", *INDEX, *[(F.col(f"c.{c}") + F.coalesce(f"_{c}", F.lit(0.0)) + (dt * extra[c] if c in extra else 0.0)).alias(c) for c in H.CONSERVED]
        )

    def refluxed(self, conserved: DataFrame, registers: DataFrame, dt: float) -> DataFrame:
        out = amr.reflux(conserved.withColumn("volume", self.width(F.col("level")) ** 3), registers, {c: c for c in H.CONSERVED}, dt)
        return out.drop("volume")

    def primitive(self, conserved: DataFrame) -> DataFrame:
        return conserved.select("key", "level", *INDEX, H.primitive(H.state(H.CONSERVED, *[F.col(c) for c in H.CONSERVED]), self.gamma).alias("q"))


def _state(cells: DataFrame) -> DataFrame:
    return keyed(cells).select("key", "level", *INDEX, F.struct(*H.PRIMITIVE).alias("q"))


def _cells(state: DataFrame) -> DataFrame:
    return state.select("level", *INDEX, "q.*")


def advance_synchronous(cells: DataFrame, n0: int, box: float, dt: float, gamma: float, solver: str = "hlle", hubble: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(level, ix, iy, iz, primitive state) after one step of ``dt`` on all levels.

    Both sides of a boundary between levels first take the flux they see; the registers then give the coarse cell the fine fluxes, so
    mass, momentum, energy and metals are kept. ``hubble``: expansion rate at begin and end, taken at the middle.
    """
    mesh = Mesh(cells, n0, box, gamma, solver)
    state = mesh.scratch.write(_state(cells))
    same, fine, coarse = mesh.same_fluxes(state), mesh.scratch.write(mesh.fine_fluxes(state, state)), mesh.scratch.write(mesh.coarse_fluxes(state, state))
    moved = mesh.applied(state, mesh.changes(dt, same, fine, coarse), dt, 0.5 * (hubble[0] + hubble[1]))
    return _cells(mesh.primitive(mesh.refluxed(moved, mesh.registers(fine, coarse, dt, dt), dt)))


def advance_subcycled(cells: DataFrame, n0: int, box: float, dt: float, gamma: float, solver: str = "hlle", hubble: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """One coarse step of ``dt`` and RATIO fine ones of a mesh of two successive levels; more levels are an error.

    The coarse cells step first. The fine ones then see them at the time their substep begins, linear between the coarse states of
    both ends; expansion rates are linear too. Fluxes through the fine faces are integrated over the substeps and the coarse cells corrected by the registers at the end.
    """
    levels = sorted(r[0] for r in cells.select("level").distinct().limit(3).collect())  # at most three numbers
    if len(levels) > 2 or len(levels) == 2 and levels[1] != levels[0] + 1:
        raise ValueError(f"subcycling takes two successive levels, not {levels}")
    mesh = Mesh(cells, n0, box, gamma, solver)
    state = mesh.scratch.write(_state(cells))
    low = levels[0] if levels else 0
    start, fine = state.where(F.col("level") == low), state.where(F.col("level") > low)
    rate = lambda part: hubble[0] + part * (hubble[1] - hubble[0])
    of_level = lambda fluxes, l: fluxes.where(F.col("level") == l)
    coarse_flux = mesh.scratch.write(mesh.coarse_fluxes(fine, start))
    end = mesh.scratch.write(mesh.applied(start, mesh.changes(dt, of_level(mesh.same_fluxes(start), low), None, coarse_flux), dt, rate(0.5)))
    before = mesh.conserved(start)
    step, registered = dt / RATIO, None
    for k in range(RATIO):
        part = F.lit(k / RATIO)
        ghosts = before.alias("a").join(end.alias("b"), "key").select("key", H.primitive(H.state(H.CONSERVED, *[
            amr.temporal_ghost(F.col(f"a.{c}"), F.col(f"b.{c}"), F.lit(0.0), F.lit(1.0), part) for c in H.CONSERVED
        ]), gamma).alias("q"))
        flux = mesh.scratch.write(mesh.fine_fluxes(fine, ghosts))
        moved = mesh.applied(fine, mesh.changes(step, of_level(mesh.same_fluxes(fine), low + 1), flux), step, rate((k + 0.5) / RATIO))
        fine = mesh.scratch.write(mesh.primitive(moved))
        registered = flux if registered is None else registered.unionByName(flux)
    # a coarse face gets RATIO x 4 fine rows: the area of each substep counts by its share of the coarse step
    registers = mesh.registers(registered, coarse_flux, step, dt)
    return _cells(mesh.primitive(mesh.refluxed(end, registers, dt)).unionByName(fine))


def two_level_cells(gas: DataFrame, n0: int, box: float, factor: float) -> DataFrame:
    """Leaf cells with a gas state from rows of gas (cx, cy, cz, mass, vx, vy, vz, metal_mass): a coarse cell with more than ``factor`` times the mean
    mass of coarse cells is replaced by its eight children. Rows with a value that is no number are left out; empty cells have the least density."""
    scratch = Scratch(gas.sparkSession, "leaves")
    ok = gas.where(finite("cx", "cy", "cz", "mass", "vx", "vy", "vz", "metal_mass"))
    at = lambda c, n: F.pmod(F.floor((F.col(c) / box - F.floor(F.col(c) / box)) * n), F.lit(n)).cast("int")
    sums = [F.sum("mass").alias("m"), *[F.sum(F.col("mass") * F.col(f"v{c}")).alias(f"p{c}") for c in "xyz"], F.sum("metal_mass").alias("metals")]
    fine = scratch.write(ok.groupBy(*[at(f"c{c}", 2 * n0).alias(f"i{c}") for c in "xyz"]).agg(*sums))
    coarse = fine.groupBy(*[F.shiftright(c, 1).alias(c) for c in INDEX]).agg(*[F.sum(c).alias(c) for c in ("m", "px", "py", "pz", "metals")])
    grid = dense_bins(coarse, {c: n0 for c in INDEX}, {c: 0.0 for c in ("m", "px", "py", "pz", "metals")})
    mean = coarse.agg((F.sum("m") / n0**3).alias("mean"))
    grid = scratch.write(grid.join(F.broadcast(mean), F.lit(True), "left").withColumn("split", F.coalesce(F.col("m") > factor * F.col("mean"), F.lit(False))).drop("mean"))  # mean: one row
    children = grid.where("split").select(*INDEX, F.explode(F.sequence(F.lit(0), F.lit(7))).alias("o")).select(*[(F.col(c) * 2 + F.shiftright("o", i).bitwiseAND(F.lit(1))).cast("int").alias(c) for i, c in enumerate(INDEX)])
    children = children.join(fine, list(INDEX), "left").fillna(0.0).withColumn("level", F.lit(1))
    leaves = grid.where("NOT split").drop("split").withColumn("level", F.lit(0)).unionByName(children)
    rho = 0.01 + F.col("m") * F.when(F.col("level") == 1, 8.0).otherwise(1.0)
    mass = F.col("m") + 0.01 / F.when(F.col("level") == 1, 8.0).otherwise(1.0)
    return leaves.select("level", *INDEX, rho.alias("rho"), *[(F.col(f"p{c}") / mass / 100).alias(v) for c, v in zip("xyz", ("u", "v", "w"))], (1 + 2 * rho).alias("p"), F.least(F.col("metals") / mass, F.lit(1.0)).alias("z"))


def totals(cells: DataFrame, n0: int, box: float, gamma: float) -> DataFrame:
    """Mass, momenta, energy and metals of all leaves."""
    c = H.conserved(F.struct(*H.PRIMITIVE), gamma)
    volume = (F.lit(box / n0) / _finer(1, F.col("level"))) ** 3
    return cells.select(c.alias("c"), volume.alias("v")).agg(*[F.sum(F.col(f"c.{k}") * F.col("v")).alias(k) for k in H.CONSERVED])


def evolve(cells: DataFrame, steps: int, advance: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Several steps; each is written to the shared folder, so the plan doesn't grow."""
    scratch = Scratch(cells.sparkSession, "amr-steps")
    now = scratch.write(cells)
    for _ in range(steps):
        nxt = scratch.write(advance(now))
        scratch.drop(now)
        now = nxt
    return now
