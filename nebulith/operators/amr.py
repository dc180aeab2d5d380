"""Adaptive-mesh operators: refinement, prolongation and restriction, flux registers, ghosts, patch layouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def refinement_flag(mass: Column, gradient: Column, jeans_cells: Column, limits: dict[str, float], hysteresis: float = 0.5) -> tuple[Column, Column]:
    """(refine, derefine): any criterion above its limit refines; all below ``hysteresis`` of theirs derefine."""
    refine = (mass > limits["mass"]) | (gradient > limits["gradient"]) | (jeans_cells < limits["jeans"])
    derefine = (mass < hysteresis * limits["mass"]) & (gradient < hysteresis * limits["gradient"]) & (jeans_cells > limits["jeans"] / hysteresis)
    return F.coalesce(refine, F.lit(False)), F.coalesce(derefine, F.lit(False))


def patch_decision(cells: DataFrame, refine: Column, derefine: Column, patch: str = "patch_id") -> DataFrame:
    """(patch, decision): any cell refines its patch, all cells together derefine it, else it is kept."""
    flags = cells.groupBy(patch).agg(F.bool_or(refine).alias("any_refine"), F.bool_and(derefine).alias("all_derefine"))
    return flags.select(patch, F.when(F.col("any_refine"), "refine").when(F.col("all_derefine"), "derefine").otherwise("keep").alias("decision"))


def refine_cells(cells: DataFrame, extensive: tuple[str, ...], production: bool = False) -> DataFrame:
    """Eight children per cell: half the size, an eighth of the extensive values, octant bit 0 along x.

    A child's key is key << 3 | octant, or key · 8 + octant + 1 in the production form.
    """
    wide = cells.withColumn("octant", F.explode(F.sequence(F.lit(0), F.lit(7))))
    bit = lambda b: F.shiftright("octant", b).bitwiseAND(F.lit(1))
    child = F.col("key") * 8 + F.col("octant") + 1 if production else F.shiftleft("key", 3).bitwiseOR(F.col("octant").cast("long"))
    moved = {c: F.col(c) + (bit(i) - 0.5) * F.col("width") / 2 for i, c in enumerate(("cx", "cy", "cz"))}
    return wide.withColumns(moved | {e: F.col(e) / 8 for e in extensive} | {"parent_key": F.col("key"), "key": child, "width": F.col("width") / 2, "level": F.col("level") + 1})


def refine_production(cells: DataFrame, chosen: Column, free_ids: DataFrame, extensive: tuple[str, ...], ident: str = "gas_cell_id") -> DataFrame:
    """The rows that ``chosen`` keeps out stay, the others are removed and their children take their place.

    A child has the production key parent · 8 + octant + 1 and an id of its own from ``free_ids(id)``, dealt in order of the keys. A
    list with fewer ids than children, or with an id in use, is an error at run time. Rows that stay have no key and no parent.
    """
    from nebulith.operators.skew import stitched

    marked = cells.withColumn("_chosen", F.coalesce(chosen, F.lit(False)))
    stay = marked.where("NOT _chosen").drop("_chosen").withColumns({"key": F.lit(None).cast("long"), "parent_key": F.lit(None).cast("long"), "octant": F.lit(None).cast("int")})
    children = refine_cells(marked.where("_chosen").drop("_chosen").withColumn("key", F.col(ident).cast("long")), extensive, production=True).withColumn("_all", F.lit(0))
    used = cells.select(F.col(ident).alias("id"), F.lit(True).alias("_used"))
    seeds = stitched(free_ids.select("id").distinct().withColumn("_all", F.lit(0)), ["_all"], ["id"]).join(used, "id", "left")
    dealt = stitched(children, ["_all"], ["key"]).join(seeds.select(F.col("id").alias("_id"), "_used", "_rn"), "_rn", "left")
    fresh = F.when(F.col("_id").isNull() | F.col("_used"), F.raise_error(F.lit("free ids are missing or in use")).cast("long")).otherwise(F.col("_id"))
    return stay.unionByName(dealt.withColumn(ident, fresh).drop("_rn", "_id", "_used", "_all"))


def derefine_cells(children: DataFrame, extensive: tuple[str, ...]) -> DataFrame:
    """Children summed into their parents; a parent with fewer than eight is not restored."""
    sums = children.groupBy("parent_key").agg(
        F.count("*").alias("_n"), *[F.sum(e).alias(e) for e in extensive], *[F.avg(c).alias(c) for c in ("cx", "cy", "cz")], (F.max("width") * 2).alias("width"), (F.max("level") - 1).alias("level")
    )
    return sums.where("_n = 8").drop("_n").withColumnRenamed("parent_key", "key")


def flux_register(fluxes: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """(key, coarse_area, fine_area, differences): area-weighted coarse and fine fluxes per coarse face.

    Both sides are divided by the coarse area where it is known, so a partly covered face lowers the fine average.
    """
    coarse, fine = F.col("side") == "coarse", F.col("side") == "fine"
    of = lambda on, c: F.sum(F.when(on, c).otherwise(0.0))
    sums = fluxes.groupBy("key").agg(
        of(coarse, F.col("area")).alias("coarse_area"), of(fine, F.col("area")).alias("fine_area"),
        *[of(s, F.col(v) * F.col("area")).alias(f"_{n}_{v}") for v in values for n, s in (("c", coarse), ("f", fine))],
    )
    by = F.when(F.col("coarse_area") > 0, F.col("coarse_area")).otherwise(F.col("fine_area"))
    return sums.select("key", "coarse_area", "fine_area", *[((F.col(f"_f_{v}") - F.col(f"_c_{v}")) / by).alias(f"d_{v}") for v in values])


def reflux(cells: DataFrame, register: DataFrame, values: dict[str, str], dt: float, strict: bool = False) -> DataFrame:
    """U −= (F_fine − F_coarse) · A · dt / V. The strict form skips incomplete registers and areas that differ by more than 1e-10."""
    r = register
    if strict:
        r = r.where((F.col("coarse_area") > 0) & (F.col("fine_area") > 0) & (F.abs(F.col("fine_area") - F.col("coarse_area")) <= 1e-10 * F.col("coarse_area")))
    scale = F.when(F.col("coarse_area") > 0, F.col("coarse_area")).otherwise(F.col("fine_area")) * dt
    fix = r.groupBy("key").agg(*[F.sum(F.col(f"d_{v}") * scale).alias(f"_fix_{v}") for v in values.values()])
    j = cells.join(fix, "key", "left")
    return j.withColumns({u: F.col(u) - F.coalesce(F.col(f"_fix_{v}"), F.lit(0.0)) / F.col("volume") for u, v in values.items()}).drop(*[f"_fix_{v}" for v in values.values()])


def merge_pending(store: DataFrame, update: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Time-integrated registers: integrals of the same key add up, coverage too; a key of either side is kept."""
    both = store.unionByName(update)
    return both.groupBy("key").agg(*[F.sum(v).alias(v) for v in values], F.sum("covered").alias("covered"), F.max("needed").alias("needed")).withColumn("complete", F.col("covered") >= F.col("needed"))


def temporal_ghost(start: Column, end: Column, t0: Column, t1: Column, t: Column, tolerance: float = 1e-12) -> Column:
    """Linear in time between two states; ends are snapped within the tolerance and a time outside the interval is an error."""
    span = t1 - t0
    part = (t - t0) / span
    inside = F.when(F.abs(part) <= tolerance, start).when(F.abs(part - 1) <= tolerance, end).when((part > 0) & (part < 1), start + (end - start) * part)
    return F.coalesce(inside, F.when(start.isNotNull() & end.isNotNull() & part.isNotNull(), F.raise_error(F.lit("ghost time outside its interval")).cast("double")))


def temporal_ghosts(start: DataFrame, end: DataFrame, patches: DataFrame, time: Column, values: tuple[str, ...], key: str = "key", patch: str = "patch_id") -> DataFrame:
    """(key, patch, values) at ``time`` between the states of two times, each (key, patch, t, fingerprint, generation, values).

    ``patches(patch, fingerprint, generation)`` is the mesh as it is now: a state taken of a patch whose geometry or whose cells' identities
    have changed since is an error at run time, as is a time outside the interval. Cells of only one of both states have no ghost.
    """
    side = lambda df, s: df.select(key, patch, *[F.col(c).alias(f"_{c}{s}") for c in ("t", "fingerprint", "generation", *values)])
    j = side(start, 0).join(side(end, 1).drop(patch), key).join(patches.select(patch, "fingerprint", "generation"), patch, "left")
    stale = ~reduce(Column.__and__, [F.col(f"_{c}{s}").eqNullSafe(F.col(c)) for c in ("fingerprint", "generation") for s in (0, 1)])
    error = lambda text: F.raise_error(F.concat(F.lit(text), F.col(patch))).cast("double")
    new = {v: F.when(stale, error("stale ghost history of patch ")).otherwise(temporal_ghost(F.col(f"_{v}0"), F.col(f"_{v}1"), F.col("_t0"), F.col("_t1"), time)) for v in values}
    return j.select(key, patch, *[c.alias(v) for v, c in new.items()])


def ghost_sources(ghosts: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """Value for each ghost from its source cell, else the mean of its source patch's cells, else from its owner: left joins and a priority.

    ``how`` names which one it was; ``none`` where there is nothing.
    """
    own = lambda as_id, out: cells.select(F.col("gas_cell_id").alias(as_id), F.col(value).alias(out))
    patch = cells.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col("patch_id").alias("source_patch_id")).agg(F.avg(value).alias("_patch"))
    j = ghosts.join(own("source_gas_cell_id", "_cell"), "source_gas_cell_id", "left").join(patch, "source_patch_id", "left").join(own("owner_gas_cell_id", "_owner"), "owner_gas_cell_id", "left")
    good = lambda c: F.when(~F.isnan(c), F.col(c))
    how = F.when(good("_cell").isNotNull(), "cell").when(F.col("_patch").isNotNull(), "patch").when(good("_owner").isNotNull(), "owner").otherwise("none")
    return j.withColumns({"how": how, "filled": F.coalesce(good("_cell"), F.col("_patch"), good("_owner"))}).drop("_cell", "_patch", "_owner")


def local_index(cells: DataFrame, origin: tuple[Column, Column, Column], width: Column, dims: int) -> DataFrame:
    """Row of each cell within its patch by floor; a place outside the patch gives null."""
    i = [F.floor((F.col(c) - o) / width) for c, o in zip(("cx", "cy", "cz"), origin)]
    inside = (i[0] >= 0) & (i[0] < dims) & (i[1] >= 0) & (i[1] < dims) & (i[2] >= 0) & (i[2] < dims)
    return cells.withColumn("local", F.when(inside, (i[0] * dims + i[1]) * dims + i[2]))


def coverage(indexed: DataFrame, dims: int, patch: str = "patch_id") -> DataFrame:
    """Per patch: rows, distinct places, doubles, rows outside, and whether all places are taken."""
    return indexed.groupBy(patch).agg(
        F.count("*").alias("n_rows"), F.countDistinct("local").alias("n_places"), (F.count("local") - F.countDistinct("local")).alias("n_doubles"), F.sum(F.when(F.col("local").isNull(), 1).otherwise(0)).alias("n_outside")
    ).withColumn("complete", F.col("n_places") == dims**3)


def axis_layout(cells: DataFrame, axis: str, digits: int = 6) -> DataFrame:
    """(coordinate, index): distinct coordinates of an axis in order, which is the layout of a Cartesian set of cells."""
    from nebulith.operators.skew import stitched

    places = cells.select(F.round(axis, digits).alias("coordinate")).where("coordinate IS NOT NULL AND NOT isnan(coordinate)").distinct().withColumn("_all", F.lit(0))
    return stitched(places, ["_all"], ["coordinate"]).select("coordinate", (F.col("_rn") - 1).cast("long").alias("index"))


def fingerprint(cells: DataFrame, patch: str, columns: list[str]) -> DataFrame:
    """Geometry digest per patch, independent of the order of rows."""
    return cells.groupBy(patch).agg(F.bit_xor(F.xxhash64(*columns)).alias("digest"), F.count("*").alias("n"))


def regrid(cells: DataFrame, decisions: DataFrame, extensive: tuple[str, ...]) -> DataFrame:
    """Cells of patches to refine are replaced by their children, those of the others stay."""
    j = cells.join(decisions, "patch_id", "left")
    stay = j.where(F.coalesce(F.col("decision"), F.lit("keep")) != "refine").drop("decision").withColumns({"octant": F.lit(None).cast("int"), "parent_key": F.lit(None).cast("long")})
    return stay.unionByName(refine_cells(j.where("decision = 'refine'").drop("decision"), extensive))
