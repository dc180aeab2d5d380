"""Single-pass aggregates over particles, gas cells and stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulith.operators.base import SPECIES, count_if, dense_bins, finite

POSITION, VELOCITY, CENTER = ("x", "y", "z"), ("vx", "vy", "vz"), ("cx", "cy", "cz")


def run_health(particles: DataFrame, by: str | None = None) -> DataFrame:
    """Counts of rows, non-finite rows, non-positive masses and bad softenings in one pass. A null is not finite."""
    bad_softening = F.isnotnull("softening") & (~finite("softening") | (F.col("softening") < 0))
    aggregates = [
        F.count("*").alias("n_particles"), F.countDistinct("particle_id").alias("n_ids"),
        count_if(~finite(*POSITION, *VELOCITY, "mass")).alias("non_finite"),
        count_if(finite("mass") & (F.col("mass") <= 0)).alias("non_positive_mass"), count_if(bad_softening).alias("bad_softening"),
    ]
    out = (particles.groupBy(by) if by else particles.groupBy()).agg(*aggregates)
    return out.withColumn("unique_ids", F.col("n_particles") == F.col("n_ids"))


def cell_health(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count("*").alias("n_cells"), count_if(~finite(*CENTER, "mass", "density")).alias("non_finite"))


def angular_momentum(particles: DataFrame) -> DataFrame:
    """Total and per-species sums of m (r × v) about the origin, without unwrapping. Tracers count in the total only.

    Rows with a non-finite component are left out, as they would make every total NaN.
    """
    m = F.col("mass")
    parts = {
        "lx": m * (F.col("y") * F.col("vz") - F.col("z") * F.col("vy")),
        "ly": m * (F.col("z") * F.col("vx") - F.col("x") * F.col("vz")),
        "lz": m * (F.col("x") * F.col("vy") - F.col("y") * F.col("vx")),
    }
    sums = particles.where(finite(*POSITION, *VELOCITY, "mass")).withColumns(parts).rollup("species_tag").agg(
        *[F.sum(c).alias(c) for c in parts], F.count("*").alias("n"), F.grouping("species_tag").alias("is_total")
    )
    name = F.when(F.col("is_total") == 1, "total")
    for species, tag in SPECIES.items():
        if species != "tracer":
            name = name.when(F.col("species_tag") == tag, species)
    return sums.withColumn("class", name).where("class IS NOT NULL").select("class", "n", *parts)


def clamped_bin(value: Column, bins: int) -> Column:
    """floor(value · bins) for a value in [0, 1]; the upper edge belongs to the last bin."""
    inside = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    return F.least(F.floor(inside * bins), F.lit(bins - 1)).cast("int")


def star_formation_history(stars: DataFrame, bins: int, scale: str = "formation_a", mass: str = "birth_mass") -> DataFrame:
    """(bin, n_stars, birth_mass) over the scale factor; empty bins stay with 0."""
    found = stars.where(finite(scale, mass)).groupBy(clamped_bin(F.col(scale), bins).alias("bin")).agg(F.count("*").alias("n_stars"), F.sum(mass).alias("birth_mass"))
    return dense_bins(found, {"bin": bins}, {"n_stars": 0, "birth_mass": 0.0})


def _grid_index(c: str, n: int, box: float) -> Column:
    return clamped_bin(F.col(c) / box, n)


def gas_slice(cells: DataFrame, n: int, box: float) -> DataFrame:
    """Mean density per (ix, iy) of cells within half a grid cell of the middle plane, edges included; empty pixels 0."""
    near = cells.where(finite(*CENTER, "density") & (F.abs(F.col("cz") - box / 2) <= box / (2 * n)))
    found = near.groupBy(_grid_index("cx", n, box).alias("ix"), _grid_index("cy", n, box).alias("iy")).agg(F.avg("density").alias("density"))
    return dense_bins(found, {"ix": n, "iy": n}, {"density": 0.0})


def gas_projection(cells: DataFrame, n: int, box: float) -> DataFrame:
    """Plain sum of density per (ix, iy), neither a mean nor mass-weighted; empty pixels 0."""
    found = cells.where(finite(*CENTER, "density")).groupBy(_grid_index("cx", n, box).alias("ix"), _grid_index("cy", n, box).alias("iy")).agg(F.sum("density").alias("density"))
    return dense_bins(found, {"ix": n, "iy": n}, {"density": 0.0})


def gas_metal_budget(cells: DataFrame) -> DataFrame:
    """Metals, least, largest and mean metallicity, metal-free fraction and invalid cells. Without a valid cell all are 0."""
    ok = finite("mass", "metal_mass") & (F.col("mass") >= 0) & (F.col("metal_mass") >= 0) & (F.col("metal_mass") <= F.col("mass"))
    z = F.when(F.col("mass") > 0, F.col("metal_mass") / F.col("mass")).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = cells.withColumns({"ok": ok, "metallicity": z}).agg(
        F.sum(F.when(F.col("ok"), F.col("metal_mass"))).alias("metals"), F.sum(F.when(F.col("ok"), F.col("mass"))).alias("gas"),
        F.min(F.when(F.col("ok"), F.col("metallicity"))).alias("z_min"), F.max(F.when(F.col("ok"), F.col("metallicity"))).alias("z_max"),
        F.sum(F.when(F.col("ok") & (F.col("metal_mass") == 0), F.col("mass"))).alias("free"), count_if(~F.col("ok")).alias("n_invalid"),
    )
    share = lambda c: F.when(F.col("gas") > 0, zero(F.col(c)) / F.col("gas")).otherwise(0.0)
    return sums.select(zero(F.col("metals")).alias("gas_metals"), zero(F.col("z_min")).alias("z_min"), zero(F.col("z_max")).alias("z_max"), share("metals").alias("z_mean"), share("free").alias("metal_free_fraction"), "n_invalid")


def star_metal_budget(stars: DataFrame) -> DataFrame:
    """Birth, locked, new, returned, deposited and carried metals of stars, and what deposition leaves unexplained."""
    birth = F.col("birth_mass") * F.col("metallicity")
    back = F.greatest(F.col("returned_metals") - F.col("new_metals"), F.lit(0.0))
    return stars.agg(
        F.sum(birth).alias("birth_metals"), F.sum(F.greatest(birth - back, F.lit(0.0))).alias("locked_metals"), F.sum("new_metals").alias("new_metals"),
        F.sum("returned_metals").alias("returned_metals"), F.sum("deposited_metals").alias("deposited_metals"), F.sum("carry_metals").alias("carried_metals"),
    ).withColumn("deposition_residual", F.col("returned_metals") - F.col("deposited_metals") - F.col("carried_metals"))


def metal_audit(gas: DataFrame, stars: DataFrame, initial: float, escaped: float) -> DataFrame:
    """accounted − (initial + synthesized − escaped), from the two one-row budgets."""
    both = gas.join(F.broadcast(stars), F.lit(True))  # one row each
    return both.select((F.col("gas_metals") + F.col("locked_metals") + F.col("carried_metals") - (F.lit(initial) + F.col("new_metals") - F.lit(escaped))).alias("residual"))


def mass_on_grid(particles: DataFrame, n: int, box: float, scheme: str = "cic") -> DataFrame:
    """(ix, iy, iz, mass): floor cell (ngp), 2-point (cic) or 3-point (tsc) weights per axis, wrapped periodically. Non-empty cells only."""
    wrapped = particles.where(finite(*POSITION, "mass")).select(*[(F.col(c) / box - F.floor(F.col(c) / box)).alias(c) for c in POSITION], "mass")
    for c in POSITION:
        at = F.col(c) * n
        if scheme == "ngp":
            points = F.array(F.struct(F.floor(at).alias("i"), F.lit(1.0).alias("w")))
        elif scheme == "cic":
            frac = at - F.floor(at)
            points = F.array(F.struct(F.floor(at).alias("i"), (1 - frac).alias("w")), F.struct((F.floor(at) + 1).alias("i"), frac.alias("w")))
        else:
            mid = F.floor(at + 0.5)
            off = at - mid
            points = F.array(
                F.struct((mid - 1).alias("i"), (0.5 * (0.5 - off) * (0.5 - off)).alias("w")), F.struct(mid.alias("i"), (0.75 - off * off).alias("w")),
                F.struct((mid + 1).alias("i"), (0.5 * (0.5 + off) * (0.5 + off)).alias("w")),
            )
        wrapped = wrapped.withColumn(f"s{c}", points)
    spread = wrapped.select("mass", F.explode("sx").alias("px"), "sy", "sz").select("mass", "px", F.explode("sy").alias("py"), "sz").select("mass", "px", "py", F.explode("sz").alias("pz"))
    index = lambda p: F.pmod(F.col(f"{p}.i"), F.lit(n)).cast("int")
    return spread.groupBy(index("px").alias("ix"), index("py").alias("iy"), index("pz").alias("iz")).agg(
        F.sum(F.col("mass") * F.col("px.w") * F.col("py.w") * F.col("pz.w")).alias("mass")
    )


def conserved_totals(cells: DataFrame, volume: Column | None = None) -> DataFrame:
    """Mass, momentum, kinetic, internal and total energy and metals of gas cells; NaN and null rows are left out."""
    m = F.col("mass") if volume is None else F.col("density") * volume
    kinetic = 0.5 * m * (F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)
    internal = m * F.col("internal_energy")
    return cells.where(finite("mass", *VELOCITY, "internal_energy")).agg(
        F.sum(m).alias("mass"), *[F.sum(m * F.col(v)).alias(f"p{v[1]}") for v in VELOCITY], F.sum(kinetic).alias("kinetic"), F.sum(internal).alias("internal"),
        F.sum(kinetic + internal).alias("total_energy"), F.sum("metal_mass").alias("metals"),
    )


def bounds(points: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Least and largest of each column over finite rows, and how many rows aren't finite."""
    ok = finite(*columns)
    lows = [F.min(F.when(ok, F.col(c))).alias(f"min_{c}") for c in columns]
    highs = [F.max(F.when(ok, F.col(c))).alias(f"max_{c}") for c in columns]
    return points.agg(*lows, *highs, count_if(~ok).alias("n_not_finite"))


def state_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-independent digest of rows: a count and an exclusive or of 64-bit row hashes (own value domain)."""
    return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("digest"))


def portable_digest(df: DataFrame, columns: list[str], *by: str, digits: int = 6) -> DataFrame:
    """(by, digest, n): an order-independent digest that any engine can compute: the exclusive or of 60 bits of the MD5 of each row's values,
    joined by "|". Floats count in whole steps of 10^-digits; null and values that aren't finite have texts of their own."""
    def text(c: str) -> Column:
        if dict(df.dtypes)[c] not in ("double", "float"):
            return F.coalesce(F.col(c).cast("string"), F.lit("null"))
        steps = F.floor(F.col(c) * F.lit(float(10**digits))).cast("long").cast("string")
        return F.when(F.col(c).isNull(), "null").when(finite(c), steps).otherwise("nan")

    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *[text(c) for c in columns]).cast("binary")), 1, 15), 16, 10).cast("long")
    return df.withColumn("_bits", bits).groupBy(*by).agg(F.bit_xor("_bits").alias("digest"), F.count("*").alias("n"))


def identity_summary(df: DataFrame, ident: str) -> DataFrame:
    """Count, sum of ids and of their squares modulo 2^64, exclusive or, and whether all ids differ."""
    wide = F.col(ident).cast("decimal(20,0)")
    modulus = F.lit("18446744073709551616").cast("decimal(38,0)")
    return df.agg(
        F.count("*").alias("n"), (F.sum(wide).cast("decimal(38,0)") % modulus).cast("decimal(20,0)").alias("id_sum"),
        (F.sum((F.col(ident).cast("decimal(18,0)") * F.col(ident).cast("decimal(18,0)")).cast("decimal(38,0)")) % modulus).cast("decimal(20,0)").alias("id_square_sum"),
        F.bit_xor(ident).alias("id_xor"), (F.count("*") == F.countDistinct(ident)).alias("unique_ids"),
    )
