"""State tables: gather, scatter, compaction, species tables, ownership checks, id sets and migrations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nebulith.operators.base import count_if


def gather(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is wanted, each once per wanting."""
    return wanted.select(key).join(rows, key)


def scatter(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the updates' values put in where there are any. ``updates`` has one row per key."""
    new = updates.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = rows.join(new, key, "left")
    return joined.withColumns({c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).drop("_hit", *[f"_new_{c}" for c in columns])


def species_tables(particles: DataFrame) -> dict[str, DataFrame]:
    """One lazily filtered table per species; the filter reaches the scan."""
    from nebulith.operators.base import SPECIES

    return {name: particles.where(F.col("species_tag") == tag) for name, tag in SPECIES.items()}


def periodic_wrap(c: Column, box: float) -> Column:
    """Into [0, box); what rounds up to the box becomes 0."""
    w = c - F.lit(box) * F.floor(c / box)
    return F.when((w >= box) & ~F.isnan(w), 0.0).otherwise(w)  # NaN counts as the largest number, and stays NaN


def minimum_image(d: Column, box: float) -> Column:
    """A difference moved by one box length at most."""
    return F.when(d > box / 2, d - box).when(d < -box / 2, d + box).otherwise(d)


def softening(override: Column, species: Column, by_species: dict[int, float], default: float) -> Column:
    """Override, else the species' default, else the global one."""
    table = F.create_map(*[F.lit(x) for kv in by_species.items() for x in kv])
    return F.coalesce(override, table[species], F.lit(default))


def gravity_sources(particles: DataFrame, cells: DataFrame) -> DataFrame:
    """Particles that no gas cell stands for, and the gas cells: (source, kind, mass), nothing counted twice."""
    parents = cells.where(F.col("parent_particle_id").isNotNull()).select(F.col("parent_particle_id").alias("particle_id"))
    own = particles.join(parents, "particle_id", "left_anti").select(F.col("particle_id").alias("source"), F.lit("particle").alias("kind"), "mass")
    return own.unionByName(cells.select(F.col("gas_cell_id").alias("source"), F.lit("cell").alias("kind"), "mass"))


def ownership_checks(particles: DataFrame, cells: DataFrame, tracers: DataFrame) -> DataFrame:
    """(check_name, n_bad): duplicate ids, ids that aren't positive, sidecars of a wrong species or without their particle."""
    dup = lambda df, key, name: df.groupBy(key).count().agg(count_if(F.col("count") > 1).alias("n_bad")).select(F.lit(name).alias("check_name"), "n_bad")
    bad_id = particles.agg(count_if(F.col("particle_id") <= 0).alias("n_bad")).select(F.lit("non_positive_id").alias("check_name"), "n_bad")
    lost = tracers.join(particles, "particle_id", "left_anti").agg(F.count("*").alias("n_bad")).select(F.lit("tracer_without_particle").alias("check_name"), "n_bad")
    wrong = tracers.join(particles.select("particle_id", "species_tag"), "particle_id").agg(count_if(F.col("species_tag") != 4).alias("n_bad")).select(F.lit("tracer_of_other_species").alias("check_name"), "n_bad")
    return reduce(DataFrame.unionByName, [dup(particles, "particle_id", "duplicate_particle"), dup(cells, "gas_cell_id", "duplicate_cell"), bad_id, lost, wrong]).select("check_name", F.coalesce("n_bad", F.lit(0)).cast("long").alias("n_bad"))


def row_remap(old: DataFrame, new: DataFrame, key: str, row: str) -> DataFrame:
    """(key, old_row, new_row) by stable id; a row that is only on one side has a null on the other."""
    return old.select(key, F.col(row).alias("old_row")).join(new.select(key, F.col(row).alias("new_row")), key, "full_outer")


def id_differences(have: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, state): missing, extra or duplicate ids against the expected ones."""
    mine = have.groupBy(key).agg(F.count("*").alias("n"))
    want = expected.select(key).distinct().withColumn("wanted", F.lit(True))
    both = mine.join(want, key, "full_outer")
    states = F.array_compact(F.array(F.when(F.col("n").isNull(), "missing"), F.when(F.col("wanted").isNull(), "extra"), F.when(F.col("n") > 1, "duplicate")))
    return both.select(key, F.explode(states).alias("state"))


def commit_migration(current: DataFrame, outbound: DataFrame, inbound: DataFrame, key: str, epoch: int | None = None) -> DataFrame:
    """(current − outbound − stale ghosts) ∪ inbound. ``_order`` keeps the rows in place before those that came in.

    Stale are ghosts of an epoch other than ``epoch``. A final id that would be there twice is an error at run time.
    """
    kept = current
    if epoch is not None and "ghost_epoch" in current.columns:
        kept = kept.where(F.col("ghost_epoch").isNull() | (F.col("ghost_epoch") == epoch))
    kept = kept.join(outbound.select(key), key, "left_anti").withColumn("_order", F.lit(0))
    final = kept.unionByName(inbound.withColumn("_order", F.lit(1))).where(F.col(key).isNotNull())
    checked = final.withColumn("_n", F.count("*").over(Window.partitionBy(key)))  # in one pass: a second reading may keep other ones of unequal copies
    fail = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate id after migration: "), F.col(key).cast("string"))).cast("long"))
    return checked.withColumn("_order", F.coalesce(fail, F.col("_order").cast("long"))).drop("_n")


def sidecar_required(species: Column, flags: Column, density: Column, species_mask: int, flag_mask: int, least_density: float) -> Column:
    """A module's sidecar row is required: its species is in the mask, a flag is set, or the density reaches a threshold."""
    bit = F.pmod(F.floor(F.lit(species_mask) / F.pow(F.lit(2), species)), F.lit(2)) == 1
    return bit & ((flags.bitwiseAND(F.lit(flag_mask)) != 0) | F.coalesce(density >= least_density, F.lit(False)))
