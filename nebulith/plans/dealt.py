"""Queries pN_ of the general problems over the whole tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulith.operators import copy_diff, near_pairs, references, schema_drift, skew, unit_harmony
from nebulith.operators.base import current, finite
from nebulith.runtime import read_table

BOX = 100.0


def _si_readings(spark: SparkSession, d: str):
    si = {r["symbol"]: r["si_value"] for r in read_table(spark, d, "base_units").collect()}  # a fixed table of 12 rows
    return unit_harmony.si_readings(read_table(spark, d, "field_readings"), read_table(spark, d, "ic_fields"), read_table(spark, d, "ic_files"), si)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Particles and quantities whose readings, all in SI, differ by more than 1 %."""
    return unit_harmony.disagreeing(_si_readings(spark, d)[0])


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    """Every reading in SI, where its unit came from and what is left for review."""
    return _si_readings(spark, d)[0]


def p1_hidden_units(spark: SparkSession, d: str) -> DataFrame:
    """How well the units of a tenth of the fields, hidden before the fit, are predicted: precision, coverage and calibration per unit."""
    si = {r["symbol"]: r["si_value"] for r in read_table(spark, d, "base_units").collect()}  # a fixed table of 12 rows
    return unit_harmony.hidden_unit_report(read_table(spark, d, "field_readings"), read_table(spark, d, "ic_fields"), read_table(spark, d, "ic_files"), si)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Ids missing on either side and columns that differ between particles and particles_replica."""
    return copy_diff.compare_copies(
        read_table(spark, d, "particles"), read_table(spark, d, "particles_replica"), "particle_id", ("ingested_at",), "particles", "replica"
    )


def p2_columns(spark: SparkSession, d: str) -> DataFrame:
    """Which of both copies has each column."""
    return copy_diff.column_sides(read_table(spark, d, "particles"), read_table(spark, d, "particles_replica"), "particles", "replica")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of particles of one snapshot at most 0.05 apart in the periodic box."""
    pairs = near_pairs.near_pairs(read_table(spark, d, "particles"), "particle_id", ("x", "y", "z"), "snap_step", 0.05, BOX)
    return pairs.select(F.col("id_a").alias("particle_id_a"), F.col("id_b").alias("particle_id_b"))


def _reference_states(spark: SparkSession, d: str) -> DataFrame:
    particles, cells = read_table(spark, d, "particles"), read_table(spark, d, "cells")
    tracers, ghosts = read_table(spark, d, "tracers"), read_table(spark, d, "amr_ghosts")
    return references.reference_states(
        [
            references.references(tracers, "tracers", "tracer_parent", "particle", "particle_id"),
            references.references(tracers, "tracers", "tracer_host", "cell", "particle_id"),
            references.references(ghosts, "amr_ghosts", "source_gas_cell_id", "cell", "ghost_id"),
        ],
        [references.parent_intervals(particles, "particle", "particle_id"), references.parent_intervals(cells, "cell", "gas_cell_id")],
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """References without a target, or to one removed at or before the referring step."""
    return references.orphans(_reference_states(spark, d))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """References per table, field and snapshot step: all, missing, deleted, late."""
    return references.orphan_report(_reference_states(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys with at least 2 % of their table's rows."""
    members = skew.hot_keys(read_table(spark, d, "cell_members").select("cell_key", "particle_id"), "cell_key", ["particle_id"], 0.02)
    slabs = skew.hot_keys(read_table(spark, d, "pm_ownership").select("owner_rank", "decomposition_epoch", "begin_x"), "owner_rank", ["decomposition_epoch", "begin_x"], 0.02)
    return members.select(F.lit("cell_members").alias("table_name"), "hot_key").union(slabs.select(F.lit("pm_ownership").alias("table_name"), "hot_key"))


def p6_cell_results(spark: SparkSession, d: str) -> DataFrame:
    """Members, first and last local index and number of snapshots' rows of each cell, resent rows counted."""
    return skew.balanced_groups(
        read_table(spark, d, "cell_members").select("cell_key", "snap_step", "local_index", "particle_id"), ["cell_key"], ["snap_step", "local_index"],
        [F.count("*").alias("n_rows"), F.min("local_index").alias("first_index"), F.max("local_index").alias("last_index"), F.sum("particle_id").alias("id_sum")],
    )


def p6_cell_masses(spark: SparkSession, d: str) -> DataFrame:
    """Members and mass of each cell: distinct members joined with their particle, resent rows and masses that are no number left out of the mass."""
    members = read_table(spark, d, "cell_members").select("cell_key", "snap_step", "local_index", "particle_id").distinct()
    masses = current(read_table(spark, d, "particles").select("particle_id", "mass", "ingested_at"), "particle_id").select("particle_id", F.when(finite("mass"), F.col("mass")).alias("mass"))
    cells = skew.balanced_groups(
        members.join(masses, "particle_id", "left"), ["cell_key"], ["snap_step", "local_index"],
        [F.count("*").alias("n_members"), F.count("mass").alias("n_masses"), F.sum("mass").alias("mass")],
    )
    return cells.withColumn("mass", F.round("mass", 6))


def p6_slab_widths(spark: SparkSession, d: str) -> DataFrame:
    """Running slab width of each owner rank in order of epoch and begin, over distinct slabs."""
    slabs = read_table(spark, d, "pm_ownership").select("owner_rank", "decomposition_epoch", "begin_x", "end_x").distinct()
    out = skew.stitched(slabs, ["owner_rank"], ["decomposition_epoch", "begin_x", "end_x"], sums={"running_width": F.col("end_x") - F.col("begin_x")})
    return out.select("owner_rank", "decomposition_epoch", "begin_x", "end_x", F.col("_rn").cast("long").alias("slab_no"), F.col("running_width").cast("long").alias("running_width"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Fields added, removed, renamed or retyped from one file of a run to the next."""
    return schema_drift.schema_changes(read_table(spark, d, "ic_files"), read_table(spark, d, "ic_fields"))


def p7_lifespans(spark: SparkSession, d: str) -> DataFrame:
    """Islands of files in which a run's field keeps its path and type."""
    return schema_drift.lifespans(schema_drift.field_catalogue(read_table(spark, d, "ic_files"), read_table(spark, d, "ic_fields")))


def p7_consistent(spark: SparkSession, d: str) -> DataFrame:
    """All restart rows under unified field names, each value in the column of its field's unified type."""
    out = schema_drift.consistent_rows(read_table(spark, d, "ic_files"), read_table(spark, d, "ic_fields"), read_table(spark, d, "restart_rows"))
    return out.withColumn("as_decimal", F.col("as_decimal").cast("string"))


def p7_casts(spark: SparkSession, d: str) -> DataFrame:
    """Unified name and type of every path of a run, from the alias and cast tables."""
    return schema_drift.cast_table(schema_drift.field_catalogue(read_table(spark, d, "ic_files"), read_table(spark, d, "ic_fields")))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_values, p1_hidden_units, p2_found, p2_columns, p3_found, p5_found, p5_report, p6_found, p6_cell_results, p6_cell_masses, p6_slab_widths, p7_found, p7_lifespans, p7_casts, p7_consistent)
}
