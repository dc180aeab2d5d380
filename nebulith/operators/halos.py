"""Friends-of-friends groups, their catalogue, and the scaffold that links catalogues of successive snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulith.operators.base import finite
from nebulith.operators.groups import components
from nebulith.operators.near_pairs import near_pairs
from nebulith.operators.skew import heavy_values, salted_join, stitched
from nebulith.operators.state import minimum_image, periodic_wrap
from nebulith.runtime import Scratch

STEP_SHIFT = 32


def candidates(particles: DataFrame, species: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Rows that take part: chosen species with finite position, velocity and mass."""
    return particles.where(F.col("species_tag").isin(*species) & finite("x", "y", "z", "vx", "vy", "vz", "mass"))


def link_lengths(points: DataFrame, factor: float, box: float) -> dict[int, float]:
    """factor · box / N^(1/3) per snapshot, N counting candidates only. One number per snapshot goes to the driver."""
    return {r["snap_step"]: factor * box / r["n"] ** (1 / 3) for r in points.groupBy("snap_step").agg(F.count("*").alias("n")).collect()}


def friend_links(points: DataFrame, factor: float, box: float) -> DataFrame:
    """(snap_step, a, b): pairs within their snapshot's linking length, found by the strip sweep; a snapshot is swept with its own length."""
    lengths = link_lengths(points, factor, box)
    if not lengths:
        return points.sparkSession.createDataFrame([], "snap_step long, a long, b long")
    pairs = near_pairs(points, "particle_id", ("x", "y", "z"), "snap_step", lengths, box)
    return pairs.select(F.col("grp").alias("snap_step"), F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def membership(points: DataFrame, factor: float, box: float, min_size: int) -> DataFrame:
    """(snap_step, particle_id, label, ordinal, halo_id) of particles in groups of at least ``min_size``.

    Groups of a snapshot are numbered by their least particle id; halo_id = step << 32 | ordinal + 1.
    """
    scratch = Scratch(points.sparkSession, "halos")
    labels = scratch.write(components(scratch.write(friend_links(points, factor, box).select("a", "b"))))
    labelled = points.select("snap_step", "particle_id").join(labels.withColumnRenamed("vertex", "particle_id"), "particle_id", "left" if min_size <= 1 else "inner")
    labelled = scratch.write(labelled.withColumn("label", F.coalesce("label", "particle_id")))
    sizes = scratch.write(labelled.groupBy("snap_step", "label").agg(F.count("*").alias("n")))
    numbered = stitched(sizes.where(F.col("n") >= min_size), ["snap_step"], ["label"]).select("label", F.col("_rn").alias("ordinal"), (F.shiftleft(F.col("snap_step").cast("long"), STEP_SHIFT).bitwiseOR(F.col("_rn").cast("long"))).alias("halo_id"))
    heavy = heavy_values(sizes, "label", counted="n")  # a halo that holds most particles is cut in pieces
    return salted_join(labelled, numbered, "label", ["particle_id"], heavy).select("snap_step", "particle_id", "label", "ordinal", "halo_id")


def catalogue(points: DataFrame, members: DataFrame, box: float) -> DataFrame:
    """Per halo: particles, mass, centre of mass, bulk velocity and least id.

    Positions are unwrapped relative to the least-id member by one box length at most, averaged and wrapped back. The anchor is a
    field of the group's label. Particles near each other share an anchor, so it is joined salted where a halo holds most particles; the
    sums are reduced before the shuffle.
    """
    scratch = Scratch(points.sparkSession, "catalogue")
    rows = scratch.write(members.join(points.drop("snap_step"), "particle_id"))
    heads = rows.where(F.col("particle_id") == F.col("label")).select("label", *[F.col(c).alias(f"a{c}") for c in "xyz"])
    rows = salted_join(rows, heads, "label", ["particle_id"], heavy_values(rows, "label"))
    m = F.col("mass")
    at = lambda c: F.col(f"a{c}") + minimum_image(F.col(c) - F.col(f"a{c}"), box)
    sums = rows.groupBy("snap_step", "halo_id", "label").agg(
        F.count("*").alias("particle_count"), F.sum("mass").alias("mass"), *[F.sum(m * at(c)).alias(f"s{c}") for c in "xyz"], *[F.sum(m * F.col(f"v{c}")).alias(f"p{c}") for c in "xyz"]
    )
    return sums.select(
        "snap_step", "halo_id", F.col("label").alias("min_particle_id"), "particle_count", "mass",
        *[periodic_wrap(F.col(f"s{c}") / F.col("mass"), box).alias(f"com_{c}") for c in "xyz"], *[(F.col(f"p{c}") / F.col("mass")).alias(f"v_{c}") for c in "xyz"],
    )


def subhalo_candidates(halos: DataFrame) -> DataFrame:
    """Always empty, by policy; the schema is the catalogue's."""
    return halos.limit(0)


def merger_nodes(halos: DataFrame) -> DataFrame:
    """Each halo beside the node of the same ordinal one step earlier, if there is one.

    A scaffold: the match is by ordinal, not by shared members, and the "descendant" is the earlier node.
    """
    steps = halos.select(F.col("snap_step").alias("step")).distinct()
    earlier = steps.alias("a").join(steps.alias("b"), F.col("b.step") < F.col("a.step")).groupBy(F.col("a.step").alias("snap_step")).agg(F.max("b.step").alias("before"))
    mine = halos.select("snap_step", "halo_id").join(earlier, "snap_step", "left").withColumn("target", F.shiftleft("before", STEP_SHIFT).bitwiseOR(F.col("halo_id").bitwiseAND(F.lit((1 << STEP_SHIFT) - 1))))
    old = halos.select(F.col("halo_id").alias("target"), F.lit(True).alias("has_descendant"))
    return mine.join(old, "target", "left").select(
        F.col("halo_id").alias("tree_node_id"), "halo_id", "snap_step", F.when(F.col("has_descendant"), F.col("target")).alias("descendant_tree_node_id"), F.coalesce("has_descendant", F.lit(False)).alias("has_descendant")
    )


def broadcast_labels(points: DataFrame, members: DataFrame) -> DataFrame:
    """Every candidate with its halo, null where it is in none."""
    return points.select("snap_step", "particle_id").join(members.select("particle_id", "halo_id"), "particle_id", "left")
