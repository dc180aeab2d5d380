"""Frames the tables don't hold, derived the same way in both engines: stars, black holes, halos of hosts, work items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STARS_SQL = """SELECT o_orderkey AS star_id, o_custkey AS host, ((o_orderkey * 7919) % 10007) / 10007.0 AS formation_a, o_totalprice / 1000 AS birth_mass, (o_custkey % 40) / 1000.0 AS metallicity,
  o_totalprice / 1000 * 0.004 AS returned_metals, o_totalprice / 1000 * 0.001 AS new_metals, o_totalprice / 1000 * 0.003 AS deposited_metals, o_totalprice / 1000 * 0.0005 AS carry_metals,
  (o_orderkey % 97) * 1.2e8 AS age_years FROM orders"""


def stars(t) -> DataFrame:
    m = F.col("o_totalprice") / 1000
    return t.orders.select(
        F.col("o_orderkey").alias("star_id"), F.col("o_custkey").alias("host"), (((F.col("o_orderkey") * 7919) % 10007) / 10007.0).alias("formation_a"), m.alias("birth_mass"),
        ((F.col("o_custkey") % 40) / 1000.0).alias("metallicity"), (m * 0.004).alias("returned_metals"), (m * 0.001).alias("new_metals"),
        (m * 0.003).alias("deposited_metals"), (m * 0.0005).alias("carry_metals"), ((F.col("o_orderkey") % 97) * 1.2e8).alias("age_years"),
    )


ITEMS_SQL = "SELECT particle_id AS item, x / 100 - floor(x / 100) AS x, y / 100 - floor(y / 100) AS y, z / 100 - floor(z / 100) AS z, owning_rank AS owner, 1 + time_bin AS work, 128 + 8 * (particle_id % 16) AS memory, species_tag FROM (SELECT DISTINCT ON (particle_id) * FROM particles) WHERE isfinite(x) AND isfinite(y) AND isfinite(z)"


def items(t) -> DataFrame:
    """Work items of a decomposition: position in [0, 1), owner, work and memory."""
    from nebulith.operators.base import finite

    p = t.current_particles.where(finite("x", "y", "z"))
    return p.select(
        F.col("particle_id").alias("item"), *[(F.col(c) / 100 - F.floor(F.col(c) / 100)).alias(c) for c in ("x", "y", "z")], F.col("owning_rank").alias("owner"),
        (1 + F.col("time_bin")).alias("work"), (128 + 8 * (F.col("particle_id") % 16)).alias("memory"), "species_tag",
    )
