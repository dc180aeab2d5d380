"""Queries: views, packets, remaps and small scans that complete the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from nebulith.operators import amr, gravity, state, tables
from nebulith.operators.base import finite
from nebulith.plans.catalog import CC, CG, CP, CT, query, rounded
from nebulith.runtime import Scratch
from nebulith.sources import products


@query("io04_distributed_scan", f"SELECT owning_rank, count(*) AS n, count(DISTINCT particle_id) AS n_ids, bit_xor(particle_id) AS id_xor FROM {CP} GROUP BY 1")
def io04(t):
    """Audit of the records of each owner: counts, distinct ids and a digest, reduced before the shuffle; no row is sent to one of few ranks."""
    per_id = t.current_particles.groupBy("owning_rank", "particle_id").agg(F.count("*").alias("copies"), F.when(F.count("*") % 2 == 1, F.col("particle_id")).otherwise(F.lit(0)).alias("bits"))
    return per_id.groupBy("owning_rank").agg(F.sum("copies").alias("n"), F.count("*").alias("n_ids"), F.bit_xor("bits").alias("id_xor"))


@query("io31_cooling_table", "SELECT * FROM (VALUES (3.0, -25.0), (4.0, -23.0), (5.0, -22.0), (7.0, -22.5)) v(log_t, log_rate)")
def io31(t):
    """A cooling table written as text, scanned, and refused if its temperatures don't rise."""
    path = Scratch(t.spark, "cooling").base
    t.spark.createDataFrame([(x,) for x in ("# log10 T, log10 rate", "3.0 -25.0", "4.0 -23.0", "5.0 -22.0  # peak", "", "7.0 -22.5")], "value string").coalesce(1).write.text(path)
    table = products.read_number_table(t.spark, path, ["log_t", "log_rate"])
    bad = tables.increasing_violations(table, "log_t", "log_t").agg(F.count("*").alias("bad"))
    return table.join(F.broadcast(bad), F.lit(True)).where("bad = 0").drop("bad")  # bad: one row


@query("st04_swap_erase", f"SELECT particle_id FROM {CP} WHERE isfinite(mass)")
def st04(t):
    """Unordered removal of the rows without a finite mass."""
    return t.current_particles.where(finite("mass")).select("particle_id")


@query("st07_gravity_view", f"SELECT particle_id, CASE WHEN isfinite(mass) AND time_bin <= 2 THEN mass * 2 ELSE mass END AS mass FROM {CP}")
def st07(t):
    """Lanes of the active particles gathered, changed by a kernel and scattered back."""
    p = t.current_particles.select("particle_id", "mass", "time_bin")
    view = p.where((F.col("time_bin") <= 2) & finite("mass")).select("particle_id", (F.col("mass") * 2).alias("mass"))
    return state.scatter(p, view, "particle_id", ["mass"]).select("particle_id", "mass")


@query("st08_hydro_view", f"SELECT gas_cell_id, CASE WHEN isfinite(density) AND time_bin <= 2 THEN density * 0.5 ELSE density END AS density FROM {CC}")
def st08(t):
    """The same for gas cells."""
    c = t.current_cells.select("gas_cell_id", "density", "time_bin")
    view = c.where((F.col("time_bin") <= 2) & finite("density")).select("gas_cell_id", (F.col("density") * 0.5).alias("density"))
    return state.scatter(c, view, "gas_cell_id", ["density"]).select("gas_cell_id", "density")


@query("st09_species_index", f"SELECT species_tag, count(*) AS n, min(particle_id) AS first_id, max(particle_id) AS last_id FROM {CP} GROUP BY 1")
def st09(t):
    """Extent of each species' list."""
    return t.current_particles.groupBy("species_tag").agg(F.count("*").alias("n"), F.min("particle_id").alias("first_id"), F.max("particle_id").alias("last_id"))


@query("st11_species_packet", f"SELECT particle_id, x, vx, mass, owning_rank FROM {CP} WHERE species_tag = 3")
def st11(t):
    """Rows of one species as a transfer packet."""
    return state.species_tables(t.current_particles)["black_hole"].select("particle_id", "x", "vx", "mass", "owning_rank")


@query("st13_unique_ids", "SELECT count(*) = count(DISTINCT particle_id) AS unique_ids, count(*) FILTER (particle_id = 0) = 0 AS persistent FROM particles")
def st13(t):
    """Whether ids are unique and none is zero, over all rows as stored."""
    return t.particles.agg((F.count("*") == F.countDistinct("particle_id")).alias("unique_ids"), (F.sum(F.when(F.col("particle_id") == 0, 1).otherwise(0)) == 0).alias("persistent"))


@query("st21_module_sidecars", "SELECT run_name AS module, sha256(string_agg(DISTINCT CAST(restart_schema_version AS VARCHAR), ',' ORDER BY CAST(restart_schema_version AS VARCHAR))) AS digest FROM ic_files GROUP BY 1")
def st21(t):
    """Opaque payloads keyed by module name, listed in order; a payload is a run's few versions as bytes."""
    texts = t.ic_files.groupBy(F.col("run_name").alias("module")).agg(F.array_join(F.sort_array(F.collect_set(F.col("restart_schema_version").cast("string"))), ",").cast("binary").alias("payload"))
    return texts.select("module", F.sha2("payload", 256).alias("digest")).orderBy("module")


@query("jn13_scheduler_remap", f"SELECT c.gas_cell_id, c.time_bin AS cell_bin, p.time_bin AS parent_bin FROM {CC} c JOIN {CP} p ON p.particle_id = c.parent_particle_id")
def jn13(t):
    """Scheduler rows carried over to cells by the id of their parent."""
    c = t.current_cells.select("gas_cell_id", F.col("time_bin").alias("cell_bin"), F.col("parent_particle_id").alias("particle_id"))
    return c.join(t.current_particles.select("particle_id", F.col("time_bin").alias("parent_bin")), "particle_id").select("gas_cell_id", "cell_bin", "parent_bin")


@query("jn14_interface_match", f"WITH g AS (SELECT * FROM {CG} WHERE source_patch_id IS NOT NULL) SELECT a.patch_id, a.source_patch_id, count(*) AS n FROM (SELECT patch_id, source_patch_id, count(*) AS n FROM g GROUP BY 1, 2) a JOIN (SELECT patch_id, source_patch_id FROM g GROUP BY 1, 2) b ON a.patch_id = b.source_patch_id AND a.source_patch_id = b.patch_id GROUP BY 1, 2")
def jn14(t):
    """Pairs of patches that advertise faces to each other."""
    sides = t.current_amr_ghosts.where("source_patch_id IS NOT NULL").select("patch_id", "source_patch_id").distinct()
    back = sides.select(F.col("source_patch_id").alias("patch_id"), F.col("patch_id").alias("source_patch_id"))
    return sides.join(back, ["patch_id", "source_patch_id"]).groupBy("patch_id", "source_patch_id").agg(F.count("*").alias("n"))


@query("so04_active_order", f"SELECT particle_id, row_number() OVER (ORDER BY particle_id) AS place FROM {CP} WHERE time_bin = 0")
def so04(t):
    """Active rows in order of id."""
    from nebulith.operators.skew import stitched

    on = t.current_particles.where("time_bin = 0").select("particle_id").withColumn("_all", F.lit(0))
    return stitched(on, ["_all"], ["particle_id"]).select("particle_id", F.col("_rn").cast("long").alias("place"))


@query("so06_top_k", f"SELECT particle_id, mass FROM {CP} WHERE isfinite(mass) ORDER BY mass DESC, particle_id LIMIT 50")
def so06(t):
    """The fifty heaviest particles, ties by id: a top-k of partial tops."""
    return t.current_particles.where(finite("mass")).select("particle_id", "mass").orderBy(F.desc("mass"), "particle_id").limit(50)


@query("so07_birth_order", f"SELECT gas_cell_id, row_number() OVER (ORDER BY gas_cell_id) - 1 AS place FROM {CC} WHERE isfinite(density) AND density > 1")
def so07(t):
    """Dense cells in the order of their births; a cell that comes twice in a plan is an error."""
    from nebulith.operators.subgrid import birth_order

    plan = t.current_cells.where(finite("density") & (F.col("density") > 1)).select("gas_cell_id")
    return birth_order(plan).select("gas_cell_id", F.col("place").cast("long").alias("place"))


@query("se04_patch_migration", f"""WITH p AS (SELECT patch_id, count(*) AS n FROM {CC} WHERE patch_id IS NOT NULL GROUP BY 1)
SELECT patch_id, n, 0 AS _order FROM p WHERE patch_id % 4 <> 1 AND patch_id % 4 <> 3 UNION ALL SELECT patch_id, n, 1 FROM p WHERE patch_id % 4 = 3""")
def se04(t):
    """Patches that leave and arrive, with their cells."""
    p = Scratch(t.spark, "patches").write(t.current_cells.where("patch_id IS NOT NULL").groupBy("patch_id").agg(F.count("*").alias("n")))  # one count for what stays, leaves and comes
    mine = p.where("patch_id % 4 <> 3")
    return state.commit_migration(mine, mine.where("patch_id % 4 = 1"), p.where("patch_id % 4 = 3"), "patch_id")


@query("ag29_memory_report", f"SELECT 'particles' AS subsystem, 'state' AS lifetime, count(*) * 13 * 8 AS bytes FROM {CP} UNION ALL SELECT 'cells', 'state', count(*) * 17 * 8 FROM {CC} UNION ALL SELECT 'tracers', 'sidecar', count(*) * 8 * 8 FROM {CT} UNION ALL SELECT 'ghosts', 'transient', count(*) * 9 * 8 FROM {CG}")
def ag29(t):
    """Bytes that the state tables hold by subsystem and lifetime, eight per lane."""
    out = None
    for name, life, df, lanes in (("particles", "state", t.current_particles, 13), ("cells", "state", t.current_cells, 17), ("tracers", "sidecar", t.current_tracers, 8), ("ghosts", "transient", t.current_amr_ghosts, 9)):
        row = df.agg((F.count("*") * lanes * 8).alias("bytes")).select(F.lit(name).alias("subsystem"), F.lit(life).alias("lifetime"), "bytes")
        out = row if out is None else out.unionByName(row)
    return out


def _potential_sql() -> str:
    from nebulith.plans.reference_k import gathered_sql

    return gathered_sql(16, ("phi",), 5)


@query("gr09_potential_gather", _potential_sql())
def gr09(t):
    """The mesh potential at the particles."""
    p = t.current_particles.where(finite("x", "y", "z", "mass")).select(F.col("particle_id").alias("item"), *[(F.col(c) - 100 * F.floor(F.col(c) / 100)).alias(c) for c in "xyz"], "mass")
    mesh = Scratch(t.spark, "potential").write(gravity.poisson_periodic(gravity.mesh_density(p, 16, 100.0), 16, 100.0, 43.0))
    return rounded(gravity.interpolate_mesh(p, mesh, 16, 100.0, ("phi",)), phi=5)


@query("am13_conserved_rows", f"SELECT gas_cell_id, patch_id, round(density * vx, 7) AS mx, round(density * (internal_energy + 0.5 * (vx * vx + vy * vy + vz * vz)), 4) AS e FROM {CC} WHERE isfinite(density) AND isfinite(vx) AND isfinite(vy) AND isfinite(vz) AND isfinite(internal_energy)")
def am13(t):
    """Cell rows loaded as conserved states of their patch."""
    c = t.current_cells.where(finite("density", "vx", "vy", "vz", "internal_energy"))
    e = F.col("density") * (F.col("internal_energy") + 0.5 * (F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2))
    return rounded(c.select("gas_cell_id", "patch_id", (F.col("density") * F.col("vx")).alias("mx"), e.alias("e")), mx=7, e=4)


_SPLIT = "isfinite(mass) AND isfinite(cx) AND isfinite(cy) AND isfinite(cz)"


@query("am02_production_refine", f"""WITH c AS (SELECT gas_cell_id, patch_id, cx, mass FROM {CC} WHERE {_SPLIT}), s AS (SELECT * FROM c WHERE coalesce(patch_id % 3 = 0, false)),
k AS (SELECT gas_cell_id * 8 + o + 1 AS key, gas_cell_id AS parent_key, mass / 8 AS mass, cx + ((o & 1) - 0.5) * 0.5 AS cx, row_number() OVER (ORDER BY gas_cell_id * 8 + o + 1) AS rn FROM s, range(8) r(o)),
seed AS (SELECT (SELECT max(gas_cell_id) FROM c) + 1 + i AS id, row_number() OVER (ORDER BY i) AS rn FROM range((SELECT 8 * count(*) FROM s)) r(i))
SELECT gas_cell_id, CAST(NULL AS BIGINT) AS key, CAST(NULL AS BIGINT) AS parent_key, cx, mass FROM c ANTI JOIN s USING (gas_cell_id) UNION ALL SELECT id, key, parent_key, cx, mass FROM k JOIN seed USING (rn)""")
def am02p(t):
    """Cells of chosen patches replaced by children of the production form, whose ids come from a list of free ones."""
    c = t.current_cells.where(finite("mass", "cx", "cy", "cz")).select("gas_cell_id", "patch_id", "cx", "cy", "cz", "mass", F.lit(1.0).alias("width"), F.lit(0).alias("level"))
    chosen = F.coalesce(F.col("patch_id") % 3 == 0, F.lit(False))
    last, n = c.agg(F.max("gas_cell_id"), F.sum(F.when(chosen, 8).otherwise(0))).first()
    free = t.spark.range(n or 0).select((F.col("id") + F.lit((last or 0) + 1)).alias("id"))
    return amr.refine_production(c, chosen, free, ("mass",)).select("gas_cell_id", "key", "parent_key", "cx", "mass")
