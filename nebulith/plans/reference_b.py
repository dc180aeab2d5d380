"""Queries: keys, decomposition, ordered prefixes, state tables, id joins and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from nebulith.functions import morton
from nebulith.operators import decomposition as P
from nebulith.operators import state as S
from nebulith.operators.base import finite
from nebulith.plans.catalog import CC, CG, CP, CT, query, rounded, stated, stated_sql
from nebulith.plans.frames import ITEMS_SQL, items

BOX = 100.0


def _bits(expr: str, bits: int, shift: int) -> str:
    return " | ".join(f"((({expr} >> {i}) & 1) << {3 * i + shift})" for i in range(bits))


_Q10 = ", ".join(f"CAST(least(greatest(floor({c} / 1 * 1024), 0), 1023) AS BIGINT) AS q{c}" for c in "xyz")
_ITEMS = f"it AS ({ITEMS_SQL}), qi AS (SELECT *, {_Q10} FROM it), ki AS (SELECT * EXCLUDE (qx, qy, qz), ({_bits('qz', 10, 2)}) | ({_bits('qy', 10, 1)}) | ({_bits('qx', 10, 0)}) AS key, CAST(work AS DOUBLE) AS load FROM qi)"


def _keyed(t):
    return items(t).withColumns({"key": morton.domain_key(F.col("x"), F.col("y"), F.col("z"), 1.0), "load": F.col("work").cast("double")})


@query("so01_tree_morton", f"""
WITH p AS (SELECT particle_id, x, y, z FROM {CP} WHERE isfinite(x) AND isfinite(y) AND isfinite(z)),
b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z), 1e-12) AS e FROM p),
q AS (SELECT particle_id, {", ".join(f"CAST(floor(least(greatest(({c} - l{c}) / e, 0), 1) * 2097151.0 + 0.5) AS BIGINT) AS q{c}" for c in "xyz")} FROM p, b)
SELECT particle_id, ({_bits('qx', 21, 2)}) | ({_bits('qy', 21, 1)}) | ({_bits('qz', 21, 0)}) AS morton_key FROM q""")
def so01(t):
    """Tree order: 63-bit keys over the bounding cube."""
    p = t.current_particles.where(finite("x", "y", "z"))
    b = p.agg(*[F.min(c).alias(f"l{c}") for c in "xyz"], F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("extent"))
    key = morton.tree_key(F.col("x"), F.col("y"), F.col("z"), (F.col("lx"), F.col("ly"), F.col("lz")), F.col("extent"))
    return p.join(F.broadcast(b), F.lit(True)).select("particle_id", key.alias("morton_key"))  # b: one row


@query("so02_domain_morton", f"WITH {_ITEMS} SELECT item, key FROM ki")
def so02(t):
    """Decomposition order: 30-bit keys."""
    return _keyed(t).select("item", "key")


@query("so02_cell_key", f"""
WITH p AS (SELECT particle_id, CAST(floor((x - 100 * floor(x / 100)) / 3.125) AS BIGINT) AS ix, CAST(floor((y - 100 * floor(y / 100)) / 3.125) AS BIGINT) AS iy, CAST(floor((z - 100 * floor(z / 100)) / 3.125) AS BIGINT) AS iz
  FROM {CP} WHERE isfinite(x) AND isfinite(y) AND isfinite(z))
SELECT particle_id, (ix * 32 + iy) * 32 + iz AS cell_key, ({_bits('ix', 5, 2)}) | ({_bits('iy', 5, 1)}) | ({_bits('iz', 5, 0)}) AS curve_key FROM p""")
def so02c(t):
    """Cell key and bit-interleaved curve key of a 32³ grid."""
    p = t.current_particles.where(finite("x", "y", "z"))
    i = [F.floor(S.periodic_wrap(F.col(c), BOX) / 3.125).cast("long") for c in "xyz"]
    return p.select("particle_id", ((i[0] * 32 + i[1]) * 32 + i[2]).alias("cell_key"), morton.interleave(*i, 5).alias("curve_key"))


@query("so03_reorder_map", f"SELECT particle_id, row_number() OVER (ORDER BY sfc_key NULLS FIRST, particle_id) - 1 AS new_row FROM {CP}")
def so03(t):
    """New row of each particle in curve order, ties by id: a stitched global rank."""
    from nebulith.operators.skew import stitched

    p = t.current_particles.select("particle_id", "sfc_key").withColumn("_all", F.lit(0))
    return stitched(p, ["_all"], ["sfc_key", "particle_id"]).select("particle_id", (F.col("_rn") - 1).cast("long").alias("new_row"))


def _largest_gap(w):
    """Per snap_step: a stitched lag and the wrap-around gap."""
    from nebulith.operators.skew import stitched

    lagged = stitched(w, ["snap_step"], ["x"], lags={"prev": "x"})
    per = lagged.groupBy("snap_step").agg(F.max(F.col("x") - F.col("prev")).alias("inner"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return rounded(per.select("snap_step", F.greatest(F.coalesce("inner", F.lit(0.0)), F.col("lo") + BOX - F.col("hi")).alias("gap")), gap=9)


@query("so05_largest_gap_all", f"""
WITH v AS (SELECT snap_step, x - 100 * floor(x / 100) AS x FROM {CP} WHERE isfinite(x)), w AS (SELECT snap_step, CASE WHEN x >= 100 THEN 0 ELSE x END AS x FROM v),
g AS (SELECT snap_step, x, coalesce(lead(x) OVER (PARTITION BY snap_step ORDER BY x), 100 + first_value(x) OVER (PARTITION BY snap_step ORDER BY x)) - x AS gap FROM w)
SELECT snap_step, round(max(gap), 9) AS gap FROM g GROUP BY snap_step""")
def so05_all(t):
    """Largest gap between neighbours on a periodic axis, where unwrapping cuts it, over the particles of every species."""
    return _largest_gap(t.current_particles.where(finite("x")).select("snap_step", S.periodic_wrap(F.col("x"), BOX).alias("x")))


@query("wn01_curve_cuts", f"""
WITH {_ITEMS}, s AS (SELECT *, sum(load) OVER (ORDER BY key, item ROWS UNBOUNDED PRECEDING) AS cum, sum(load) OVER () AS total FROM ki)
SELECT item, key, CAST(least(floor((cum - load) * 16 / total), 15) AS INT) AS rank FROM s""")
def wn01(t):
    """Contiguous pieces of the curve for 16 ranks. (The SQL holds while no item weighs more than a rank's target.)"""
    return P.curve_cuts(_keyed(t), 16).select("item", "key", "rank")


@query("ag16_load_metrics", f"""
WITH {_ITEMS}, r AS (SELECT owner AS rank, count(*) AS n_items, sum(load) AS load, sum(memory) AS memory FROM ki GROUP BY owner)
SELECT rank, n_items, load, CAST(memory AS BIGINT) AS memory, round(max(load) OVER () / (sum(load) OVER () / 24), 9) AS load_imbalance, round(max(memory) OVER () / (sum(memory) OVER () / 24), 9) AS memory_imbalance FROM r""")
def ag16(t):
    """Load and memory per current owner and their imbalance over 24 ranks."""
    return rounded(P.load_metrics(_keyed(t), "owner", 24), load_imbalance=9, memory_imbalance=9)


@query("ag17_weighted_load", f"""WITH {_ITEMS} SELECT item, CASE WHEN species_tag = 1 THEN work * 2.0 WHEN work - 3 > 0 THEN work - 3.0 WHEN memory - 200 > 0 THEN memory - 200.0 ELSE 1.0 END AS load FROM ki""")
def ag17(t):
    """Explicit components for gas, else a legacy load, else a fallback."""
    i = items(t)
    explicit = F.when(F.col("species_tag") == 1, F.col("work") * 2.0)
    return i.select("item", P.weighted_load(explicit, (F.col("work") - 3).cast("double"), (F.col("memory") - 200).cast("double"), F.lit(True)).alias("load"))


@query("ag19_ordered_sum", f"SELECT owning_rank AS rank, round(sum(m), 9) AS total FROM (SELECT owning_rank, snap_step, sum(mass) AS m FROM {CP} WHERE isfinite(mass) GROUP BY ALL) GROUP BY 1")
def ag19(t):
    """Per-rank sum of snapshot sums in a fixed order."""
    per = t.current_particles.where(finite("mass")).groupBy(F.col("owning_rank").alias("rank"), "snap_step").agg(F.sum("mass").alias("m"))
    return rounded(P.ordered_sum(per, "rank", "snap_step", "m"), total=9)


@query("ag20_agreement", f"""
WITH a AS (SELECT snap_step, sum(mass) AS m FROM (SELECT DISTINCT ON (particle_id) * FROM particles) WHERE isfinite(mass) GROUP BY 1), b AS (SELECT snap_step, sum(mass) AS m FROM (SELECT DISTINCT ON (particle_id) * FROM particles_replica) WHERE isfinite(mass) GROUP BY 1)
SELECT snap_step, round(abs(a.m - b.m), 6) AS abs_error, round(abs(a.m - b.m) / abs(b.m), 9) AS rel_error, abs(a.m - b.m) <= 1e-9 OR abs(a.m - b.m) / abs(b.m) <= 0.05 AS agrees FROM a JOIN b USING (snap_step)""")
def ag20(t):
    """Masses of the two copies per snapshot: absolute and relative error and agreement."""
    a = t.current_particles.where(finite("mass")).groupBy("snap_step").agg(F.sum("mass").alias("a"))
    r = t.particles_replica.drop("ingested_at").dropDuplicates(["particle_id"])
    b = r.where(finite("mass")).groupBy("snap_step").agg(F.sum("mass").alias("b"))
    err, rel, ok = P.agreement(F.col("a"), F.col("b"), 1e-9, 0.05)
    return rounded(a.join(b, "snap_step").select("snap_step", err.alias("abs_error"), rel.alias("rel_error"), ok.alias("agrees")), abs_error=6, rel_error=9)


@query("ag21_consensus", """
WITH f AS (SELECT DISTINCT source_file_index AS member, run_name, box_size FROM ic_files), r AS (SELECT run_name, arg_min(box_size, member) AS reference FROM f GROUP BY 1)
SELECT f.run_name, member, box_size, reference FROM f JOIN r USING (run_name) WHERE box_size IS DISTINCT FROM reference""")
def ag21(t):
    """Files whose box differs from that of their run's first file."""
    f = t.ic_files.select(F.col("source_file_index").alias("member"), "run_name", "box_size").distinct()
    return P.mismatching_members(f, "run_name", "box_size")


@query("ag22_domain_leaves", f"""
WITH {_ITEMS}, s AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY key, item) - 1 AS i, count(*) OVER (PARTITION BY owner) AS n FROM ki),
l AS (SELECT *, CAST(floor(((i + 1) * least(8, n) - 1) / n) AS INT) AS leaf FROM s)
SELECT owner, leaf, min(key) AS key_begin, max(key) AS key_end, count(*) AS n, sum(load) AS load, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM l GROUP BY owner, leaf""")
def ag22(t):
    """Eight top-domain leaves per owner."""
    return P.domain_leaves(_keyed(t).drop("work", "memory", "species_tag"), 8)


@query("wn02_species_ordinal", f"SELECT particle_id, species_tag, row_number() OVER (PARTITION BY species_tag ORDER BY particle_id) - 1 AS ordinal FROM {CP}")
def wn02(t):
    """Position within the species."""
    return P.species_ordinal(t.current_particles.select("particle_id", "species_tag"), "species_tag", "particle_id")


@query("wn06_retention", "WITH s AS (SELECT DISTINCT snap_step FROM particles) SELECT snap_step, row_number() OVER (ORDER BY snap_step DESC) <= 3 AS kept FROM s")
def wn06(t):
    """The newest three snapshots are kept. Steps are few, so one window over the distinct ones."""
    return t.particles.select("snap_step").distinct().select("snap_step", (F.row_number().over(Window.orderBy(F.desc("snap_step"))) <= 3).alias("kept"))


@query("wn08_chunk_coverage", """
WITH s AS (SELECT DISTINCT decomposition_epoch, begin_x, end_x FROM pm_ownership), g AS (SELECT *, begin_x - lag(end_x) OVER (PARTITION BY decomposition_epoch ORDER BY begin_x, end_x) AS gap FROM s)
SELECT decomposition_epoch, begin_x, end_x, gap FROM g WHERE coalesce(gap, 0) <> 0""")
def wn08(t):
    """Slabs of an epoch that leave a gap or overlap."""
    return P.chunk_gaps(t.pm_ownership.select("decomposition_epoch", "begin_x", "end_x").distinct(), "decomposition_epoch", "begin_x", "end_x")


@query("se07_neighbour_plan", """
WITH g AS (SELECT DISTINCT ghost_id, patch_id, source_patch_id FROM amr_ghosts) SELECT patch_id, source_patch_id, count(*) AS n_rows, min(ghost_id) AS first_row, max(ghost_id) AS last_row, bit_xor(ghost_id) AS row_xor
FROM g WHERE patch_id <> source_patch_id GROUP BY ALL""")
def se07(t):
    """Send and receive lists between patches."""
    return P.neighbour_plan(t.amr_ghosts.select("ghost_id", "patch_id", "source_patch_id").distinct(), "patch_id", "source_patch_id", "ghost_id")


@query("se08_rebalance_intents", f"""
WITH RECURSIVE {_ITEMS}, s AS (SELECT *, sum(load) OVER (ORDER BY key, item ROWS UNBOUNDED PRECEDING) AS cum, sum(load) OVER () AS total FROM ki), k AS (SELECT item, CAST(owner AS INT) AS old, CAST(least(floor((cum - load) * 24 / total), 23) AS INT) AS rank, load FROM s),
c AS (SELECT *, row_number() OVER (ORDER BY item) AS rn FROM k WHERE old >= 0 AND old <> rank),
r AS (SELECT rn, load AS used FROM c WHERE rn = 1 UNION ALL SELECT min(c.rn) AS rn, any_value(r.used) + arg_min(c.load, c.rn) AS used FROM r JOIN c ON c.rn > r.rn AND c.load <= 3000 - r.used GROUP BY r.rn)
SELECT item, old, rank, load FROM c SEMI JOIN r USING (rn)""")
def se08(t):
    """Particles that change owner under a cap on the moved load: a sequential rule. (The SQL's ranks hold while no item weighs more than a rank's target.)"""
    cut = P.curve_cuts(_keyed(t), 24).withColumn("old", F.col("owner").cast("int"))
    return P.rebalance_intents(cut, "old", "rank", 3000.0)


@query("st01_gather", f"SELECT p.particle_id, p.mass, p.species_tag FROM {CP} p JOIN (SELECT DISTINCT tracer_parent FROM tracers) w ON p.particle_id = w.tracer_parent")
def st01(t):
    """Rows named by a list of ids."""
    wanted = t.tracers.select(F.col("tracer_parent").alias("particle_id")).where("particle_id IS NOT NULL").distinct()
    return S.gather(t.current_particles.select("particle_id", "mass", "species_tag"), wanted, "particle_id")


@query("st02_scatter", f"SELECT p.particle_id, p.species_tag, CASE WHEN t.particle_id IS NOT NULL THEN t.last_host_mass * t.fraction ELSE p.mass END AS mass FROM {CP} p LEFT JOIN {CT} t USING (particle_id)")
def st02(t):
    """Tracer masses written back into the particle table."""
    new = t.current_tracers.select("particle_id", (F.col("last_host_mass") * F.col("fraction")).alias("mass"))
    return S.scatter(t.current_particles.select("particle_id", "species_tag", "mass"), new, "particle_id", ["mass"])


@query("st03_compact", f"SELECT particle_id, snap_step FROM {CP} WHERE removed_step IS NULL")
def st03(t):
    """Rows that were not taken out."""
    return t.current_particles.where("removed_step IS NULL").select("particle_id", "snap_step")


@query("st05_active_view", f"SELECT particle_id, {stated_sql('x', 'y', 'z', 'mass')} FROM {CP} WHERE 8 % (1 << time_bin) = 0")
def st05(t):
    """Lanes of the particles active at tick 8."""
    return stated(t.current_particles.where(F.lit(8) % F.expr("shiftleft(1, time_bin)") == 0).select("particle_id", "x", "y", "z", "mass"), "x", "y", "z", "mass")


@query("st06_active_cells", f"SELECT gas_cell_id, density, pressure FROM {CC} WHERE 8 % (1 << time_bin) = 0")
def st06(t):
    return t.current_cells.where(F.lit(8) % F.expr("shiftleft(1, time_bin)") == 0).select("gas_cell_id", "density", "pressure")


@query("st10_fof_species", f"SELECT species_tag, count(*) AS n FROM {CP} WHERE species_tag IN (0, 1, 2) GROUP BY 1")
def st10(t):
    """Species that take part in group finding: dark matter always, gas and stars by flag, tracers never."""
    return t.current_particles.where(F.col("species_tag").isin(0, 1, 2)).groupBy("species_tag").agg(F.count("*").alias("n"))


@query("st12_ownership_checks", f"""
SELECT 'duplicate_particle' AS check_name, count(*) AS n_bad FROM (SELECT particle_id FROM particles GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_cell', count(*) FROM (SELECT gas_cell_id FROM cells GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'non_positive_id', count(*) FROM particles WHERE particle_id <= 0
UNION ALL SELECT 'tracer_without_particle', count(*) FROM {CT} t WHERE NOT EXISTS (SELECT 1 FROM particles p WHERE p.particle_id = t.particle_id)
UNION ALL SELECT 'tracer_of_other_species', count(*) FROM {CT} t JOIN {CP} p USING (particle_id) WHERE p.species_tag <> 4""")
def st12(t):
    """Ownership invariants as counts of violations."""
    one = S.ownership_checks(t.current_particles, t.current_cells, t.current_tracers).where("check_name LIKE 'tracer%'")
    return S.ownership_checks(t.particles, t.cells, t.current_tracers).where("check_name NOT LIKE 'tracer%'").unionByName(one)


@query("st14_cell_identity", f"SELECT patch_id, count(*) AS n_cells, count(parent_particle_id) AS n_with_parent, min(gas_cell_id) AS first_cell, max(gas_cell_id) AS last_cell FROM {CC} GROUP BY 1")
def st14(t):
    """The identity map by patch."""
    return t.current_cells.groupBy("patch_id").agg(F.count("*").alias("n_cells"), F.count("parent_particle_id").alias("n_with_parent"), F.min("gas_cell_id").alias("first_cell"), F.max("gas_cell_id").alias("last_cell"))


@query("st15_row_remap", f"""
WITH o AS (SELECT gas_cell_id, row_number() OVER (ORDER BY gas_cell_id) - 1 AS old_row FROM {CC}), n AS (SELECT gas_cell_id, row_number() OVER (ORDER BY patch_id NULLS FIRST, gas_cell_id) - 1 AS new_row FROM {CC} WHERE removed_step IS NULL)
SELECT gas_cell_id, old_row, new_row FROM o FULL JOIN n USING (gas_cell_id)""")
def st15(t):
    """Old and new rows of cells after removal and a new order."""
    from nebulith.operators.skew import stitched

    c = t.current_cells.select("gas_cell_id", "patch_id", "removed_step").withColumn("_all", F.lit(0))
    old = stitched(c, ["_all"], ["gas_cell_id"]).select("gas_cell_id", (F.col("_rn") - 1).cast("long").alias("row"))
    new = stitched(c.where("removed_step IS NULL"), ["_all"], ["patch_id", "gas_cell_id"]).select("gas_cell_id", (F.col("_rn") - 1).cast("long").alias("row"))
    return S.row_remap(old, new, "gas_cell_id", "row")


@query("st16_sidecar_required", f"SELECT particle_id, (22 >> species_tag) & 1 = 1 AND ((flags & 1) <> 0 OR coalesce(mass >= 0.01, false)) AS required FROM {CP}")
def st16(t):
    """Species mask, and a flag or a threshold."""
    need = S.sidecar_required(F.col("species_tag"), F.col("flags"), F.when(~F.isnan("mass"), F.col("mass")), 22, 1, 0.01)
    return t.current_particles.select("particle_id", need.alias("required"))


@query("st17_wrap", f"SELECT particle_id, CASE WHEN x - 100 * floor(x / 100) >= 100 THEN 0 ELSE x - 100 * floor(x / 100) END AS x FROM {CP} WHERE isfinite(x)")
def st17(t):
    """Coordinates left outside the box, wrapped."""
    return t.current_particles.where(finite("x")).select("particle_id", S.periodic_wrap(F.col("x"), BOX).alias("x"))


@query("st18_minimum_image", f"SELECT particle_id, CASE WHEN d > 50 THEN d - 100 WHEN d < -50 THEN d + 100 ELSE d END AS dx FROM (SELECT c.gas_cell_id, p.particle_id, p.x - c.cx AS d FROM {CC} c JOIN {CP} p ON p.particle_id = c.parent_particle_id WHERE isfinite(p.x) AND isfinite(c.cx))")
def st18(t):
    """Offset of a particle from its cell by the nearest image."""
    j = t.current_cells.select("gas_cell_id", "cx", F.col("parent_particle_id").alias("particle_id")).join(t.current_particles.select("particle_id", "x"), "particle_id").where(finite("x", "cx"))
    return j.select("particle_id", S.minimum_image(F.col("x") - F.col("cx"), BOX).alias("dx"))


@query("st19_softening", f"SELECT particle_id, coalesce(softening, CASE species_tag WHEN 0 THEN 0.9 WHEN 1 THEN 0.45 WHEN 3 THEN 0.2 END, 0.5) AS softening FROM {CP}")
def st19(t):
    """Override, species default, global default."""
    return t.current_particles.select("particle_id", S.softening(F.col("softening"), F.col("species_tag"), {0: 0.9, 1: 0.45, 3: 0.2}, 0.5).alias("softening"))


@query("st20_gravity_sources", f"""
SELECT particle_id AS source, 'particle' AS kind, mass FROM {CP} p WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.parent_particle_id = p.particle_id) UNION ALL SELECT gas_cell_id, 'cell', mass FROM {CC}""")
def st20(t):
    """Authoritative gravity sources without double count."""
    return S.gravity_sources(t.current_particles.select("particle_id", "mass"), t.current_cells)


@query("jn01_sidecar_join", f"SELECT p.particle_id, p.mass, t.fraction, t.injection_step FROM {CP} p LEFT JOIN {CT} t USING (particle_id) WHERE p.species_tag = 4")
def jn01(t):
    """Tracer sidecars beside their particles."""
    p = t.current_particles.where("species_tag = 4").select("particle_id", "mass")
    return p.join(t.current_tracers.select("particle_id", "fraction", "injection_step"), "particle_id", "left")


@query("jn02_host_join", f"""
SELECT CASE WHEN t.tracer_host IS NULL OR t.tracer_host IN (0, 4294967295) THEN 'unbound' WHEN c.gas_cell_id IS NULL THEN 'invalid' ELSE 'bound' END AS state, count(*) AS n, round(sum(c.mass * t.fraction), 8) AS hosted_mass
FROM {CT} t LEFT JOIN {CC} c ON t.tracer_host = c.gas_cell_id GROUP BY 1""")
def jn02(t):
    """Tracers by the state of their host cell."""
    hosts = t.current_cells.select(F.col("gas_cell_id").alias("tracer_host"), F.col("mass").alias("host_mass"))
    joined = t.current_tracers.join(hosts.withColumn("found", F.lit(True)), "tracer_host", "left")
    state = F.when(F.col("tracer_host").isNull() | F.col("tracer_host").isin(0, 4294967295), "unbound").when(F.col("found").isNull(), "invalid").otherwise("bound")
    return rounded(joined.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.sum(F.col("host_mass") * F.col("fraction")).alias("hosted_mass")), hosted_mass=8)


@query("jn12_id_differences", """
WITH h AS (SELECT particle_id, count(*) AS n FROM particles_replica GROUP BY 1), w AS (SELECT DISTINCT particle_id FROM particles)
SELECT w.particle_id, 'missing' AS state FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.particle_id = w.particle_id)
UNION ALL SELECT particle_id, 'extra' FROM h WHERE NOT EXISTS (SELECT 1 FROM w WHERE h.particle_id = w.particle_id) UNION ALL SELECT particle_id, 'duplicate' FROM h WHERE n > 1""")
def jn12(t):
    """Missing, extra and duplicate ids."""
    return S.id_differences(t.particles_replica.select("particle_id"), t.particles.select("particle_id"), "particle_id")


@query("se02_migration_commit", f"""
WITH c AS (SELECT particle_id, owning_rank FROM {CP} WHERE owning_rank < 12), o AS (SELECT particle_id FROM c WHERE owning_rank = 3), i AS (SELECT particle_id, owning_rank FROM {CP} WHERE owning_rank = 15)
SELECT particle_id, owning_rank, 0 AS _order FROM c WHERE particle_id NOT IN (SELECT particle_id FROM o) UNION ALL SELECT particle_id, owning_rank, 1 FROM i""")
def se02(t):
    """Outbound rows leave, inbound rows are appended."""
    p = t.current_particles.select("particle_id", "owning_rank")
    c = p.where("owning_rank < 12")
    return S.commit_migration(c, c.where("owning_rank = 3"), p.where("owning_rank = 15"), "particle_id")


@query("se03_cell_migration", f"""
WITH c AS (SELECT gas_cell_id, patch_id, CASE WHEN gas_cell_id % 5 = 0 THEN gas_cell_id % 3 END AS ghost_epoch FROM {CC} WHERE patch_id < 8), i AS (SELECT gas_cell_id, patch_id, NULL AS ghost_epoch FROM {CC} WHERE patch_id = 9)
SELECT gas_cell_id, patch_id, 0 AS _order FROM c WHERE patch_id <> 2 AND (ghost_epoch IS NULL OR ghost_epoch = 1) UNION ALL SELECT gas_cell_id, patch_id, 1 FROM i""")
def se03(t):
    """The same for gas cells, without ghosts of another epoch."""
    c = t.current_cells.select("gas_cell_id", "patch_id").withColumn("ghost_epoch", F.when(F.col("gas_cell_id") % 5 == 0, F.col("gas_cell_id") % 3))
    mine, inbound = c.where("patch_id < 8"), c.where("patch_id = 9").withColumn("ghost_epoch", F.lit(None).cast("long"))
    return S.commit_migration(mine, mine.where("patch_id = 2"), inbound, "gas_cell_id", 1).drop("ghost_epoch")


@query("se05_set_difference", "SELECT particle_id FROM particles EXCEPT SELECT particle_id FROM particles_replica")
def se05(t):
    return t.particles.select("particle_id").subtract(t.particles_replica.select("particle_id"))


@query("se06_sorted_unique", "SELECT DISTINCT owner_rank FROM pm_ownership ORDER BY owner_rank")
def se06(t):
    return t.pm_ownership.select("owner_rank").distinct().orderBy("owner_rank")


@query("se01_union_members", f"SELECT 'particle' AS member, particle_id AS id, snap_step FROM {CP} UNION ALL SELECT 'cell', gas_cell_id, snap_step FROM {CC} UNION ALL SELECT 'ghost', ghost_id, snap_step FROM {CG}")
def se01(t):
    """Members of a state appended; ids are stable, so no row offsets need fixing."""
    p = t.current_particles.select(F.lit("particle").alias("member"), F.col("particle_id").alias("id"), "snap_step")
    c = t.current_cells.select(F.lit("cell").alias("member"), F.col("gas_cell_id").alias("id"), "snap_step")
    return p.unionByName(c).unionByName(t.current_amr_ghosts.select(F.lit("ghost").alias("member"), F.col("ghost_id").alias("id"), "snap_step"))
