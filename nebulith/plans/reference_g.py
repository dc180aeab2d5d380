"""Queries: sources, sinks and streaming twins. Written products go to the shared scratch folder and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from nebulith.operators.base import finite
from nebulith.plans.catalog import CC, CP, query, rounded, stated, stated_sql
from nebulith.runtime import Scratch
from nebulith.sources import products as R
from nebulith.sources import snapshots as S
from nebulith.streaming import twins

_REC = "particle_id, snap_step, species_tag, x, y, z, vx, vy, vz, mass"


def _particles(t):
    return t.current_particles.select(*[c.strip() for c in _REC.split(",")])


@query("io01_generated_state", "SELECT i + 1 AS particle_id, 1 AS species_tag, (i + 0.5) / 40 * 100.0 AS x, 50.0 AS y FROM range(40) r(i) UNION ALL SELECT i + 41, 0, (i + 0.5) / 1600 * 100.0, 25.0 FROM range(1600) r(i)")
def io01(t):
    """Deterministic lines of gas and dark matter."""
    return S.generated_axis(t.spark, 40, 100.0).select("particle_id", "species_tag", "x", "y")


@query("io06_species_routing", f"SELECT species_tag, count(*) AS n, round(sum(mass) FILTER (isfinite(mass)), 7) AS mass FROM {CP} GROUP BY 1")
def io06(t):
    """Records routed to their species' tables and counted there."""
    from nebulith.operators.state import species_tables

    out = None
    for df in species_tables(_particles(t)).values():
        c = df.groupBy("species_tag").agg(F.count("*").alias("n"), F.sum(F.when(finite("mass"), F.col("mass"))).alias("mass"))
        out = c if out is None else out.unionByName(c)
    return rounded(out, mass=7)


@query("io07_field_conversion", """WITH f AS (SELECT DISTINCT f.source_file_index, dataset_path, base_unit_to_si AS base, coalesce(hubble_exponent, 0) AS hx, coalesce(scale_factor_exponent, 0) AS ax, length_power AS lp, mass_power AS mp, time_power AS tp, hubble_param AS h, scale_factor AS a
 FROM ic_fields f JOIN ic_files g USING (source_file_index) WHERE base_unit_to_si > 0)
SELECT source_file_index, dataset_path, round(log10(base * pow(h, hx) * pow(a, ax) * CASE WHEN tp = -1 THEN 1 / sqrt(a) ELSE 1 END / (pow(3e19, lp) * pow(2e40, mp) * pow(3e16, tp))), 9) + 0.0 AS log_multiplier FROM f""")
def io07(t):
    """Stored values to code units, as the logarithm of the multiplier."""
    files = t.ic_files.select("source_file_index", F.col("hubble_param").alias("h"), F.col("scale_factor").alias("a")).distinct()
    f = t.ic_fields.where("base_unit_to_si > 0").select("source_file_index", "dataset_path", F.col("base_unit_to_si").alias("base"), F.coalesce("hubble_exponent", F.lit(0.0)).alias("hx"), F.coalesce("scale_factor_exponent", F.lit(0.0)).alias("ax"), F.col("length_power").alias("lp"), F.col("mass_power").alias("mp"), F.col("time_power").alias("tp")).distinct()
    m = S.conversion_multiplier({"length": 3e19, "mass": 2e40, "time": 3e16}, convention=F.when(F.col("tp") == -1, "sqrt_a"))
    return rounded(f.join(files, "source_file_index").select("source_file_index", "dataset_path", F.log10(m).alias("log_multiplier")), log_multiplier=9)


@query("io08_manifest_round_trip", "SELECT DISTINCT source_file_index, hubble_param, scale_factor, dataset_path, scalar_type, base_unit_to_si FROM ic_fields JOIN (SELECT DISTINCT source_file_index, hubble_param, scale_factor FROM ic_files) USING (source_file_index)")
def io08(t):
    """Manifests written as JSON and read back into their fields."""
    back = R.manifest_fields(R.manifests(t.ic_files, t.ic_fields))
    return back.select("source_file_index", "hubble_param", "scale_factor", "dataset_path", "scalar_type", "base_unit_to_si").distinct()


@query("io09_file_set", """WITH f AS (SELECT DISTINCT source_file_index, lower(trim(dataset_path)) AS p, selected_alias FROM ic_fields)
SELECT run_name, count(DISTINCT source_file_index) AS n_files, count(DISTINCT box_size) AS n_boxes, count(DISTINCT restart_schema_version) AS n_versions, count(DISTINCT selected_alias) AS n_aliases FROM ic_files g LEFT JOIN f USING (source_file_index) GROUP BY run_name""")
def io09(t):
    """Members, headers and aliases per file set."""
    f = t.ic_fields.select("source_file_index", "selected_alias").distinct()
    return t.ic_files.join(f, "source_file_index", "left").groupBy("run_name").agg(
        F.countDistinct("source_file_index").alias("n_files"), F.countDistinct("box_size").alias("n_boxes"), F.countDistinct("restart_schema_version").alias("n_versions"), F.countDistinct("selected_alias").alias("n_aliases")
    )


@query("io10_missing_fields", f"SELECT particle_id, coalesce(softening, 0.5) AS softening, CAST(NULL AS DOUBLE) AS metallicity, coalesce(mass, softening) AS mass FROM {CP}")
def io10(t):
    """Policies for missing fields: a default, another column, a null column."""
    p = t.current_particles.select("particle_id", "softening", "mass")
    out = S.fill_missing(p, {"mass": ("column", "softening"), "softening": ("default", 0.5), "metallicity": ("keep", None)})
    return out.select("particle_id", "softening", "metallicity", "mass")


@query("io11_record_validation", f"""WITH r AS (SELECT particle_id, list_filter([CASE WHEN NOT coalesce(isfinite(x) AND x BETWEEN -1e-10 AND 100.0000000001 AND isfinite(y) AND y BETWEEN -1e-10 AND 100.0000000001 AND isfinite(z) AND z BETWEEN -1e-10 AND 100.0000000001, false) THEN 'position' END,
 CASE WHEN NOT coalesce(isfinite(vx) AND isfinite(vy) AND isfinite(vz), false) THEN 'velocity' END, CASE WHEN NOT coalesce(isfinite(mass) AND mass > 0, false) THEN 'mass' END], lambda v: v IS NOT NULL) AS p FROM {CP}) SELECT particle_id, unnest(p) AS problem FROM r""")
def io11(t):
    """Records that fail the scientific checks, with what fails."""
    return _particles(t).select("particle_id", F.explode(S.record_problems(100.0)).alias("problem"))


@query("io12_chunk_audit", """WITH s AS (SELECT DISTINCT decomposition_epoch AS source, begin_x AS b, end_x AS e FROM pm_ownership), g AS (SELECT b - lag(e) OVER (PARTITION BY source ORDER BY b, e) AS gap FROM s), d AS (SELECT particle_id FROM particles GROUP BY 1 HAVING count(*) > 1)
SELECT 'gap' AS problem, count(*) FILTER (gap > 0) AS n FROM g UNION ALL SELECT 'overlap', count(*) FILTER (gap < 0) FROM g UNION ALL SELECT 'duplicate', count(*) FROM d""")
def io12(t):
    """Coverage of chunks and duplicate ids."""
    chunks = t.pm_ownership.select(F.col("decomposition_epoch").alias("source"), F.col("begin_x").alias("begin"), F.col("end_x").alias("end")).distinct()
    return S.chunk_audit(chunks, t.particles, "particle_id")


def _written(t):
    path = Scratch(t.spark, "snapshot").base
    S.write_snapshot(_particles(t).drop("snap_step"), path, {"box": 100.0, "step": 1})
    return path


@query("io16_snapshot_round_trip", f"SELECT particle_id, species_tag, {stated_sql('x', 'vx', 'mass')}, [1, 0, 4, 5, 3][species_tag + 1] AS part_type FROM {CP}")
def io16(t):
    """A snapshot written by part type, published, verified and read back."""
    return stated(S.read_snapshot(t.spark, _written(t), verify=True).select("particle_id", "species_tag", "x", "vx", "mass", "part_type"), "x", "vx", "mass")


@query("io17_mass_table", f"SELECT particle_id, coalesce(mass, CASE species_tag WHEN 0 THEN 0.0371 WHEN 2 THEN 0.002 END) AS mass FROM {CP}")
def io17(t):
    """Masses from the header's table where they are missing."""
    return S.read_snapshot(t.spark, _written(t), masses={1: 0.0371, 4: 0.002, 5: 0.0}).select("particle_id", "mass")


@query("io18_part_types", "SELECT species_tag, [1, 0, 4, 5, 3][species_tag + 1] AS part_type, count(*) AS n FROM particles GROUP BY 1, 2")
def io18(t):
    """Part types of the species."""
    return t.particles.select("species_tag", S.part_type(F.col("species_tag")).alias("part_type")).groupBy("species_tag", "part_type").agg(F.count("*").alias("n"))


@query("io19_snapshot_set", f"SELECT snap_step % 2 AS member, count(*) AS n, bit_xor(particle_id) AS id_xor FROM (SELECT particle_id, CASE WHEN snap_step % 80 = 0 THEN 0 ELSE 1 END AS snap_step FROM {CP}) GROUP BY 1")
def io19(t):
    """Two members of one set appended in order."""
    base = Scratch(t.spark, "set").base
    p = _particles(t).withColumn("m", F.when(F.col("snap_step") % 80 == 0, 0).otherwise(1)).drop("snap_step")
    for i in (0, 1):
        S.write_snapshot(p.where(F.col("m") == i).drop("m"), f"{base}/{i}", {"box": 100.0, "step": 7})
    return S.read_set(t.spark, [f"{base}/0", f"{base}/1"]).groupBy("member").agg(F.count("*").alias("n"), F.bit_xor("particle_id").alias("id_xor"))


@query("io20_member_hashes")
def io20(t):
    """Hashes of the written members; their bytes aren't the same from run to run."""
    return S.member_hashes(t.spark, _written(t))


@query("io21_snapshot_validator", "SELECT count(*) AS n, count(DISTINCT particle_id) AS n_ids, count(*) FILTER (NOT coalesce(isfinite(x) AND isfinite(y) AND isfinite(z), false)) AS bad_position, count(*) FILTER (NOT coalesce(isfinite(vx) AND isfinite(vy) AND isfinite(vz), false)) AS bad_velocity, count(*) FILTER (NOT coalesce(isfinite(mass) AND mass > 0, false)) AS bad_mass, count(*) FILTER (particle_id = 0) AS zero_id FROM particles")
def io21(t):
    """One-pass validation of a snapshot."""
    return S.validate(t.particles)


@query("io22_restart_round_trip", f"SELECT 'particles' AS state, count(*) AS n, bit_xor(particle_id) AS id_xor FROM {CP} UNION ALL SELECT 'cells', count(*), bit_xor(gas_cell_id) FROM {CC}")
def io22(t):
    """A full state written with digests and read back after they were compared."""
    path = Scratch(t.spark, "restart").base
    S.write_restart({"particles": t.current_particles, "cells": t.current_cells}, path, 12, 0.5)
    tables, _ = S.read_restart(t.spark, path)
    a = tables["particles"].agg(F.count("*").alias("n"), F.bit_xor("particle_id").alias("id_xor")).select(F.lit("particles").alias("state"), "n", "id_xor")
    return a.unionByName(tables["cells"].agg(F.count("*").alias("n"), F.bit_xor("gas_cell_id").alias("id_xor")).select(F.lit("cells").alias("state"), "n", "id_xor"))


@query("io25_catalogue_round_trip", f"SELECT patch_id AS halo_id, count(*) AS particle_count, min(gas_cell_id) AS min_particle_id FROM {CC} GROUP BY 1")
def io25(t):
    """A catalogue written as JSON lines and read back."""
    rows = t.current_cells.groupBy(F.col("patch_id").alias("halo_id")).agg(F.count("*").alias("particle_count"), F.min("gas_cell_id").alias("min_particle_id"))
    path = Scratch(t.spark, "catalogue").base
    R.write_catalogue(rows, path)
    return R.read_catalogue(t.spark, path, rows.schema)


@query("io27_bundle_retention", "WITH s AS (SELECT event_id AS step, CASE WHEN event_id % 64 = 0 THEN 'heavy' WHEN event_id % 8 = 0 THEN 'light' ELSE 'health' END AS class FROM events) SELECT class, step FROM s QUALIFY row_number() OVER (PARTITION BY class ORDER BY step DESC) <= 16")
def io27(t):
    """The newest sixteen bundles of each class."""
    s = t.events.select(F.col("event_id").alias("step"), F.when(F.col("event_id") % 64 == 0, "heavy").when(F.col("event_id") % 8 == 0, "light").otherwise("health").alias("class"))
    return R.retained(s, 16).select("class", "step")


@query("io30_yield_table", "SELECT * FROM (VALUES (0.0, 0.0), (3.0e6, 0.02), (1.0e7, 0.10), (1.0e8, 0.18), (1.0e9, 0.28), (5.0e9, 0.34), (1.4e10, 0.40)) v(age, returned)")
def io30(t):
    """A number table written as text and scanned."""
    from nebulith.operators.tables import SSP_ROWS

    path = Scratch(t.spark, "table").base
    lines = ["# age returned", *[f"{r[0]!r}  {r[1]!r}" for r in SSP_ROWS]]
    t.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return R.read_number_table(t.spark, path, ["age", "returned"])


@query("io32_zoom_membership", f"SELECT particle_id, species_tag FROM {CP} WHERE particle_id IN (SELECT tracer_parent FROM tracers)")
def io32(t):
    """Particles named by a list of ids in a text file."""
    path = Scratch(t.spark, "ids").base
    t.tracers.where("tracer_parent IS NOT NULL").select(F.col("tracer_parent").cast("string").alias("value")).distinct().write.text(path)
    return R.zoom_members(t.current_particles, R.read_ids(t.spark, path)).select("particle_id", "species_tag")


@query("stream_windowed_activity", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream1(t):
    """Hourly windows over the event stream with a watermark, run to its end."""
    out = twins.run_to_end(twins.windowed_activity(twins.read_stream(t.spark, f"{t.d}/events.parquet"), "1 hour", "3650 days"), "complete", "windows")
    return rounded(out, total=4)


@query("stream_reconcile", "SELECT user_id AS element, min(CAST(floor(abs(value)) AS INT) % 7) AS bin, count(*) AS n_candidates FROM events GROUP BY 1")
def stream2(t):
    """Smallest candidate bin per element, as streaming state."""
    e = twins.read_stream(t.spark, f"{t.d}/events.parquet").select(F.col("user_id").alias("element"), F.pmod(F.floor(F.abs("value")).cast("int"), F.lit(7)).alias("bin"))
    return twins.run_to_end(twins.reconcile_stream(e), "complete", "reconcile")


@query("stream_transitions", """
WITH RECURSIVE e AS (SELECT user_id AS element, event_id AS tick, CAST(floor(abs(value)) AS INT) % 5 AS wanted, row_number() OVER (PARTITION BY user_id ORDER BY event_id, CAST(floor(abs(value)) AS INT) % 5) AS rn FROM events),
r AS (SELECT DISTINCT element, 0 AS tick, 0 AS rn, 0 AS old_bin, 0 AS new_bin FROM e
 UNION ALL SELECT e.element, e.tick, e.rn, r.new_bin, CASE WHEN wanted < r.new_bin OR wanted > r.new_bin AND e.tick % (1 << wanted) = 0 THEN wanted ELSE r.new_bin END FROM r JOIN e ON e.element = r.element AND e.rn = r.rn + 1)
SELECT element, tick, CAST(old_bin AS INT) AS old_bin, CAST(new_bin AS INT) AS new_bin FROM r WHERE old_bin <> new_bin""")
def stream3(t):
    """Bin transitions with the bin as state, applied in order of tick."""
    e = twins.read_stream(t.spark, f"{t.d}/events.parquet").select(F.col("user_id").alias("element"), F.col("event_id").alias("tick"), F.pmod(F.floor(F.abs("value")).cast("int"), F.lit(5)).alias("wanted"))
    return twins.run_to_end(twins.transition_stream(e), "append", "transitions")
