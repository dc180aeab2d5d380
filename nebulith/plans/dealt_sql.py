"""SQL twins of the pN_ queries of the core."""

from __future__ import annotations

from nebulith.functions.unit_text import SPELLINGS

_REF = """
WITH target AS (
  SELECT 'particle' AS kind, particle_id AS k, CASE WHEN count(removed_step) = count(*) THEN max(removed_step) END AS removed_at, min(ingested_at) AS first_seen FROM particles GROUP BY particle_id
  UNION ALL
  SELECT 'cell', gas_cell_id, CASE WHEN count(removed_step) = count(*) THEN max(removed_step) END, min(ingested_at) FROM cells GROUP BY gas_cell_id),
ref AS (
  SELECT 'tracers' AS ref_table, 'tracer_parent' AS ref_field, particle_id AS ref_id, snap_step, 'particle' AS kind, tracer_parent AS k, ingested_at FROM tracers
  UNION ALL SELECT 'tracers', 'tracer_host', particle_id, snap_step, 'cell', tracer_host, ingested_at FROM tracers
  UNION ALL SELECT 'amr_ghosts', 'source_gas_cell_id', ghost_id, snap_step, 'cell', source_gas_cell_id, ingested_at FROM amr_ghosts),
state AS (
  SELECT ref_table, ref_field, ref_id, snap_step,
    CASE WHEN t.k IS NULL THEN 'missing' WHEN removed_at <= snap_step THEN 'deleted' WHEN first_seen > ref.ingested_at THEN 'late' ELSE 'valid' END AS state
  FROM ref LEFT JOIN target t ON ref.kind = t.kind AND ref.k = t.k
  WHERE ref.k IS NOT NULL AND ref.k NOT IN (0, 4294967295))
"""

_SAME = "(a.{c} IS NOT DISTINCT FROM b.{c} OR (isfinite(CAST(a.{c} AS DOUBLE)) AND isfinite(CAST(b.{c} AS DOUBLE)) AND abs(a.{c} - b.{c}) <= 1e-9 * greatest(abs(a.{c}), abs(b.{c}))) IS TRUE)"
_DIFF_COLUMNS = ("snap_step", "species_tag", "x", "y", "z", "vx", "vy", "vz", "mass", "time_bin")

_CANON = """
WITH file AS (SELECT DISTINCT source_file_index, run_name, written_at FROM ic_files WHERE run_name IS NOT NULL),
pos AS (SELECT *, row_number() OVER w AS ord, lag(source_file_index) OVER w AS prev_file, count(*) OVER (PARTITION BY run_name) AS n_files
        FROM file WINDOW w AS (PARTITION BY run_name ORDER BY written_at, source_file_index)),
canon AS (SELECT DISTINCT source_file_index, field_lane AS lane, trim(regexp_replace(lower(trim(dataset_path)), '/+', '/', 'g'), '/') AS path,
  CASE WHEN regexp_matches(lower(scalar_type), '^(h5t_ieee_f|[<>]?f[0-9]|float|double)') THEN 'float' WHEN regexp_matches(lower(scalar_type), '^(h5t_std_u|[<>]?u)') THEN 'unsigned' ELSE 'signed' END || ':' ||
  CASE WHEN lower(scalar_type) IN ('double', 'long') OR regexp_matches(lower(scalar_type), '64|[<>].8') THEN '8' ELSE '4' END AS type
  FROM ic_fields)
"""

_CASTS = _CANON + """, f AS (SELECT canon.*, run_name, ord FROM canon JOIN pos USING (source_file_index)),
latest AS (SELECT run_name, lane, arg_max(path, (ord, path)) AS unified FROM f WHERE lane IS NOT NULL GROUP BY ALL),
alias AS (SELECT run_name, path, max(unified) AS unified FROM (SELECT DISTINCT run_name, lane, path FROM f) JOIN latest USING (run_name, lane) GROUP BY ALL),
named AS (SELECT f.*, coalesce(unified, path) AS field FROM f LEFT JOIN alias USING (run_name, path)),
holds AS (SELECT run_name, field, CASE WHEN bool_or(type LIKE 'float%') THEN 'double' WHEN bool_or(type = 'unsigned:8') THEN 'decimal(20,0)' ELSE 'bigint' END AS cast_to FROM named GROUP BY ALL)
"""

#: Spelled units as numerator and denominator, for the twin of the unit rules: one pattern per mark instead of a parser.
_NAMES = ", ".join(f"('{n}', '{u}', NULL)" for n, u in sorted(SPELLINGS.items())) + ", ('kms', 'km', 's'), ('ms', 'm', 's'), ('cms', 'cm', 's'), ('kpcgyr', 'kpc', 'Gyr')"
_SI = f"""
WITH name(name, over, under) AS (VALUES {_NAMES}),
base AS (SELECT name, o.si_value / coalesce(u.si_value, 1) AS si FROM name JOIN base_units o ON o.symbol = over LEFT JOIN base_units u ON u.symbol = under WHERE under IS NULL OR u.symbol IS NOT NULL),
once AS (SELECT reading_id, particle_id, quantity, source_file_index, dataset_path, max(CASE WHEN NOT isnan(stored_value) THEN stored_value END) AS stored, max(stored_text) AS text FROM field_readings GROUP BY ALL),
split AS (SELECT *, regexp_extract(text, '^\\s*([-+]?[0-9.,]*[0-9][0-9.,]*([eE][-+]?[0-9]+)?)', 1) AS digits, nullif(trim(regexp_replace(text, '^\\s*[-+]?[0-9.,]*[0-9][0-9.,]*([eE][-+]?[0-9]+)?', ''), ' \t'), '') AS unit FROM once),
num AS (SELECT *, CASE WHEN stored IS NOT NULL THEN stored WHEN strpos(digits, '.') > strpos(digits, ',') OR digits NOT LIKE '%,%' THEN TRY_CAST(replace(digits, ',', '') AS DOUBLE) ELSE TRY_CAST(replace(replace(digits, '.', ''), ',', '.') AS DOUBLE) END AS number FROM split),
field AS (SELECT source_file_index, dataset_path, max(CASE WHEN NOT isnan(base_unit_to_si) THEN base_unit_to_si END) AS factor, max(CASE WHEN NOT isnan(hubble_exponent) THEN hubble_exponent END) AS hx,
  max(CASE WHEN NOT isnan(scale_factor_exponent) THEN scale_factor_exponent END) AS ax, max(source_unit) AS source_unit FROM ic_fields GROUP BY ALL),
file AS (SELECT source_file_index, max(hubble_param) AS h, max(scale_factor) AS a FROM ic_files GROUP BY ALL),
texts AS (SELECT source_unit AS text FROM field UNION SELECT unit FROM num),
t1 AS (SELECT text, regexp_replace(regexp_replace(regexp_replace(lower(text), '[][{{}}]', '', 'g'), 'sqrt *\\( *a *\\)', ' a^0.5 ', 'g'), 'solar[ _]+mass(es)?', 'msun', 'g') AS t FROM texts WHERE text IS NOT NULL),
t2 AS (SELECT text, ' ' || regexp_replace(t, '[*()·×]', ' ', 'g') || ' ' AS t FROM t1),
marks AS (SELECT text, t, CASE WHEN regexp_matches(t, '/ *h[^a-z]|[^a-z]h *\\^?-1') THEN -1.0 ELSE 0.0 END AS h,
  CASE WHEN regexp_matches(t, '[^a-z]a *\\^?(0\\.5|1/2)') THEN 0.5 WHEN regexp_matches(t, '[^a-z]a[^a-z]') THEN 1.0 ELSE 0.0 END + CASE WHEN regexp_matches(t, 'comoving|cmv') THEN 1.0 ELSE 0.0 END
   + CASE WHEN regexp_matches(t, '[^a-z]c(k?m|cm|k?pc|mpc)[^a-z]') AND NOT regexp_matches(t, '[^a-z]cm[^a-z]') THEN 1.0 ELSE 0.0 END AS a FROM t2),
bare AS (SELECT *, CAST(coalesce(nullif(regexp_extract(t, '(1\\.0e|1e|10\\^) *\\+?([0-9]+)', 2), ''), '0') AS INT) AS ten,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(1\\.0e|1e|10\\^) *\\+?[0-9]+', ' ', 'g'), '/ *h([^a-z])|([^a-z])h *\\^?-1', '\\1\\2 ', 'g'), '[^a-z]a *(\\^?(0\\.5|1/2)|[^a-z0-9^])', ' ', 'g'), 'comoving|cmv|physical|proper|[^a-z_]', '', 'g') AS word FROM marks),
unit AS (SELECT text, h, a, pow(10.0, ten) * coalesce(n.si, c.si) AS base FROM bare LEFT JOIN base n ON n.name = word LEFT JOIN base c ON word[1] = 'c' AND c.name = word[2:] AND n.name IS NULL),
si AS (SELECT num.reading_id, particle_id, quantity, number * CASE WHEN own THEN ut.base ELSE coalesce(uf.base, factor) END * pow(fh, CASE WHEN own THEN ut.h ELSE coalesce(hx, uf.h, 0) END) * pow(file.a, CASE WHEN own THEN ut.a ELSE coalesce(ax, uf.a, 0) END) AS v
  FROM (SELECT num.*, stored IS NULL AND u.base IS NOT NULL AS own, u.base AS ubase FROM num LEFT JOIN unit u ON u.text = num.unit) num LEFT JOIN unit ut ON ut.text = num.unit
  LEFT JOIN field USING (source_file_index, dataset_path) LEFT JOIN unit uf ON uf.text = source_unit LEFT JOIN (SELECT source_file_index, h AS fh, a FROM file) file USING (source_file_index))
"""

SQL = {
    "p1_found": _SI + "SELECT particle_id, quantity FROM si WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY ALL HAVING max(v) - min(v) > 0.01 * greatest(abs(max(v)), abs(min(v)))",
    "p1_values": _SI.replace("SELECT num.reading_id,", "SELECT num.reading_id, CASE WHEN own THEN 'text' WHEN uf.base IS NOT NULL THEN 'named' WHEN factor IS NOT NULL THEN 'factor' END AS how,")
    + "SELECT reading_id, particle_id, quantity, v AS si_value, CASE WHEN v IS NULL THEN 'review' ELSE how END AS origin, CAST(NULL AS DOUBLE) AS confidence FROM si",
    "p2_found": f"""
WITH a AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM particles), b AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM particles_replica),
j AS (SELECT coalesce(a.particle_id, b.particle_id) AS particle_id, CASE WHEN a.particle_id IS NULL THEN ['missing_in_particles'] WHEN b.particle_id IS NULL THEN ['missing_in_replica'] ELSE
 list_filter([{", ".join(f"CASE WHEN NOT {_SAME.format(c=c)} THEN '{c}' END" for c in _DIFF_COLUMNS)}], lambda v: v IS NOT NULL) END AS diffs
 FROM a FULL JOIN b ON a.particle_id = b.particle_id)
SELECT DISTINCT particle_id, unnest(diffs) AS diff FROM j""",
    "p2_columns": "SELECT coalesce(a.column_name, b.column_name) AS column_name, CASE WHEN b.column_name IS NULL THEN 'particles' WHEN a.column_name IS NULL THEN 'replica' ELSE 'both' END AS side FROM (DESCRIBE particles) a FULL JOIN (DESCRIBE particles_replica) b ON a.column_name = b.column_name",
    "p3_found": """
WITH p AS (SELECT DISTINCT particle_id, snap_step, x - 100 * floor(x / 100) AS x, y - 100 * floor(y / 100) AS y, z - 100 * floor(z / 100) AS z
           FROM particles WHERE isfinite(x) AND isfinite(y) AND isfinite(z)),
g AS (SELECT *, CAST(floor(x / 0.5) AS INT) % 200 AS i, CAST(floor(y / 0.5) AS INT) % 200 AS j, CAST(floor(z / 0.5) AS INT) % 200 AS k FROM p),
o AS (SELECT unnest([-1, 0, 1]) AS o),
n AS (SELECT g.*, (i + a.o + 200) % 200 AS ni, (j + b.o + 200) % 200 AS nj, (k + c.o + 200) % 200 AS nk FROM g, o a, o b, o c)
SELECT DISTINCT n.particle_id AS particle_id_a, g.particle_id AS particle_id_b FROM n JOIN g
  ON n.snap_step = g.snap_step AND n.ni = g.i AND n.nj = g.j AND n.nk = g.k AND n.particle_id < g.particle_id
WHERE pow(least(abs(n.x - g.x), 100 - abs(n.x - g.x)), 2) + pow(least(abs(n.y - g.y), 100 - abs(n.y - g.y)), 2) + pow(least(abs(n.z - g.z), 100 - abs(n.z - g.z)), 2) <= 0.05 * 0.05""",
    "p5_found": _REF + "SELECT DISTINCT ref_table, ref_field, ref_id, snap_step FROM state WHERE state IN ('missing', 'deleted')",
    "p5_report": _REF + """, once AS (SELECT ref_table, ref_field, snap_step, ref_id, min(state) AS state FROM state GROUP BY ALL)
SELECT ref_table, ref_field, snap_step, count(*) AS n_refs, count(*) FILTER (state = 'missing') AS n_missing, count(*) FILTER (state = 'deleted') AS n_deleted, count(*) FILTER (state = 'late') AS n_late FROM once GROUP BY ALL""",
    "p6_found": """
SELECT 'cell_members' AS table_name, cell_key AS hot_key FROM cell_members WHERE cell_key IS NOT NULL GROUP BY cell_key HAVING count(*) >= 0.02 * (SELECT count(*) FROM cell_members)
UNION ALL SELECT 'pm_ownership', CAST(owner_rank AS BIGINT) FROM pm_ownership WHERE owner_rank IS NOT NULL GROUP BY owner_rank HAVING count(*) >= 0.02 * (SELECT count(*) FROM pm_ownership)""",
    "p6_cell_results": "SELECT cell_key, count(*) AS n_rows, min(local_index) AS first_index, max(local_index) AS last_index, CAST(sum(particle_id) AS BIGINT) AS id_sum FROM cell_members GROUP BY cell_key",
    "p6_cell_masses": """
WITH m AS (SELECT DISTINCT cell_key, snap_step, local_index, particle_id FROM cell_members), p AS (SELECT DISTINCT ON (particle_id) particle_id, CASE WHEN isfinite(mass) THEN mass END AS mass FROM particles)
SELECT cell_key, count(*) AS n_members, count(mass) AS n_masses, round(sum(mass), 6) AS mass FROM m LEFT JOIN p USING (particle_id) GROUP BY cell_key""",
    "p6_slab_widths": """
WITH s AS (SELECT DISTINCT owner_rank, decomposition_epoch, begin_x, end_x FROM pm_ownership)
SELECT *, row_number() OVER w AS slab_no, CAST(sum(end_x - begin_x) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_width FROM s WINDOW w AS (PARTITION BY owner_rank ORDER BY decomposition_epoch, begin_x, end_x)""",
    "p7_found": _CANON + """, f AS (SELECT canon.*, pos.run_name, pos.ord, pos.prev_file, pos.n_files FROM canon JOIN pos USING (source_file_index)),
m AS (SELECT b.source_file_index, b.lane AS lane, b.path AS path, b.type AS type, a.path AS old_path, a.type AS old_type, a.lane AS old_lane FROM f b JOIN f a
      ON b.prev_file = a.source_file_index AND (b.lane = a.lane OR ((b.lane IS NULL OR a.lane IS NULL) AND b.path = a.path)))
SELECT source_file_index, path AS dataset_path, 'renamed' AS change_kind FROM m WHERE path <> old_path
UNION SELECT source_file_index, path, 'retyped' FROM m WHERE type <> old_type
UNION SELECT source_file_index, path, 'added' FROM f WHERE prev_file IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m WHERE m.source_file_index = f.source_file_index AND m.path = f.path)
UNION SELECT p.source_file_index, a.path, 'removed' FROM f a JOIN pos p ON p.prev_file = a.source_file_index
  WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.source_file_index = p.source_file_index AND m.old_path = a.path)""",
    "p7_lifespans": _CANON + """, f AS (SELECT DISTINCT run_name, path, type, ord, n_files FROM canon JOIN pos USING (source_file_index)),
i AS (SELECT *, ord - row_number() OVER (PARTITION BY run_name, path, type ORDER BY ord) AS island FROM f)
SELECT run_name, path, type, min(ord) AS first_ord, max(ord) AS last_ord, min(ord) > 1 AS started, max(ord) < max(n_files) AS ended FROM i GROUP BY run_name, path, type, island""",
    "p7_casts": _CASTS + "SELECT DISTINCT run_name, path, field AS unified, cast_to FROM named JOIN holds USING (run_name, field)",
    "p7_consistent": _CASTS + """, once AS (SELECT row_id, source_file_index, particle_id, CASE WHEN json_valid(min(payload)) THEN min(payload) END AS payload FROM restart_rows GROUP BY ALL),
kv AS (SELECT row_id, source_file_index, particle_id, unnest(json_keys(payload)) AS key, payload FROM once),
v AS (SELECT row_id, source_file_index, particle_id, trim(regexp_replace(lower(trim(key)), '/+', '/', 'g'), '/') AS path, json_extract_string(payload, '$."' || key || '"') AS text FROM kv),
n AS (SELECT source_file_index, path, max(field) AS field, max(type) AS type, max(cast_to) AS cast_to FROM named JOIN holds USING (run_name, field) GROUP BY ALL),
t AS (SELECT row_id, source_file_index, particle_id, coalesce(field, path) AS field, type, coalesce(cast_to, 'double') AS cast_to, text FROM v LEFT JOIN n USING (source_file_index, path)),
c AS (SELECT *, CASE WHEN cast_to = 'double' THEN TRY_CAST(text AS DOUBLE) END AS as_double, CASE WHEN cast_to = 'bigint' THEN TRY_CAST(TRY_CAST(text AS DECIMAL(38,6)) AS BIGINT) END AS as_bigint,
  CASE WHEN cast_to = 'decimal(20,0)' THEN CAST(TRY_CAST(TRY_CAST(text AS DECIMAL(38,6)) AS DECIMAL(20,0)) AS VARCHAR) END AS as_decimal FROM t)
SELECT * EXCLUDE (text), text IS NOT NULL AND as_double IS NULL AND as_bigint IS NULL AND as_decimal IS NULL AS bad_cast FROM c""",
}
