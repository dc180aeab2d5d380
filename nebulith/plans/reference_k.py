"""Queries: small meshes checked by sums over all modes, sinks, codecs and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from nebulith.operators import gravity as G
from nebulith.operators.base import finite
from nebulith.operators.skew import stitched
from nebulith.plans.catalog import CP, query, rounded
from nebulith.runtime import Scratch
from nebulith.sources import config, products, snapshots

BOX, NEWTON = 100.0, 43.0
_P = f"p AS (SELECT particle_id AS item, x - 100 * floor(x / 100) AS x, y - 100 * floor(y / 100) AS y, z - 100 * floor(z / 100) AS z, mass FROM {CP} WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(mass))"


def _density_sql(n: int) -> str:
    w = lambda c, o: f"abs(1 - {o} - ({c} / 100 * {n} - floor({c} / 100 * {n})))"
    i = lambda c, o: f"(CAST(floor({c} / 100 * {n}) AS INT) + {o}) % {n}"
    return f"""{_P}, o AS (SELECT unnest([0, 1]) AS o),
m AS (SELECT {i('x', 'a.o')} AS ix, {i('y', 'b.o')} AS iy, {i('z', 'c.o')} AS iz, sum(mass * {w('x', 'a.o')} * {w('y', 'b.o')} * {w('z', 'c.o')}) / pow(100.0 / {n}, 3) AS rho FROM p, o a, o b, o c GROUP BY ALL),
g AS (SELECT CAST(a AS INT) AS ix, CAST(b AS INT) AS iy, CAST(c AS INT) AS iz FROM range({n}) r(a), range({n}) s(b), range({n}) t(c))"""


def _poisson_sql(n: int) -> str:
    signed = lambda c: f"CASE WHEN {c} < {n // 2} THEN {c} ELSE {c} - {n} END * 2 * pi() / 100"
    turn = "2 * pi() / {n} * (ix * nx + iy * ny + iz * nz)".format(n=n)
    f = lambda c: f"sum(CASE WHEN n{c} = {n // 2} THEN 0 ELSE k{c} END * (pi_ * cos({turn}) + pr * sin({turn}))) / {n**3} AS f{c}"
    return f"""{_density_sql(n)}, k AS (SELECT ix AS nx, iy AS ny, iz AS nz, {signed('ix')} AS kx, {signed('iy')} AS ky, {signed('iz')} AS kz FROM g),
d AS (SELECT nx, ny, nz, kx, ky, kz, sum(rho * cos({turn})) AS re, -sum(rho * sin({turn})) AS im FROM k, m GROUP BY ALL),
q AS (SELECT *, -4 * pi() * {NEWTON} / (kx * kx + ky * ky + kz * kz) * re AS pr, -4 * pi() * {NEWTON} / (kx * kx + ky * ky + kz * kz) * im AS pi_ FROM d WHERE nx + ny + nz > 0),
mesh AS (SELECT ix, iy, iz, sum(pr * cos({turn}) - pi_ * sin({turn})) / {n**3} AS phi, {f('x')}, {f('y')}, {f('z')} FROM g, q GROUP BY ALL)"""


def gathered_sql(n: int, values: tuple[str, ...], digits: int) -> str:
    """Mesh values at the particles, from the potential by sums over all modes."""
    w = lambda c, o: f"abs(1 - {o} - ({c} / 100 * {n} - floor({c} / 100 * {n})))"
    on = " AND ".join(f"i{c} = (CAST(floor({c} / 100 * {n}) AS INT) + {o}.o) % {n}" for c, o in zip("xyz", "abc"))
    return f"WITH {_poisson_sql(n)} SELECT item, {', '.join(f'round(sum({v} * {w(chr(120), chr(97) + chr(46) + chr(111))} * {w(chr(121), chr(98) + chr(46) + chr(111))} * {w(chr(122), chr(99) + chr(46) + chr(111))}), {digits}) AS {v}' for v in values)} FROM p, o a, o b, o c JOIN mesh ON {on} GROUP BY item"


def isolated_sql(n: int) -> str:
    """Potential by all pairs of mesh points, forces by differences."""
    h = BOX / n

    def force(c: str) -> str:
        w = f"OVER (PARTITION BY {', '.join(f'i{o}' for o in 'xyz' if o != c)} ORDER BY i{c})"
        return f"round(-CASE WHEN i{c} = 0 THEN -3 * phi + 4 * lead(phi) {w} - lead(phi, 2) {w} WHEN i{c} = {n - 1} THEN 3 * phi - 4 * lag(phi) {w} + lag(phi, 2) {w} ELSE lead(phi) {w} - lag(phi) {w} END / {2 * h}, 5) AS f{c}"

    return f"""WITH {_density_sql(n)}, f AS (SELECT g.ix, g.iy, g.iz, -{NEWTON} * {h**3} * sum(CASE WHEN g.ix = m.ix AND g.iy = m.iy AND g.iz = m.iz THEN 0 ELSE rho / sqrt(pow(g.ix - m.ix, 2) + pow(g.iy - m.iy, 2) + pow(g.iz - m.iz, 2)) END) / {h} AS phi FROM g, m GROUP BY ALL)
SELECT ix, iy, iz, round(phi, 5) AS phi, {force('x')}, {force('y')}, {force('z')} FROM f"""


def _points(t):
    p = t.current_particles.where(finite("x", "y", "z", "mass"))
    return p.select(F.col("particle_id").alias("item"), *[(F.col(c) - 100 * F.floor(F.col(c) / 100)).alias(c) for c in "xyz"], "mass")


@query("gr06_poisson_small", f"WITH {_poisson_sql(8)} SELECT ix, iy, iz, round(phi, 5) AS phi, round(fx, 6) AS fx, round(fy, 6) AS fy, round(fz, 6) AS fz FROM mesh")
def gr06(t):
    """Potential and forces of the periodic Poisson equation on an 8³ mesh."""
    return rounded(G.poisson_periodic(G.mesh_density(_points(t), 8, BOX), 8, BOX, NEWTON), phi=5, fx=6, fy=6, fz=6)


@query("gr10_mesh_small", gathered_sql(8, ("fx", "fy", "fz"), 6))
def gr10(t):
    """Assign, solve and interpolate on an 8³ mesh."""
    return rounded(G.mesh_acceleration(_points(t), 8, BOX, NEWTON), fx=6, fy=6, fz=6)


@query("io05_chunk_decode", f"WITH r AS (SELECT species_tag, particle_id, (row_number() OVER (PARTITION BY species_tag ORDER BY particle_id) - 1) // 1000 AS chunk FROM {CP}) SELECT species_tag, chunk, count(*) AS n, min(particle_id) AS first_id, max(particle_id) AS last_id FROM r GROUP BY 1, 2")
def io05(t):
    """Records of each species read in chunks of a thousand: what every chunk holds."""
    rows = stitched(t.current_particles.select("species_tag", "particle_id"), ["species_tag"], ["particle_id"])
    chunks = rows.withColumn("chunk", F.floor((F.col("_rn") - 1) / 1000).cast("long"))
    return chunks.groupBy("species_tag", "chunk").agg(F.count("*").alias("n"), F.min("particle_id").alias("first_id"), F.max("particle_id").alias("last_id"))


@query("io24_publish", f"SELECT count(*) AS n, bit_xor(particle_id) AS id_xor FROM {CP}")
def io24(t):
    """A table written beside its place and renamed into it, replacing what was there."""
    base = Scratch(t.spark, "publish").base
    for part in (t.current_particles.limit(0), t.current_particles):
        part.select("particle_id").write.parquet(f"{base}/new")
        snapshots.publish(t.spark, f"{base}/new", f"{base}/final")
    return t.spark.read.parquet(f"{base}/final").agg(F.count("*").alias("n"), F.bit_xor("particle_id").alias("id_xor"))


def _merger_sql() -> str:
    from nebulith.plans.catalog import SQL

    return SQL["jn10_merger_nodes"]


@query("io26_merger_plan", _merger_sql())
def io26(t):
    """The merger plan written as JSON lines and read back."""
    from nebulith.plans.reference_c import jn10

    nodes = jn10(t)
    path = Scratch(t.spark, "mergers").base
    products.write_catalogue(nodes, path)
    return products.read_catalogue(t.spark, path, nodes.schema)


@query("io28_report", "SELECT 'particles' AS stage, count(*) AS n_rows FROM particles UNION ALL SELECT 'cells', count(*) FROM cells UNION ALL SELECT 'events', count(*) FROM events")
def io28(t):
    """A report of operational events as JSON lines, written and read back."""
    counts = [{"stage": s, "n_rows": df.count()} for s, df in (("particles", t.particles), ("cells", t.cells), ("events", t.events))]
    path = f"{Scratch(t.spark, 'report').base}/report.jsonl"
    snapshots._write_text(t.spark, path, products.report(counts))
    return t.spark.read.schema("stage string, n_rows long").json(path)


CONFIG = """# a run
[box]
size = 100   ; in Mpc
[solver]
assignment "cic"
boundary = periodic
"""


@query("io29_config", "SELECT * FROM (VALUES ('box.size', '100'), ('solver.assignment', '\"cic\"'), ('solver.boundary', 'periodic')) v(key, value)")
def io29(t):
    """Keys and values of a configuration text with comments, sections and both forms of assignment."""
    return t.spark.createDataFrame(sorted(config.parse(CONFIG).items()), "key string, value string")


@query("fn27_fnv1a", """SELECT DISTINCT run_name, CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(run_name, ''), lambda c: ascii(c)::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS VARCHAR) AS hash FROM ic_files WHERE run_name IS NOT NULL""")
def fn27(t):
    """64-bit hash of every run's name."""
    return t.ic_files.where("run_name IS NOT NULL").select("run_name").distinct().withColumn("hash", config.fnv1a_column(F.col("run_name")))


@query("fn29_text_codec", r"""SELECT reading_id, max(replace(replace(replace(replace(stored_text, '\', '\\'), chr(10), '\n'), chr(9), '\t'), chr(13), '\r')) AS escaped, true AS restored FROM field_readings WHERE stored_text IS NOT NULL GROUP BY reading_id""")
def fn29(t):
    """Texts escaped to one line and restored."""
    texts = t.field_readings.where("stored_text IS NOT NULL").groupBy("reading_id").agg(F.max("stored_text").alias("text"))
    escaped = texts.withColumn("escaped", config.escape_column(F.col("text")))
    return escaped.select("reading_id", "escaped", (config.unescape_column(F.col("escaped")) == F.col("text")).alias("restored"))


@query("fn31_enum_parse", "SELECT lower(trim(fill_status)) AS status, count(*) AS n FROM amr_ghosts GROUP BY 1")
def fn31(t):
    """Fill states parsed whatever their letter case; an unknown one is an error."""
    return t.amr_ghosts.groupBy(config.enum_column(config.FillStatus, F.col("fill_status")).alias("status")).agg(F.count("*").alias("n"))
