"""Snapshots, initial conditions and restarts as Parquet with headers, aliases, member hashes and a completion marker."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulith.operators.base import count_if, finite

SCHEMA_VERSION = 1
PART_TYPES = {0: 1, 1: 0, 3: 4, 4: 2, 5: 3}  # part type -> species tag (fixed): gas 0, dark matter 1, tracer 3, star 4, black hole 5
ALIASES = {
    "x": ("x", "pos_x", "coordinates_x", "position_x"), "y": ("y", "pos_y", "coordinates_y", "position_y"), "z": ("z", "pos_z", "coordinates_z", "position_z"),
    "vx": ("vx", "vel_x", "velocities_x"), "vy": ("vy", "vel_y", "velocities_y"), "vz": ("vz", "vel_z", "velocities_z"),
    "particle_id": ("particle_id", "particleids", "id", "ids"), "mass": ("mass", "masses"),
}
MARKER = "COMPLETE.json"


class SnapshotError(ValueError):
    pass


def part_type(species: Column) -> Column:
    """Part type of a species; an unknown species is an error at run time."""
    table = F.create_map(*[F.lit(v) for p, s in PART_TYPES.items() for v in (s, p)])
    return F.coalesce(table[species], F.raise_error(F.concat(F.lit("no part type for species "), species.cast("string"))).cast("int"))


def species_of(part: Column, mapping: dict[int, int] | None = None) -> Column:
    """Species of a part type. Part types 2 and 3 are ambiguous and need a mapping, except that own files have tracers in 3."""
    table = PART_TYPES | (mapping or {})
    return F.create_map(*[F.lit(v) for kv in sorted(table.items()) for v in kv])[part]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def publish(spark: SparkSession, temporary: str, final: str) -> None:
    """A finished folder renamed into place: readers see all of it or nothing. An existing one is replaced."""
    fs, path = _fs(spark, final)
    fs.delete(path(final), True)
    fs.mkdirs(path(final).getParent())
    if not fs.rename(path(temporary), path(final)):
        raise SnapshotError(f"{temporary} could not be published as {final}")


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, P = _fs(spark, path)
    out = fs.create(P(path), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())  # headers and markers: a few lines


def member_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(member, bytes, sha256) of the data files below a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("member"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def content_digest(df: DataFrame) -> dict[str, object]:
    """Rows and an order-independent digest of a table."""
    r = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x")).first()
    return {"rows": r["n"], "digest": r["x"] or 0, "schema": df.schema.json()}


def write_tables(tables: dict[str, DataFrame], path: str, header: dict[str, object]) -> None:
    """Tables of one state, a header, and a marker with counts and digests written last; the whole is published by one rename."""
    spark = next(iter(tables.values())).sparkSession
    temporary = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex[:8]}"
    marker: dict[str, object] = {"schema_version": SCHEMA_VERSION, "header": header, "tables": {}}
    for name, df in tables.items():
        df.write.parquet(f"{temporary}/{name}")
        marker["tables"][name] = content_digest(spark.read.parquet(f"{temporary}/{name}"))
    _write_text(spark, f"{temporary}/{MARKER}", json.dumps(marker, sort_keys=True))
    publish(spark, temporary, path)


def read_tables(spark: SparkSession, path: str, verify: bool = True) -> tuple[dict[str, DataFrame], dict[str, object]]:
    """The tables and the header. Without a marker, of another schema, or with contents that differ from it, this is an error."""
    fs, P = _fs(spark, path)
    if not fs.exists(P(f"{path}/{MARKER}")):
        raise SnapshotError(f"{path} is not complete")
    marker = json.loads(_read_text(spark, f"{path}/{MARKER}"))
    if marker["schema_version"] != SCHEMA_VERSION:
        raise SnapshotError(f"schema version {marker['schema_version']} is not supported")
    out = {name: spark.read.parquet(f"{path}/{name}") for name in marker["tables"]}
    if verify:
        for name, said in marker["tables"].items():
            if content_digest(out[name]) != said:
                raise SnapshotError(f"{name} differs from what was written")
    return out, marker["header"]


def write_snapshot(particles: DataFrame, path: str, header: dict[str, object]) -> None:
    """Particles partitioned by part type, so a reader of one species reads its files only."""
    spark = particles.sparkSession
    temporary = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex[:8]}"
    typed = particles.withColumn("part_type", part_type(F.col("species_tag")))
    typed.write.partitionBy("part_type").parquet(f"{temporary}/particles")
    back = spark.read.parquet(f"{temporary}/particles")
    counts = {str(r["part_type"]): r["count"] for r in back.groupBy("part_type").count().collect()}  # one row per part type
    said = {"schema_version": SCHEMA_VERSION, "header": header | {"counts": counts}, "tables": {"particles": content_digest(back)}}
    _write_text(spark, f"{temporary}/{MARKER}", json.dumps(said, sort_keys=True))
    publish(spark, temporary, path)


def resolve_aliases(df: DataFrame, required: tuple[str, ...] = tuple(ALIASES)) -> DataFrame:
    """Columns renamed to their canonical names; two aliases of one field are an error, a missing required one too."""
    by_name = {c.lower(): c for c in df.columns}
    names = {}
    for field, aliases in ALIASES.items():
        found = [by_name[a] for a in aliases if a in by_name]
        if len(found) > 1:
            raise SnapshotError(f"{field} is there under several names: {found}")
        if found:
            names[found[0]] = field
        elif field in required:
            raise SnapshotError(f"{field} is missing")
    return df.withColumnsRenamed(names)


def fill_missing(df: DataFrame, policies: dict[str, tuple[str, object]]) -> DataFrame:
    """Per field a policy: reject (an error), default (a value), column (another column), keep (a null column)."""
    for field, (policy, value) in policies.items():
        there = field in df.columns
        if policy == "reject" and not there:
            raise SnapshotError(f"{field} is missing")
        base = F.col(field) if there else F.lit(None).cast("double")
        if policy == "default":
            df = df.withColumn(field, F.coalesce(base, F.lit(value)))
        elif policy == "column":
            df = df.withColumn(field, F.coalesce(base, F.col(value)))
        elif policy == "keep" and not there:
            df = df.withColumn(field, base)
    return df


def mass_table(df: DataFrame, masses: dict[int, float]) -> DataFrame:
    """A mass that is null comes from the header's table by part type, where that is positive."""
    table = {k: v for k, v in masses.items() if v > 0}
    if not table:
        return df
    return df.withColumn("mass", F.coalesce("mass", F.create_map(*[F.lit(v) for kv in sorted(table.items()) for v in kv])[F.col("part_type")]))


def read_snapshot(spark: SparkSession, path: str, masses: dict[int, float] | None = None, mapping: dict[int, int] | None = None, verify: bool = False) -> DataFrame:
    """A snapshot with canonical names; species from the part type, masses from the table where they are missing."""
    tables, _ = read_tables(spark, path, verify)
    df = resolve_aliases(tables["particles"])
    df = mass_table(df, masses or {})
    return df.withColumn("species_tag", species_of(F.col("part_type"), mapping))


def read_set(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Members of one set in order, with ``member``; headers must agree on the box and the step."""
    headers = [json.loads(_read_text(spark, f"{p}/{MARKER}"))["header"] for p in paths]
    for key in ("box", "step"):
        if len({json.dumps(h.get(key)) for h in headers}) > 1:
            raise SnapshotError(f"members differ in {key}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_snapshot(spark, p).withColumn("member", F.lit(i)) for i, p in enumerate(paths)])


def validate(particles: DataFrame) -> DataFrame:
    """One-pass counts of a snapshot: rows, distinct ids, values that aren't finite, masses that aren't positive."""
    return particles.agg(
        F.count("*").alias("n"), F.countDistinct("particle_id").alias("n_ids"), count_if(~finite("x", "y", "z")).alias("bad_position"), count_if(~finite("vx", "vy", "vz")).alias("bad_velocity"),
        count_if(~(finite("mass") & (F.col("mass") > 0))).alias("bad_mass"), count_if(F.col("particle_id") == 0).alias("zero_id"),
    )


def record_problems(box: float) -> Column:
    """What the scientific checks of a record find, as an array; an empty one is a good record."""
    tol = 1e-12 * max(1.0, box)
    inside = lambda c: finite(c) & (F.col(c) >= -tol) & (F.col(c) <= box + tol)
    return F.array_compact(F.array(
        F.when(~(inside("x") & inside("y") & inside("z")), "position"), F.when(~finite("vx", "vy", "vz"), "velocity"), F.when(F.coalesce(F.col("particle_id"), F.lit(0)) == 0, "id"), F.when(~(finite("mass") & (F.col("mass") > 0)), "mass"),
    ))


def generated(spark: SparkSession, n_dm: int, n_gas: int, box: float, first_id: int = 1) -> DataFrame:
    """A deterministic state: gas on a line at y = z = L/2, dark matter at L/4, ids gas first."""
    gas = spark.range(n_gas).select((F.col("id") + first_id).alias("particle_id"), F.lit(1).alias("species_tag"), ((F.col("id") + 0.5) / n_gas * box).alias("x"), F.lit(box / 2).alias("y"), F.lit(box / 2).alias("z"))
    dm = spark.range(n_dm).select((F.col("id") + first_id + n_gas).alias("particle_id"), F.lit(0).alias("species_tag"), ((F.col("id") + 0.5) / n_dm * box).alias("x"), F.lit(box / 4).alias("y"), F.lit(box / 4).alias("z"))
    return gas.unionByName(dm)


def generated_axis(spark: SparkSession, n: int, box: float) -> DataFrame:
    return generated(spark, n * n, n, box)


def chunk_audit(chunks: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(problem, n): chunks that leave gaps or overlap, and ids that are there more than once."""
    from nebulith.operators.decomposition import chunk_gaps

    gaps = chunk_gaps(chunks, "source", "begin", "end").agg(count_if(F.col("gap") > 0).alias("gap"), count_if(F.col("gap") < 0).alias("overlap"))
    twice = ids.groupBy(key).agg(F.count("*").alias("n")).agg(count_if(F.col("n") > 1).alias("duplicate"))
    row = gaps.join(F.broadcast(twice), F.lit(True))  # one row each
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("problem"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("n")) for c in ("gap", "overlap", "duplicate")])).alias("r")).select("r.*")


def conversion_multiplier(units: dict[str, float], frame_exponent: Column | None = None, convention: Column | None = None) -> Column:
    """Stored value to code units: base · h^p · a^q, a frame factor and the velocity convention, over the target's SI value.

    Needs the columns base, h, a, hx, ax, lp, mp and tp. Conventions: ``sqrt_a`` divides by √a, ``comoving_rate`` multiplies by a.
    """
    si = F.col("base") * F.pow("h", F.col("hx")) * F.pow("a", F.col("ax"))
    if frame_exponent is not None:
        si = si * F.pow("a", frame_exponent)
    if convention is not None:
        si = si * F.when(convention == "sqrt_a", 1 / F.sqrt("a")).when(convention == "comoving_rate", F.col("a")).otherwise(1.0)
    target = F.pow(F.lit(units["length"]), F.col("lp")) * F.pow(F.lit(units["mass"]), F.col("mp")) * F.pow(F.lit(units["time"]), F.col("tp"))
    return si / target


def write_restart(tables: dict[str, DataFrame], path: str, step: int, time: float) -> None:
    """The full state as tables with digests."""
    write_tables(tables, path, {"kind": "restart", "step": step, "time": time})


def read_restart(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, object]]:
    tables, header = read_tables(spark, path, verify=True)
    if header.get("kind") != "restart":
        raise SnapshotError(f"{path} is no restart")
    return tables, header


def read_hdf5(path: str, part: int):
    """Optional: one part type of an HDF5 snapshot as a pandas frame. The library is not part of this environment, so this is untested."""
    try:
        import h5py
    except ImportError as e:
        raise SnapshotError("reading HDF5 needs the h5py library") from e
    import pandas as pd

    with h5py.File(path, "r") as f:
        group = f[f"PartType{part}"]
        out = {}
        for name, data in group.items():
            if data.ndim == 2:
                out |= {f"{name.lower()}_{'xyz'[i]}": data[:, i] for i in range(data.shape[1])}
            else:
                out[name.lower()] = data[:]
    return pd.DataFrame(out)
