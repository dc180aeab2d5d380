"""Schemas that drift between the files of a run: a catalogue of column lifespans.

Every field of every file is one row (producer run, position of the file in the run, lane,
path, type). A lag within the run cuts each field's appearances into islands, its lifespans; what
starts and ends with them are the changes, and casts come from an alias table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nebulith.operators.skew import stitched
from nebulith.runtime import Scratch


def canonical_path(c: Column) -> Column:
    """Trimmed, lower case, without leading, trailing or doubled slashes."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))), "/+", "/"), "^/|/$", ""))


def canonical_type(scalar_type: Column, byte_width: Column, is_signed: Column) -> Column:
    """``float|signed|unsigned`` and the width in bytes, whatever the spelling or byte order.

    A number after < > = | is in bytes, else in bits (f4 and f8: bytes; u8 and i8 are 8 bits, as u16 is 16). Without a number the
    C names hold (float 4, double 8, int 4, long 8, short 2, char 1) and then byte_width.
    Unknown text keeps its own name as kind.
    """
    t = F.lower(F.trim(scalar_type))
    bare = F.regexp_replace(t, r"^h5t_(?:ieee|std)_([a-z][0-9]+)(?:le|be)?$", "$1")
    number = F.regexp_extract(bare, r"([0-9]+)$", 1).try_cast("int")
    word = F.regexp_extract(bare, r"^[<>=|]?([a-z_ ]*)", 1)
    as_bytes = bare.rlike(r"^[<>=|]") | (number <= 8) & ~bare.rlike("^[a-z]*int8$|^[iu]8$")
    width = F.coalesce(
        F.when(as_bytes, number).otherwise((number / 8).cast("int")),
        F.when(word.isin("double", "long", "long long", "real8"), 8).when(word.isin("float", "int", "real", "single", "uint"), 4).when(word.isin("half", "short", "ushort"), 2).when(word.isin("char", "byte"), 1),
        byte_width,
    )
    kind = (
        F.when(word.isin("f", "float", "double", "real", "single", "half", "ieee_f"), "float")
        .when(word.rlike("^u|^unsigned"), "unsigned")
        .when(word.isin("i", "int", "long", "short", "char", "signed", "integer", "long long"), F.when(is_signed.eqNullSafe(F.lit(False)) & ~word.isin("i", "int"), "unsigned").otherwise("signed"))
        .otherwise(bare)
    )
    return F.when(scalar_type.isNotNull(), F.concat_ws(":", kind, F.coalesce(width.cast("string"), F.lit("?"))))


def file_positions(files: DataFrame) -> DataFrame:
    """(source_file_index, run_name, ord, n_files, prev_file): files of each run in order of writing.

    Copies of a file count once; a run's position is made by the stitched rank, so a run that holds a third of
    all files isn't one task. Files without a run name or writing time have no predecessor and are left out.
    """
    once = files.where(F.col("run_name").isNotNull() & F.col("written_at").isNotNull()).groupBy("source_file_index").agg(
        F.min("run_name").alias("run_name"), F.min("written_at").alias("written_at"),
        F.max("restart_schema_version").alias("version"), F.max("hubble_param").alias("hubble_param"), F.max("scale_factor").alias("scale_factor"),
    )
    # written by the stitch, so that all uses of the positions share one table
    ranked = stitched(once, ["run_name"], ["written_at", "source_file_index"], lags={"prev_file": "source_file_index"})
    last = ranked.groupBy("run_name").agg(F.max("_rn").alias("n_files"))
    return ranked.withColumnRenamed("_rn", "ord").join(last, "run_name")


def field_catalogue(files: DataFrame, fields: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """One row for each field of each file: run, ord, lane, path, type. Resent rows count once."""
    positions = file_positions(files) if positions is None else positions
    canon = fields.where(F.col("dataset_path").isNotNull()).select(
        "source_file_index", F.col("field_lane").alias("lane"), canonical_path(F.col("dataset_path")).alias("path"),
        canonical_type(F.col("scalar_type"), F.col("byte_width"), F.col("is_signed")).alias("type"),
    ).groupBy("source_file_index", "lane", "path").agg(F.min("type").alias("type"))
    return canon.join(positions.drop("prev_file", "written_at"), "source_file_index")


def islands(catalogue: DataFrame, *identity: str) -> DataFrame:
    """Islands of successive files of a run in which a field of ``identity`` keeps path and type: first and last position and file.

    A lag over the positions starts an island where the file before lacks the field; a running count of starts names it.
    """
    w = Window.partitionBy("run_name", *identity, "path", "type").orderBy("ord")
    starts = catalogue.withColumn("_starts", (F.col("ord") - F.coalesce(F.lag("ord").over(w), F.lit(-1)) > 1).cast("int"))
    named = starts.withColumn("_island", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return named.groupBy("run_name", *identity, "path", "type", "_island").agg(
        F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.max("n_files").alias("run_files"),
        F.min_by("source_file_index", "ord").alias("first_file"), F.max_by("source_file_index", "ord").alias("last_file"),
    ).drop("_island")


def lifespans(catalogue: DataFrame) -> DataFrame:
    """Islands of files in which a run's field keeps one path and one type: first_ord, last_ord, n_files, started, ended."""
    return islands(catalogue).select(
        "run_name", "path", "type", "first_ord", "last_ord",
        (F.col("first_ord") > 1).alias("started"), (F.col("last_ord") < F.col("run_files")).alias("ended"),
    )


def schema_changes(files: DataFrame, fields: DataFrame) -> DataFrame:
    """(source_file_index, dataset_path, change_kind) of each file against the one before it in its run, from the catalogue of lifespans.

    Only where a lifespan starts or ends can something have changed. A start looks for the lifespan of the same field that was alive one
    file earlier, an ending for one that is alive one file later. Fields are the same if their lanes are equal or, where a lane is null on
    either side, if their paths are. A start without a predecessor is ``added``, with one of another path ``renamed``, of another type
    ``retyped``; an ending without a successor is ``removed`` (named at the later file).
    The first file of a run changes nothing. A file without any field removes all fields of the one before.
    """
    scratch = Scratch(files.sparkSession, "drift")
    positions = scratch.write(file_positions(files))
    spans = scratch.write(islands(field_catalogue(files, fields, positions), "lane"))
    has_lane = F.col("lane").isNotNull()
    me = F.struct("first_ord", "last_ord", "lane", "path", "type")
    by_lane, by_path = (Window.partitionBy("run_name", *k) for k in (("lane", F.when(~has_lane, F.col("path"))), ("path",)))
    earlier = lambda w, ok: F.max_by(F.when(ok, me), F.when(ok, F.col("last_ord"))).over(w.orderBy("first_ord").rangeBetween(Window.unboundedPreceding, -1))
    later = lambda w, ok: F.min(F.when(ok, F.col("first_ord"))).over(w.orderBy("last_ord").rangeBetween(1, Window.unboundedFollowing))
    every, no_lane = F.lit(True), F.col("lane").isNull()
    seen = spans.withColumns({"lane_before": earlier(by_lane, every), "lane_after": later(by_lane, every)}).withColumns(
        {"any_before": earlier(by_path, every), "bare_before": earlier(by_path, no_lane), "any_after": later(by_path, every), "bare_after": later(by_path, no_lane)}
    )
    alive = lambda s: F.when(F.col(f"{s}.last_ord") >= F.col("first_ord") - 1, F.col(s))
    before = F.when(has_lane, F.coalesce(alive("lane_before"), alive("bare_before"))).otherwise(alive("any_before"))
    after = F.when(has_lane, F.least("lane_after", "bare_after")).otherwise(F.col("any_after"))
    state = scratch.write(seen.select(
        "first_ord", "last_ord", "run_files", "first_file", "last_file", "path", "type", before.alias("before"), F.coalesce(after <= F.col("last_ord") + 1, F.lit(False)).alias("goes_on"),
    ))
    kinds = F.array_compact(F.array(
        F.when((F.col("first_ord") > 1) & F.col("before").isNull(), "added"),
        F.when(F.col("before.path") != F.col("path"), "renamed"),
        F.when(~F.col("before.type").eqNullSafe(F.col("type")) & F.col("before").isNotNull(), "retyped"),
    ))
    starts = state.select(F.col("first_file").alias("source_file_index"), F.col("path").alias("dataset_path"), F.explode(kinds).alias("change_kind"))
    successor = positions.where(F.col("prev_file").isNotNull()).select(F.col("source_file_index").alias("next_file"), "prev_file")
    ends = state.where(~F.col("goes_on") & (F.col("last_ord") < F.col("run_files"))).join(successor, F.col("last_file") == F.col("prev_file")).select(
        F.col("next_file").alias("source_file_index"), F.col("path").alias("dataset_path"), F.lit("removed").alias("change_kind")
    )
    return starts.union(ends).distinct()


#: Spark types for canonical types (fixed values); unsigned 8-byte numbers need 20 digits.
CASTS = {
    "float:4": "float", "float:8": "double", "float:2": "float", "signed:1": "tinyint", "signed:2": "smallint", "signed:4": "int", "signed:8": "bigint",
    "unsigned:1": "smallint", "unsigned:2": "int", "unsigned:4": "bigint", "unsigned:8": "decimal(20,0)",
}


def alias_table(catalogue: DataFrame) -> DataFrame:
    """(run_name, path, unified): the path that a run's field bears last, for each path it bore under the same lane."""
    laned = catalogue.where(F.col("lane").isNotNull())
    latest = laned.groupBy("run_name", "lane").agg(F.max_by("path", F.struct("ord", "path")).alias("unified"))
    return laned.select("run_name", "lane", "path").distinct().join(latest, ["run_name", "lane"]).groupBy("run_name", "path").agg(F.max("unified").alias("unified"))


def cast_table(catalogue: DataFrame) -> DataFrame:
    """(run_name, path, unified, cast_to): the unified name of each path and the one type that holds all types its field had in the run.

    Any float makes it double; else an unsigned type of 8 bytes makes it decimal(20,0); else it is bigint. A field whose types are all
    unknown is double.
    """
    names = catalogue.join(alias_table(catalogue), ["run_name", "path"], "left").withColumn("unified", F.coalesce("unified", "path"))
    spark_type = F.create_map(*[F.lit(x) for kv in sorted(CASTS.items()) for x in kv])[F.col("type")]
    holds = names.withColumn("as", spark_type).groupBy("run_name", "unified").agg(
        F.max(F.col("as").isNull() | F.col("as").isin("float", "double")).alias("real"), F.max(F.col("as").startswith("decimal")).alias("wide"),
    ).select("run_name", "unified", F.when(F.col("real"), "double").when(F.col("wide"), "decimal(20,0)").otherwise("bigint").alias("cast_to"))
    return names.select("run_name", "path", "unified").distinct().join(holds, ["run_name", "unified"])


#: Typed columns of the consistent table: which ``cast_to`` fills each, and from which form of the text (whole numbers are rounded half up).
TYPED = {"as_double": ("double", "double"), "as_bigint": ("bigint", "decimal(38,6)"), "as_decimal": ("decimal(20,0)", "decimal(38,6)")}


def consistent_rows(files: DataFrame, fields: DataFrame, rows: DataFrame) -> DataFrame:
    """All restart rows as one table of typed values: (row_id, source_file_index, particle_id, field, type, cast_to, as_double, as_bigint, as_decimal, bad_cast).

    A payload key is read under its file's own path; its name comes from the alias table and its cast from the cast table, so that a field has
    one name and one type in all files of a run, and the value stands in the column of that type. Text that is no number of the type gives null
    and ``bad_cast`` true. JSON nulls stay null rows, so no value is lost; keys that no field lists keep their path and are read as doubles.
    Payloads that are no JSON object give no values.
    """
    scratch = Scratch(files.sparkSession, "casts")
    catalogue = scratch.write(field_catalogue(files, fields))
    names = catalogue.join(cast_table(catalogue), ["run_name", "path"]).groupBy("source_file_index", "path").agg(
        F.max("unified").alias("field"), F.max("type").alias("type"), F.max("cast_to").alias("cast_to")
    )
    once = rows.groupBy("row_id", "source_file_index", "particle_id").agg(F.min("payload").alias("payload"))
    values = once.select(
        "row_id", "source_file_index", "particle_id", F.explode(F.from_json("payload", "map<string,string>")).alias("key", "text")
    ).withColumn("path", canonical_path(F.col("key")))
    named = values.join(names, ["source_file_index", "path"], "left").withColumns({"field": F.coalesce("field", "path"), "cast_to": F.coalesce("cast_to", F.lit("double"))})
    typed = named.withColumns({c: F.when(F.col("cast_to") == kind, F.col("text").try_cast(form).try_cast(kind)) for c, (kind, form) in TYPED.items()})
    return typed.select(
        "row_id", "source_file_index", "particle_id", "field", "type", "cast_to", *TYPED,
        (F.col("text").isNotNull() & F.coalesce(*[F.col(c).cast("string") for c in TYPED]).isNull()).alias("bad_cast"),
    )
