"""Analysis products and small inputs: JSON sinks with retention, manifests, text tables, id lists."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([
    T.StructField("schema_version", T.IntegerType()), T.StructField("hubble_param", T.DoubleType()), T.StructField("scale_factor", T.DoubleType()),
    T.StructField("fields", T.ArrayType(T.StructType([
        T.StructField("dataset_path", T.StringType()), T.StructField("scalar_type", T.StringType()), T.StructField("base_unit_to_si", T.DoubleType()),
        T.StructField("hubble_exponent", T.DoubleType()), T.StructField("scale_factor_exponent", T.DoubleType()),
    ]))),
])


def manifests(files: DataFrame, fields: DataFrame) -> DataFrame:
    """(source_file_index, manifest): one JSON text per file. A file's fields are few, so they fit a row."""
    item = F.struct(*[F.col(c) for c in ("dataset_path", "scalar_type", "base_unit_to_si", "hubble_exponent", "scale_factor_exponent")])
    lists = fields.groupBy("source_file_index").agg(F.sort_array(F.collect_set(item)).alias("fields"))
    about = files.groupBy("source_file_index").agg(F.max("hubble_param").alias("hubble_param"), F.max("scale_factor").alias("scale_factor"))
    return about.join(lists, "source_file_index").select("source_file_index", F.to_json(F.struct(F.lit(4).alias("schema_version"), "hubble_param", "scale_factor", "fields")).alias("manifest"))


def manifest_fields(texts: DataFrame) -> DataFrame:
    """The fields of manifests read back; a text that is no manifest of version 4 is an error at run time."""
    m = texts.withColumn("m", F.from_json("manifest", MANIFEST))
    ok = F.when(F.col("m.schema_version") == 4, F.col("m.fields")).otherwise(F.raise_error(F.lit("no manifest of version 4")).cast(MANIFEST["fields"].dataType))
    return m.select("source_file_index", F.col("m.hubble_param").alias("hubble_param"), F.col("m.scale_factor").alias("scale_factor"), F.explode(ok).alias("f")).select("source_file_index", "hubble_param", "scale_factor", "f.*")


def write_catalogue(rows: DataFrame, path: str) -> None:
    """Halo catalogue or merger nodes as JSON lines."""
    rows.write.mode("overwrite").json(path)


def read_catalogue(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def retained(bundles: DataFrame, keep: int, cls: str = "class", step: str = "step") -> DataFrame:
    """The newest ``keep`` bundles of each class. Bundles are few: one per step that was diagnosed."""
    return bundles.withColumn("_r", F.row_number().over(Window.partitionBy(cls).orderBy(F.desc(step)))).where(F.col("_r") <= keep).drop("_r")


def bundle(rows: DataFrame, step: int, cls: str) -> DataFrame:
    """One-row results as (step, class, json)."""
    return rows.select(F.lit(step).alias("step"), F.lit(cls).alias("class"), F.to_json(F.struct(*rows.columns)).alias("json"))


def read_number_table(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Whitespace-separated numbers; # begins a comment. A row with another number of columns is an error at run time."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).where("line <> ''")
    parts = F.split("line", r"\s+")
    checked = F.when(F.size(parts) == len(names), parts).otherwise(F.raise_error(F.concat(F.lit("bad table row: "), F.col("line"))).cast("array<string>"))
    return lines.select(checked.alias("p")).select(*[F.col("p")[i].cast("double").alias(n) for i, n in enumerate(names)])


def table_hash(path: str) -> str:
    from nebulith.sources.config import fnv1a

    with open(path, encoding="utf-8") as f:
        return f"{fnv1a(f.read()):016x}"


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids, one or more per line; # begins a comment."""
    words = spark.read.text(path).select(F.explode(F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"[\s,]+")).alias("w")).where("w <> ''")
    return words.select(F.col("w").cast("long").alias("particle_id")).distinct()


def zoom_members(particles: DataFrame, ids: DataFrame) -> DataFrame:
    return particles.join(ids, "particle_id", "left_semi")


def report(events: list[dict[str, object]]) -> str:
    """Operational events as JSON lines."""
    return "\n".join(json.dumps(e, sort_keys=True) for e in events)
