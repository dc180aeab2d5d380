"""Differences between two copies of a table, by hierarchical checksums.

Each side is reduced to checksums of small key ranges (leaves) and of ever larger ranges
above them. Starting at the root, only the children of ranges whose checksums differ are
looked at; rows are read and compared field by field only for the leaves that remain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nebulith.runtime import Scratch

LEAF_BITS = 3  # ids per leaf: 2**3
FANOUT_BITS = 6  # children per inner range: 2**6


def values_equal(u: Column, v: Column, numeric: bool, rel_tol: float) -> Column:
    """Null equals null, NaN equals NaN, null and NaN differ; numbers agree within ``rel_tol``."""
    if not numeric:
        return u.eqNullSafe(v)
    a, b = u.cast("double"), v.cast("double")
    near = F.abs(a - b) <= F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(b))
    return F.coalesce(a.eqNullSafe(b) | (F.isnotnull(a) & F.isnotnull(b) & ~F.isnan(a) & ~F.isnan(b) & near), F.lit(False))


def compared_columns(left: DataFrame, right: DataFrame, key: str, ignore: tuple[str, ...]) -> list[str]:
    """Columns of both tables, matched without regard to letter case, in the left table's order."""
    theirs = {c.lower() for c in right.columns}
    skip = {key.lower(), *(c.lower() for c in ignore)}
    return [c for c in left.columns if c.lower() in theirs and c.lower() not in skip]


def column_sides(left: DataFrame, right: DataFrame, left_name: str = "left", right_name: str = "right") -> DataFrame:
    """(column_name, side): each column with the table that has it, or ``both``; letter case doesn't matter. Columns of one side can't be compared."""
    ours, theirs = ({c.lower(): c for c in df.columns} for df in (left, right))
    rows = [(ours.get(c) or theirs[c], "both" if c in ours and c in theirs else left_name if c in ours else right_name) for c in sorted({*ours, *theirs})]
    return left.sparkSession.createDataFrame(rows, "column_name string, side string")


def _leaf_checksums(df: DataFrame, key: str, columns: list[str], leaf_bits: int) -> DataFrame:
    """(leaf, rows, two 64-bit checksums); a row sent twice counts once.

    The null mask is hashed too, for the hash of a row skips nulls; NaN has one bit pattern.
    """
    mask = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns]) if columns else F.lit("")
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("k"), F.xxhash64(mask, *[F.col(c) for c in columns]).alias("h")
    ).distinct()
    return rows.groupBy(F.shiftright("k", leaf_bits).alias("node")).agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("k", "h")).alias("c1"),
        F.bit_xor(F.xxhash64("h", F.lit("second"), "k")).alias("c2"),
    )


def _parents(level: DataFrame, bits: int) -> DataFrame:
    return level.groupBy(F.shiftright("node", bits).alias("node")).agg(
        F.sum("n").alias("n"),
        F.bit_xor(F.xxhash64("node", "n", "c1")).alias("c1"),
        F.bit_xor(F.xxhash64("c2", "n", "node")).alias("c2"),
    )


def mismatched_leaves(
    left: DataFrame, right: DataFrame, key: str, columns: list[str], leaf_bits: int = LEAF_BITS, fanout_bits: int = FANOUT_BITS
) -> tuple[DataFrame, Scratch]:
    """Leaves (key >> leaf_bits) whose rows are not the same on both sides, found top-down."""
    spark = left.sparkSession
    scratch = Scratch(spark, "diff")
    levels = [tuple(scratch.write(_leaf_checksums(d, key, columns, leaf_bits)) for d in (left, right))]
    span = levels[0][0].select("node").union(levels[0][1].select("node")).agg(F.min("node"), F.max("node")).first()
    lo, hi = (span[0] or 0), (span[1] or 0)
    while hi - lo > 1:  # one step for each 6 bits of the key range; keys on both sides of 0 end as nodes -1 and 0
        levels.append(tuple(scratch.write(_parents(d, fanout_bits)) for d in levels[-1]))
        lo, hi = lo >> fanout_bits, hi >> fanout_bits
    suspects: DataFrame | None = None
    for a, b in reversed(levels):
        if suspects is not None:
            up = suspects.select(F.col("node").alias("parent"))
            a, b = (d.join(up, F.shiftright("node", fanout_bits) == up["parent"], "left_semi") for d in (a, b))
        both = a.alias("a").join(b.alias("b"), "node", "full_outer")
        same = reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("n", "c1", "c2")])
        suspects = scratch.write(both.where(~same).select("node"))
        if suspects.isEmpty():  # nothing below differs either
            break
    scratch.drop_but(suspects)
    return suspects, scratch


def compare_copies(
    left: DataFrame,
    right: DataFrame,
    key: str,
    ignore: tuple[str, ...] = (),
    left_name: str = "left",
    right_name: str = "right",
    rel_tol: float = 1e-9,
    leaf_bits: int = LEAF_BITS,
) -> DataFrame:
    """(key, diff): ``missing_in_<side>`` or the name of a column whose values differ.

    ``key`` is an integer column. Columns of only one side are not compared; ``column_sides`` names them. Defined cases:
    a row sent twice with equal values is no difference; of copies of one key that contradict
    each other, the largest value of each column is compared; a row with a null key names no
    record and is left out; an empty side makes all rows of the other missing; two empty
    sides give no row. A key that holds most rows is reduced before any shuffle, as equal
    (key, hash) pairs and as maxima.
    """
    columns = compared_columns(left, right, key, ignore)
    theirs = {c.lower(): c for c in right.columns}
    inner = [f"_c{i}" for i in range(len(columns))]  # so that no input column can clash with one made here
    sides = [
        df.select(F.col(f"`{key}`").alias("_key"), *[F.col(f"`{n}`").alias(c) for c, n in zip(inner, names)])
        for df, names in ((left, columns), (right, [theirs[c.lower()] for c in columns]))
    ]
    suspects, _ = mismatched_leaves(sides[0], sides[1], "_key", inner, leaf_bits)
    tagged = reduce(DataFrame.unionByName, [d.withColumn("_side", F.lit(i)) for i, d in enumerate(sides)])
    tagged = tagged.where(F.col("_key").isNotNull()).withColumn("_leaf", F.shiftright("_key", leaf_bits))
    kept = tagged.join(suspects.select(F.col("node").alias("_leaf")), "_leaf", "left_semi")
    numeric = [isinstance(f.dataType, T.NumericType) for f in sides[0].schema.fields[1:]]
    at = lambda side, c: F.max(F.when(F.col("_side") == side, c))
    merged = kept.groupBy("_leaf", "_key").agg(
        at(0, F.lit(True)).alias("_in0"), at(1, F.lit(True)).alias("_in1"), *[at(s, F.col(c)).alias(f"_{s}{c}") for c in inner for s in (0, 1)],
    )
    differing = F.array_compact(F.array(*[
        F.when(~values_equal(F.col(f"_0{c}"), F.col(f"_1{c}"), is_number, rel_tol), F.lit(name)) for c, name, is_number in zip(inner, columns, numeric)
    ])) if columns else F.array().cast("array<string>")
    found = (
        F.when(F.col("_in0").isNull(), F.array(F.lit(f"missing_in_{left_name}")))
        .when(F.col("_in1").isNull(), F.array(F.lit(f"missing_in_{right_name}")))
        .otherwise(differing)
    )
    return merged.select(F.col("_key").alias(key), F.explode(found).alias("diff"))
