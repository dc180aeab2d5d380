"""Per-key results when a few keys hold most rows.

``range_split`` range-partitions on (key, secondary order) by quantiles sampled from the data,
so a heavy key is spread over as many partitions as its share asks for. Every partition
then makes partial states; those of keys that cross a partition boundary are stitched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nebulith.runtime import Scratch, parallelism


def range_split(df: DataFrame, key: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned on (key, order): a heavy key is cut at its own quantiles."""
    return df.repartitionByRange(partitions or parallelism(df.sparkSession), *[F.col(c) for c in (*key, *order)])


def balanced_groups(df: DataFrame, key: list[str], order: list[str], aggregates: list[Column], partitions: int | None = None) -> DataFrame:
    """One row per key. Partial states are made in the range partitions; what is shuffled after
    that is one state per key and partition, and the final merge stitches the pieces of heavy keys.

    ``aggregates`` must have partial states (sum, count, min, max, avg ...). Null is a key of its own.
    """
    return range_split(df, key, order, partitions).groupBy(*key).agg(*aggregates)


def stitched(df: DataFrame, key: list[str], order: list[str], sums: dict[str, Column] | None = None, lags: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """Adds a running row number ``_rn`` per key, running ``sums`` and previous values ``lags`` in ``order``.

    No task sees more than one range partition of a key: windows run within (partition, key),
    and the last state of each earlier partition of the same key is added afterwards. The
    states number at most keys + partitions. The split is written once, so that every
    use sees the same partitions. Rows with equal order values keep an arbitrary order among
    themselves; null keys form a key; an empty table gives an empty table.
    """
    sums, lags = sums or {}, lags or {}
    scratch = Scratch(df.sparkSession, "stitch")
    rows = scratch.write(range_split(df.withColumns({f"_v_{n}": e for n, e in sums.items()}), key, order, partitions).withColumn("_pid", F.spark_partition_id()))
    here = Window.partitionBy("_pid", *key).orderBy(*order)
    run = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns(
        {"_rn": F.row_number().over(here)}
        | {n: F.sum(f"_v_{n}").over(run) for n in sums}
        | {n: F.lag(F.struct(c)).over(here) for n, c in lags.items()}
    )
    states = rows.groupBy("_pid", *key).agg(
        F.count("*").alias("_n"), *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums],
        *([F.max_by(F.struct(*lags.values()), F.struct(*order)).alias("_last")] if lags else []),
    )
    before = Window.partitionBy(*key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = states.select(
        "_pid", *key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s0_{n}") for n in sums],
        *([F.lag("_last").over(Window.partitionBy(*key).orderBy("_pid")).alias("_prev")] if lags else []),
    )
    a, b = local.alias("a"), carried.alias("b")
    on = (F.col("a._pid") == F.col("b._pid"))
    for c in key:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, on).select(
        *[F.col(f"a.{c}") for c in df.columns],
        (F.col("_rn") + F.col("_n0")).alias("_rn"),
        *[(F.coalesce(F.col(f"a.{n}"), F.lit(0)) + F.col(f"_s0_{n}")).alias(n) for n in sums],
        *[F.when(F.col("_rn") > 1, F.col(f"a.{n}.{c}")).otherwise(F.col(f"_prev.{c}")).alias(n) for n, c in lags.items()],
    )


def hot_keys(df: DataFrame, key: str, order: list[str], share: float, partitions: int | None = None) -> DataFrame:
    """Keys that hold at least ``share`` of all rows (null keys count as rows, never as a key).

    At most 1/share keys can, so the result is small whatever the table's size.
    """
    keyed = df.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    per_key = balanced_groups(keyed, ["_key"], [f"_o{i}" for i in range(len(order))], [F.count("*").alias("n")], partitions)
    total = per_key.agg(F.sum("n").alias("total"))
    return (
        per_key.join(F.broadcast(total), on=F.col("n") >= F.ceil(F.col("total") * F.lit(share)), how="inner")  # total: one row
        .where(F.col("_key").isNotNull()).select(F.col("_key").cast("long").alias("hot_key"), "n", "total")
    )


def heavy_values(df: DataFrame, keys: str | list[str], parts: int | None = None, counted: str | None = None) -> list[tuple]:
    """(key columns ..., pieces) of the keys that hold more than an even share of ``df``'s rows for each of ``parts`` tasks.

    All rows are counted, reduced before the shuffle; a column ``counted`` holds counts already made. A key gets as many pieces
    as it holds even shares, so no size of key or table is left uncut. As the counts add up to all rows, at most ``parts``
    keys can pass and their pieces number at most twice that: what goes to the driver grows with the tasks, not with the data.
    """
    keys = [keys] if isinstance(keys, str) else keys
    parts = parts or parallelism(df.sparkSession)
    known = df.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    counts = known.select(*keys, F.col(counted).alias("_n")) if counted else known.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    heavy = counts.join(F.broadcast(total), on=(F.col("_n") > 1) & (F.col("_n") * parts > F.col("_all")))  # total: one row
    return [tuple(r) for r in heavy.select(*keys, F.ceil(F.col("_n") * parts / F.col("_all")).cast("int")).collect()]


def salted_join(left: DataFrame, right: DataFrame, keys: str | list[str], spread: list[str], heavy: list[tuple], how: str = "inner", parts: int | None = None) -> DataFrame:
    """Equi join whose rows of the keys in ``heavy`` (see ``heavy_values``) are dealt to as many tasks as they have pieces.

    Rows of ``left`` are dealt by the hash of ``spread``; the rows of ``right`` with such a key, few as they must be (one, where the
    key is unique in ``right``), are repeated once per piece. In a left join rows with a null key meet nothing and are dealt to all tasks.
    """
    keys = [keys] if isinstance(keys, str) else keys
    digest = F.xxhash64(*spread)
    null_salt = F.when(reduce(Column.__or__, [F.col(k).isNull() for k in keys]), F.pmod(digest, F.lit(parts or parallelism(left.sparkSession)))).otherwise(F.lit(0)).cast("int")
    if not heavy:
        if how != "left":
            return left.join(right.hint("merge"), keys, how)
        return left.withColumn("_salt", null_salt).join(right.withColumn("_salt", F.lit(0)).hint("merge"), [*keys, "_salt"], how).drop("_salt")
    kinds = [f.dataType for f in left.select(*keys).schema.fields]
    names = [f"_k{i}" for i in range(len(keys))]
    table = left.sparkSession.createDataFrame(heavy, T.StructType([*[T.StructField(n, t) for n, t in zip(names, kinds)], T.StructField("_pieces", T.IntegerType())]))
    on = lambda df: reduce(Column.__and__, [df[k] == table[n] for k, n in zip(keys, names)])
    a = left.join(F.broadcast(table), on(left), "left").drop(*names)  # table: at most one row per task
    a = a.withColumn("_salt", F.coalesce(F.pmod(digest, F.col("_pieces")).cast("int"), null_salt)).drop("_pieces")
    b = right.join(F.broadcast(table), on(right), "left").drop(*names)
    b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1))).drop("_pieces")
    return a.join(b.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread: str, pieces: int | None = None) -> DataFrame:
    """Left join on ``key`` (unique in ``right``) as a sort-merge of two co-partitioned streams.

    Keys that hold much of ``left`` are cut, by the hash of ``spread``, in proportion to their share; their single ``right`` row is repeated once per piece.
    """
    return salted_join(left, right, key, [spread], heavy_values(left, key, pieces), "left", pieces)
