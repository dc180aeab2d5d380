"""Column predicates and table forms used by many operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPECIES = {"dark_matter": 0, "gas": 1, "star": 2, "black_hole": 3, "tracer": 4}  # fixed tags


def finite(*columns: str | Column) -> Column:
    """All columns are numbers: neither null, NaN nor infinite."""
    return reduce(Column.__and__, [F.coalesce(F.abs(F.col(c) if isinstance(c, str) else c) < F.lit(float("inf")), F.lit(False)) for c in columns])


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def current(df: DataFrame, *key: str, arrival: str = "ingested_at") -> DataFrame:
    """One row per key: copies of a row sent again are dropped. Reduced before the shuffle."""
    return df.drop(arrival).dropDuplicates(list(key))


def dense_bins(df: DataFrame, bins: dict[str, int], fill: dict[str, float]) -> DataFrame:
    """Empty bins stay: a dense grid of all bin indices, left-joined with what was found. The grid's size is its arguments' product."""
    spark = df.sparkSession
    total = 1
    for n in bins.values():
        total *= n
    grid = spark.range(total)
    step = total
    for name, n in bins.items():
        step //= n
        grid = grid.withColumn(name, (F.floor(F.col("id") / step) % n).cast("int"))
    return grid.drop("id").join(df, list(bins), "left").fillna(fill)
