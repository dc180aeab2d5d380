"""Bracketed lookups in small tables: as-of interpolation joins, and the tables themselves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nebulith.operators.skew import stitched

#: Age in years and, per unit of initial mass: returned fraction, metal fraction, energy (fixed values of the survey's fixture F22).
SSP_ROWS = [
    (0.0, 0.0, 0.0, 0.0), (3.0e6, 0.02, 0.001, 1.0e46), (1.0e7, 0.10, 0.004, 6.0e48), (1.0e8, 0.18, 0.008, 1.0e49),
    (1.0e9, 0.28, 0.013, 1.6e49), (5.0e9, 0.34, 0.017, 1.9e49), (1.4e10, 0.40, 0.021, 2.1e49),
]


def literal_table(rows: list[tuple], names: tuple[str, ...]) -> Column:
    """A table of a few rows as an array of structs inside the plan: nothing is shuffled or broadcast."""
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, r)]) for r in rows])


def interpolate(table: list[tuple[float, ...]], value: Column, column: int, log_x: bool = False) -> Column:
    """Column ``column`` of a table sorted by its first one, linear between rows (or in log x, except where the left one is not
    positive), clamped to the ends."""
    out = F.lit(float(table[0][column]))
    for left, right in zip(table, table[1:]):
        x0, x1, y0, y1 = left[0], right[0], left[column], right[column]
        if log_x and x0 > 0:
            part = (F.log(value) - math.log(x0)) / (math.log(x1) - math.log(x0))
        else:
            part = (value - x0) / (x1 - x0)
        out = F.when(value > x0, F.lit(float(y0)) + F.least(part, F.lit(1.0)) * (y1 - y0)).otherwise(out)
    return out


def interpolate_join(points: DataFrame, table: DataFrame, x: str, tx: str, ty: str, out: str) -> DataFrame:
    """The same for tables of any size: intervals by a stitched lag, and an equi join on as many buckets as there are intervals.

    Values are clamped to the ends; a value that is null or NaN, and an empty table, give null. An interval lies in the buckets it touches, so all
    intervals together have at most twice as many rows as buckets; where a table is denser than elsewhere, its buckets hold more intervals.
    """
    rows = table.select(F.col(tx).cast("double").alias("_x1"), F.col(ty).cast("double").alias("_y1"), F.lit(0).alias("_all")).where("_x1 IS NOT NULL AND NOT isnan(_x1)")
    spans = stitched(rows, ["_all"], ["_x1"], lags={"_x0": "_x1", "_y0": "_y1"}).where("_x0 IS NOT NULL AND _x1 > _x0")
    ends = rows.agg(F.min("_x1").alias("_lo"), F.max("_x1").alias("_hi"), F.count("*").alias("_n"))
    bucket = lambda c: F.least(F.floor((c - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_n")), F.col("_n") - 1)
    at = points.join(F.broadcast(ends), F.lit(True)).withColumn("_v", F.when(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")), F.least(F.greatest(F.col(x), F.col("_lo")), F.col("_hi"))))  # ends: one row
    at = at.withColumn("_bucket", F.when(F.col("_hi") > F.col("_lo"), bucket(F.col("_v"))))
    spread = spans.join(F.broadcast(ends), F.lit(True)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_x0")), bucket(F.col("_x1"))))).select("_bucket", "_x0", "_y0", "_x1", "_y1")
    inside = (at["_bucket"] == spread["_bucket"]) & (F.col("_v") >= F.col("_x0")) & ((F.col("_v") < F.col("_x1")) | (F.col("_v") == F.col("_hi")) & (F.col("_x1") == F.col("_hi")))
    value = F.col("_y0") + (F.col("_v") - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0"))
    hit = at.join(spread, inside, "left")
    return hit.withColumn(out, value).select(*[F.col(c) for c in points.columns if c != out], out)


def ssp(age: Column, column: int) -> Column:
    return interpolate(SSP_ROWS, F.least(F.greatest(age, F.lit(0.0)), F.lit(SSP_ROWS[-1][0])), column, log_x=True)


def ssp_interval(begin: Column, end: Column, mass: Column, column: int) -> Column:
    """What a population gives between two ages: a difference of cumulative values, never negative."""
    b = F.greatest(begin, F.lit(0.0))
    e = F.greatest(end, b)
    return F.greatest(ssp(e, column) - ssp(b, column), F.lit(0.0)) * mass


def central_derivative(table: DataFrame, order: str, x: str, y: str) -> DataFrame:
    """dy/dx over the neighbours, one-sided at the ends, of a table of few rows."""
    w = Window.orderBy(order)
    lo = lambda c: F.coalesce(F.lag(c).over(w), F.col(c))
    hi = lambda c: F.coalesce(F.lead(c).over(w), F.col(c))
    return table.withColumn("derivative", F.try_divide(hi(y) - lo(y), hi(x) - lo(x)))


def increasing_violations(table: DataFrame, order: str, x: str) -> DataFrame:
    """Rows whose x isn't above the one before."""
    return table.withColumn("_prev", F.lag(x).over(Window.orderBy(order))).where(F.col("_prev") >= F.col(x)).drop("_prev")
