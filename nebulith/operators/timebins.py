"""Hierarchical time bins, cadences and versioned state. Bin 0 is the finest; bin b is active when the tick is a multiple of 2^b."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulith.operators.base import count_if


def period(bin_: Column) -> Column:
    return F.pow(F.lit(2), bin_).cast("long")


def is_active(bin_: Column, tick: Column) -> Column:
    return F.pmod(tick, period(bin_)) == 0


def active_elements(elements: DataFrame, tick: int) -> DataFrame:
    return elements.where(is_active(F.col("bin"), F.lit(tick).cast("long")))


def activity(elements: DataFrame, ticks: DataFrame) -> DataFrame:
    """(tick, n_active, active_fraction, most_active_bin): occupancy per bin is reduced first, so ticks meet bins, not elements."""
    bins = elements.groupBy("bin").agg(F.count("*").alias("n"))
    total = elements.agg(F.count("*").alias("total"))
    on = ticks.join(bins, is_active(F.col("bin"), F.col("tick")))
    per = on.groupBy("tick").agg(F.sum("n").alias("n_active"), F.min_by("bin", F.struct(-F.col("n"), F.col("bin"))).alias("most_active_bin"))
    return ticks.join(per, "tick", "left").join(F.broadcast(total), F.lit(True)).select(  # total: one row
        "tick", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce(F.try_divide("n_active", "total"), F.lit(0.0)).alias("active_fraction"), F.coalesce("most_active_bin", F.lit(0)).alias("most_active_bin")
    )


def reconcile(candidates: DataFrame) -> DataFrame:
    """(element, bin, source): the smallest candidate bin wins, ties keep the first submitted one."""
    return candidates.groupBy("element").agg(F.min("bin").alias("bin"), F.min_by("source", F.struct("bin", "ordinal")).alias("source"))


def limiting_sources(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("source").agg(F.count("*").alias("n"))


def apply_transitions(elements: DataFrame, requests: DataFrame, tick: int) -> DataFrame:
    """(element, bin, pending, outcome): of active elements, refining is at once, coarsening waits for a tick the longer period divides."""
    j = elements.join(requests.select("element", F.col("bin").alias("wanted")), "element", "left")
    on = is_active(F.col("bin"), F.lit(tick).cast("long"))
    fits = F.pmod(F.lit(tick).cast("long"), period(F.col("wanted"))) == 0
    outcome = (
        F.when(F.col("wanted").isNull(), "none").when(F.col("wanted") == F.col("bin"), "same").when(~on, "waits").when(F.col("wanted") < F.col("bin"), "refined").when(fits, "coarsened").otherwise("deferred")
    )
    moved = F.col("outcome").isin("refined", "coarsened")
    return j.withColumn("outcome", outcome).select(
        "element", F.when(moved, F.col("wanted")).otherwise(F.col("bin")).alias("bin"), F.when(F.col("outcome").isin("waits", "deferred"), F.col("wanted")).alias("pending"), "outcome"
    )


def mirror_mismatches(elements: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose bin isn't the scheduler's, or that it doesn't know."""
    j = rows.join(elements.select(F.col("element").alias(key), F.col("bin").alias("_bin")), key, "left")
    return j.where(~F.col("time_bin").eqNullSafe(F.col("_bin"))).select(key, "time_bin", F.col("_bin").alias("scheduler_bin"))


def refresh_events(opportunities: DataFrame, cadence: int, order: str = "opportunity") -> DataFrame:
    """(opportunity, refresh, field_version): the mesh is refreshed at the first opportunity and each time ``cadence`` more have passed."""
    k = F.col(order) - 1
    return opportunities.select(order, (F.pmod(k, F.lit(cadence)) == 0).alias("refresh"), (F.floor(k / cadence) + 1).alias("field_version"))


def output_steps(steps: DataFrame, every_steps: int, every_time: float, step: str = "step", time: str = "time") -> DataFrame:
    """Steps at which something is written: the interval of steps divides it, or a multiple of the time interval was passed since the step before."""
    passed = F.floor(F.col(time) / every_time) > F.floor((F.col(time) - F.col("dt")) / every_time)
    return steps.withColumn("by_steps", F.pmod(F.col(step), F.lit(every_steps)) == 0).withColumn("by_time", passed).where("by_steps OR by_time").select(step, "by_steps", "by_time")


def diagnostics_due(steps: DataFrame, health: int = 1, light: int = 8, heavy: int = 64) -> DataFrame:
    """Which classes of diagnostics are due at each step."""
    due = lambda n: F.pmod(F.col("step"), F.lit(n)) == 0
    return steps.select("step", due(health).alias("health"), due(light).alias("light"), due(heavy).alias("heavy"))


def reject_stale(rows: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of the newest version of their key; older ones are dropped as stale, newer ones than known are kept."""
    j = rows.join(current.select(key, F.col(version).alias("_now")), key, "left")
    return j.where(F.col("_now").isNull() | (F.col(version) >= F.col("_now"))).drop("_now")


def restart_legality(steps: DataFrame) -> DataFrame:
    """A restart may be written only where all bins meet and no refresh or migration is pending."""
    aligned = F.pmod(F.col("tick"), period(F.col("max_bin"))) == 0
    kind = F.when(aligned, "global").when(F.pmod(F.col("tick"), F.lit(2)) == 0, "partial").otherwise("substep")
    return steps.select("tick", kind.alias("boundary"), (aligned & ~F.col("pending")).alias("restart_safe"))


def scheduler_export(elements: DataFrame, tick: int) -> DataFrame:
    """Persistent state: element, bin, next tick. Next is the first multiple of the bin's period after ``tick``."""
    p = period(F.col("bin"))
    return elements.select("element", "bin", ((F.floor(F.lit(tick) / p) + 1) * p).cast("long").alias("next_tick"))


def scheduler_violations(state: DataFrame, max_bin: int, tick: int) -> DataFrame:
    """Counts of rows that a scheduler would refuse: bins out of range, next ticks in the past or off their period."""
    return state.agg(
        F.count("*").alias("n"), count_if((F.col("bin") < 0) | (F.col("bin") > max_bin)).alias("bad_bin"), count_if(F.col("next_tick") <= tick).alias("in_past"), count_if(F.pmod(F.col("next_tick"), period(F.col("bin"))) != 0).alias("off_period")
    )
