"""The step pipeline: stages with declared reads and writes in a fixed order, and kick-drift-kick as such a pipeline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulith.functions.cosmology import Background
from nebulith.operators.gravity import AXES, drift, kick
from nebulith.runtime import Scratch

ORDER = ("kick_pre", "drift", "force_refresh", "hydro", "sources", "kick_post", "analysis", "output")

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """A named part of a step. It may only read and write the tables it declares, and runs after what it requires."""

    slot: str
    run: Callable[[Tables], Tables]
    reads: tuple[str, ...]
    writes: tuple[str, ...] = ()
    requires: tuple[str, ...] = ()
    name: str = ""


def ordered(stages: list[Stage]) -> list[Stage]:
    """Stages by slot, and within a slot after what they require. Unknown slots, missing requirements and cycles are errors."""
    for s in stages:
        if s.slot not in ORDER:
            raise ValueError(f"unknown slot {s.slot}")
    out: list[Stage] = []
    for slot in ORDER:
        left = [s for s in stages if s.slot == slot]
        while left:
            done = {s.name or s.slot for s in out}
            ready = [s for s in left if set(s.requires) <= done]
            if not ready:
                raise ValueError(f"requirements of {[s.name or s.slot for s in left]} can't be met")
            out += ready
            left = [s for s in left if s not in ready]
    return out


def run_step(tables: Tables, stages: list[Stage], materialize: tuple[str, ...] = ()) -> Tables:
    """One step. A stage gets only its declared tables, and what it returns beyond its declared writes is an error.

    ``materialize`` names tables that are written after the step, so that plans don't grow from step to step.
    """
    now = dict(tables)
    for s in ordered(stages):
        missing = [t for t in s.reads if t not in now]
        if missing:
            raise ValueError(f"{s.name or s.slot} reads {missing}, which aren't there")
        out = s.run({t: now[t] for t in s.reads})
        extra = set(out) - set(s.writes)
        if extra:
            raise ValueError(f"{s.name or s.slot} wrote {sorted(extra)} without declaring it")
        now |= out
    for t in materialize:
        now[t] = Scratch(now[t].sparkSession, "step").write(now[t])
    return now


def kick_drift_kick(particles: DataFrame, accelerate: Callable[[DataFrame], DataFrame], dt: float, drag: float = 1.0) -> DataFrame:
    """Half a kick, a drift, new accelerations, the other half; gas isn't drifted here, and positions aren't wrapped."""

    def half(t: Tables) -> Tables:
        return {"particles": kick(t["particles"], t["acceleration"], drag**0.5, dt / 2)}

    def force(t: Tables) -> Tables:
        return {"acceleration": accelerate(t["particles"])}

    stages = [
        Stage("kick_pre", half, ("particles", "acceleration"), ("particles",)), Stage("drift", lambda t: {"particles": drift(t["particles"], dt)}, ("particles",), ("particles",)),
        Stage("force_refresh", force, ("particles",), ("acceleration",)), Stage("kick_post", half, ("particles", "acceleration"), ("particles",)),
    ]
    return run_step({"particles": particles, "acceleration": accelerate(particles)}, stages)["particles"]


def central_force(particles: DataFrame, center: float, strength: float) -> DataFrame:
    """A harmonic pull, for tests and as the simplest force."""
    return particles.select("particle_id", *[(strength * (center - F.col(c))).alias(f"a{c}") for c in AXES])


def timeline(spark: SparkSession, background: Background, a_begin: float, dlna: float, steps: int) -> DataFrame:
    """(step, a_begin, a_mid, a_end, dt, drift, kick_1, kick_2, drag) of steps of equal Δln a."""
    begin = F.lit(a_begin) * F.exp(F.col("id") * dlna)
    t = spark.range(steps).select(F.col("id").alias("step"), begin.alias("a_begin"), (begin * F.exp(F.lit(dlna / 2))).alias("a_mid"), (begin * F.exp(F.lit(dlna))).alias("a_end"))
    a, m, b = F.col("a_begin"), F.col("a_mid"), F.col("a_end")
    return t.select("*", background.midpoint_sum(a, b, 1).alias("dt"), background.drift(a, b).alias("drift"), background.kick(a, m).alias("kick_1"), background.kick(m, b).alias("kick_2"), background.drag(a, b).alias("drag"))
