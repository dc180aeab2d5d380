"""Subgrid steps on tables of gas cells, stars and black holes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulith.functions import physics as P
from nebulith.functions import random as R
from nebulith.operators.base import finite
from nebulith.runtime import Scratch, ship


# --- star formation -----------------------------------------------------------------------------------------

@dataclass(frozen=True)
class StarFormation:
    model: str = "threshold"  # or "bound_jeans"
    density_threshold: float = 10.0
    temperature_threshold: float = 1e4
    converging_flow: float = 0.0
    efficiency: float = 0.01
    alpha_max: float = 1.0
    jeans_floor: float = 100.0
    ceiling: float = 0.0
    least_mass: float = 0.1
    most_mass: float = 1e30
    target_mass: float = 0.1
    most_particles: int = 8
    most_converted: float = 0.25
    least_left: float = 0.01
    g: float = 43.0


def rejection(cfg: StarFormation) -> Column:
    """The first failing test in the model's fixed order, or ``none``. Needs the columns of ``star_formation_inputs``."""
    nonneg = lambda c: finite(c) & (F.col(c) >= 0)
    state = finite("density") & (F.col("density") > 0) & nonneg("temperature") & nonneg("sound_speed") & finite("divergence") & nonneg("gradient2") & finite("vx", "vy", "vz") & nonneg("metal_mass")
    chain = (
        F.when(~F.col("active"), "inactive").when(~F.col("owned"), "not_owned").when(~F.col("leaf"), "non_leaf").when(F.col("ghost"), "ghost")
        .when(~(finite("mass") & (F.col("mass") > 0)), "non_positive_mass").when(~state, "invalid_state")
    )
    if cfg.model == "threshold":
        return (
            chain.when(F.col("density") < cfg.density_threshold, "density").when(F.col("temperature") > cfg.temperature_threshold, "temperature")
            .when(F.col("divergence") > cfg.converging_flow, "not_converging").otherwise("none")
        )
    alpha = P.virial_parameter(F.col("density"), F.cbrt("volume"), F.col("sound_speed"), F.col("gradient2"), cfg.g)
    jeans = P.jeans_mass(F.col("density"), F.col("sound_speed"), cfg.g)
    chain = chain.when(F.col("gas_cell_id") == 0, "invalid_state").when(~(finite("volume") & (F.col("volume") > 0)), "non_positive_volume")
    if cfg.ceiling > 0:
        chain = chain.when(F.col("temperature") > cfg.ceiling, "temperature")
    return (
        chain.when(F.col("divergence") >= 0, "not_converging").when(~(alpha < cfg.alpha_max), "unbound")
        .when(~(jeans < F.greatest(F.lit(cfg.jeans_floor), F.col("mass"))), "jeans_stable").otherwise("none")
    )


def star_formation_plan(cells: DataFrame, cfg: StarFormation, dt: float, tick: int) -> DataFrame:
    """Adds reason, expected mass, a feasible particle mass, the number of particles and the mass they take.

    Expected mass is linear in time in the threshold model and 1 − exp(−x) in the other. The particle mass is the one
    nearest to the target for which both possible counts fit the gas that may leave; counts are drawn by the cell's counter.
    """
    m = F.col("mass")
    x = cfg.efficiency * dt / F.greatest(P.free_fall_time(F.col("density"), cfg.g), F.lit(P.TIME_FLOOR))
    raw = m * x if cfg.model == "threshold" else m * (-F.expm1(-x))
    most = F.greatest(F.least(m, m * cfg.most_converted, m * (1 - cfg.least_left)), F.lit(0.0))
    wanted = F.lit(cfg.least_mass if cfg.model == "threshold" else cfg.target_mass)
    base = cells.withColumn("reason", rejection(cfg)).withColumns({"most": most, "expected": F.when(F.col("reason") == "none", F.least(F.greatest(raw, F.lit(0.0)), most)).otherwise(0.0)})
    able = (F.col("expected") > 0) & (F.col("most") >= cfg.least_mass)

    def option(n: int) -> Column:
        low = F.greatest(F.lit(cfg.least_mass), F.col("expected") / n)
        high = F.least(F.lit(cfg.most_mass), F.col("most") / n)
        if n > 1:
            high = F.least(high, F.col("expected") / (n - 1) * (1 - 1e-15))
        fit = F.least(F.greatest(wanted, low), high)
        return F.when(low <= high, F.struct(F.abs(fit - wanted).alias("off"), F.lit(n).alias("n"), fit.alias("mass")))

    best = F.array_min(F.array_compact(F.array(*[option(n) for n in range(1, cfg.most_particles + 1)])))
    planned = base.withColumn("particle_mass", F.when(able, best["mass"]))
    lam = F.col("expected") / F.col("particle_mass")
    planned = planned.withColumns({"base": F.floor(lam), "u01": R.uniform(F.col("gas_cell_id") * 1_000_003 + tick)})
    count = F.when(F.col("particle_mass").isNotNull(), F.col("base") + F.when(F.col("u01") < lam - F.col("base"), 1).otherwise(0)).otherwise(0)
    return planned.withColumn("n_stars", count.cast("int")).withColumn("taken", F.col("n_stars") * F.coalesce("particle_mass", F.lit(0.0))).drop("base")


def star_formation_commit(plan: DataFrame, tick: int) -> tuple[DataFrame, DataFrame]:
    """(cells, stars): gas, density, pressure and metals shrink in proportion; one row per new star with a tagged id."""
    kept = 1 - F.col("taken") / F.col("mass")
    shrunk = plan.withColumns({c: F.when(F.col("n_stars") > 0, F.col(c) * kept).otherwise(F.col(c)) for c in ("density", "pressure", "metal_mass")} | {"mass": F.col("mass") - F.col("taken")})
    stars = plan.where("n_stars > 0").select(
        "gas_cell_id", F.explode(F.sequence(F.lit(1), F.col("n_stars"))).alias("ordinal"), F.col("particle_mass").alias("birth_mass"), (F.col("metal_mass") / F.col("mass")).alias("metallicity"), "cx", "cy", "cz", "vx", "vy", "vz"
    ).withColumn("star_id", R.tagged_id(F.col("gas_cell_id") * 1_000_003 + tick + F.col("ordinal") * 7_919_000_001))
    return shrunk, stars


# --- cooling ------------------------------------------------------------------------------------------------

def birth_order(plan: DataFrame, ident: str = "gas_cell_id") -> DataFrame:
    """Adds ``place``, from 0, in order of ``ident``: a stitched rank. A cell that comes twice is an error at run time; rows without an id are left out."""
    from nebulith.operators.skew import stitched

    named = plan.where(F.col(ident).isNotNull()).withColumn("_all", F.lit(0))
    run = stitched(named, ["_all"], [ident], lags={"_before": ident})
    twice = F.col("_before").eqNullSafe(F.col(ident))
    place = F.when(twice, F.raise_error(F.concat(F.lit("a birth plan names twice the cell "), F.col(ident))).cast("long")).otherwise(F.col("_rn") - 1)
    return run.withColumn("place", place).drop("_rn", "_before", "_all")


def cool(cells: DataFrame, dt: float, fraction: float = 0.1, most: int = 64, floor: float = 1e-6, kelvin_per_energy: float = 1e4, unit: float = 1.0, redshift: float = 0.0, metal_rows: list[tuple[float, float]] | None = None) -> DataFrame:
    """Explicit subcycles, each of at most ``fraction`` of the cooling time, until ``dt`` or ``most`` of them: (energy, subcycles, hit_limit).

    The number of subcycles depends on the data, so batches are stepped together in numpy. Rows that aren't finite keep their energy.
    """
    ship(cells.sparkSession)
    table = np.array(metal_rows) if metal_rows else None

    def step(batches):
        for b in batches:
            e0 = b["internal_energy"].to_numpy(float)
            rho, n = np.maximum(b["density"].to_numpy(float), 1e-40), np.maximum(b["density"].to_numpy(float), 1e-12)
            z = np.maximum(np.nan_to_num(b["metal_mass"].to_numpy(float) / b["mass"].to_numpy(float)), 0.0)
            ok = np.isfinite(e0) & np.isfinite(rho)
            e, left, used = np.maximum(e0, floor), np.where(ok, dt, 0.0), np.zeros(len(b), int)
            uv = math.exp(-(((redshift - 2.0) / 2.5) ** 2))
            for i in range(most):
                on = left > 0
                if not on.any():
                    break
                t = np.maximum(e * kelvin_per_energy, 10.0)
                rate = 2e-24 * uv / (1 + (n / 1e-2) ** 1.6) * n - 1e-22 * np.sqrt(t / 1e4) * n * n
                if table is not None:
                    rate = rate - z * 10 ** np.interp(np.log10(t), table[:, 0], table[:, 1])
                de = rate / rho * unit
                stable = np.maximum(fraction * np.maximum(e, floor) / np.maximum(np.abs(de), 1e-30), 1e-14 * dt)
                h = np.minimum(left, stable)
                e = np.where(on, np.maximum(e + de * h, floor), e)
                left = np.where(on, left - h, left)
                used[on] = i + 1
            yield pd.DataFrame({"gas_cell_id": b["gas_cell_id"], "energy": np.where(ok, e, e0), "subcycles": used, "hit_limit": left > 1e-14 * dt})

    return cells.select("gas_cell_id", "internal_energy", "density", "mass", "metal_mass").mapInPandas(step, "gas_cell_id long, energy double, subcycles int, hit_limit boolean")


# --- black holes --------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Accretion:
    alpha: float = 1.0
    g: float = 43.0
    proton: float = 1.0
    efficiency: float = 0.1
    thomson: float = 2.0
    light: float = 300.0
    feedback: float = 0.05
    coupling: float = 1.0
    capped: bool = True
    duty_ratio: float = 0.01


_HOLE = ["bh", "host", "bh_mass", "mdot", "edd_ratio", "energy", "active_time", "vx", "vy", "vz", "gas_mass", "gas_metals", "gas_energy"]


def _accreted(r: dict, gas, rho, metals, energy, cfg: Accretion, dt: float) -> tuple[dict, tuple]:
    """What holes ``r`` (numbers or arrays) draw from cells in the given state: their new rows and the cells' new state."""
    mass = np.maximum(r["bh_mass"], 1e-30)
    v2 = sum((r[f"v{c}"] - r[f"gv{c}"]) ** 2 for c in "xyz")
    bondi = cfg.alpha * 4 * math.pi * cfg.g**2 * mass**2 * np.maximum(rho, 1e-20) / np.maximum(r["sound_speed"] ** 2 + v2, 1e-40) ** 1.5
    limit = 4 * math.pi * cfg.g * mass * cfg.proton / (cfg.efficiency * cfg.thomson * cfg.light)
    got = np.minimum(np.maximum((np.minimum(bondi, limit) if cfg.capped else bondi) * dt, 0.0), np.maximum(gas - 1e-30, 0.0))
    rate = got / dt
    power = cfg.feedback * cfg.efficiency * rate * cfg.light**2 * dt
    left = gas - got
    keep = np.where(gas > 0, left / np.where(gas > 0, gas, 1.0), 1.0)
    gas, rho, metals = left, rho * keep, metals * keep
    energy = np.where(gas > 1e-30, energy + power * cfg.coupling / np.where(gas > 1e-30, gas, 1.0), energy)
    ratio = rate / np.maximum(limit, 1e-30)
    new = r["bh_mass"] + got
    moved = (got > 0) & (new > 0)
    velocity = {f"v{c}": np.where(moved, (r["bh_mass"] * r[f"v{c}"] + got * r[f"gv{c}"]) / np.where(moved, new, 1.0), r[f"v{c}"]) for c in "xyz"}
    rows = {"bh_mass": new, "mdot": rate, "edd_ratio": ratio, "energy": power, "active_time": np.where(ratio >= cfg.duty_ratio, dt, 0.0), **velocity, "gas_mass": gas, "gas_metals": metals, "gas_energy": energy}
    return rows, (gas, rho, metals, energy)


def accrete(holes: DataFrame, cells: DataFrame, cfg: Accretion, dt: float) -> DataFrame:
    """(bh, host, bh_mass, mdot, edd_ratio, energy, active_time, gas_mass, gas_metals, gas_energy) after a step.

    Black holes that share a cell act one after the other in order of id, each seeing what the one before left. Rows
    stream sorted by (host, id): cells with one hole are worked on as whole arrays, only those with more hole by hole, and what is
    held of a cell is its state, however many holes it has. The gas columns are the cell's state after that hole.
    """
    ship(holes.sparkSession)
    joined = holes.join(cells, "host")
    numbers = ["bh_mass", "sound_speed", *[f"{p}v{c}" for p in ("", "g") for c in "xyz"]]
    gas_columns = ["gas_mass", "density", "metal_mass", "internal_energy"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, state = None, None  # the last host of the batch before and its state
        for batch in batches:
            n, host = len(batch), batch["host"].to_numpy()
            if not n:
                continue
            r = {c: batch[c].to_numpy(float) for c in numbers}
            gas = [batch[c].to_numpy(float) for c in gas_columns]
            new = np.concatenate([[before is None or host[0] != before], host[1:] != host[:-1]])
            single = new & np.concatenate([new[1:], [False]])  # the last row's host may go on in the next batch
            rows, _ = _accreted(r, *gas, cfg, dt)
            for i in np.flatnonzero(~single):
                if new[i]:
                    state = tuple(g[i] for g in gas)
                one, state = _accreted({c: v[i] for c, v in r.items()}, *state, cfg, dt)
                for c, v in one.items():
                    rows[c][i] = v
            before = host[-1]
            yield pd.DataFrame({"bh": batch["bh"].to_numpy(), "host": host, **rows})[_HOLE]

    ordered = joined.select("bh", "host", *numbers, *gas_columns).repartition("host").sortWithinPartitions("host", "bh")
    return ordered.mapInPandas(run, "bh long, host long, bh_mass double, mdot double, edd_ratio double, energy double, active_time double, vx double, vy double, vz double, gas_mass double, gas_metals double, gas_energy double")


def seed_candidates(cells: DataFrame, holes: DataFrame, halo_mass: float, seed_mass: float, most: int = 1) -> DataFrame:
    """Cells of halos over the threshold with more gas than a seed and fewer than ``most`` black holes."""
    held = holes.groupBy("host").agg(F.count("*").alias("n"))
    j = cells.join(held, cells["gas_cell_id"] == held["host"], "left")
    return j.where((F.col("halo_mass") >= halo_mass) & finite("mass") & (F.col("mass") > seed_mass) & (F.coalesce("n", F.lit(0)) < most)).select("gas_cell_id", "mass", "halo_mass")


# --- feedback -----------------------------------------------------------------------------------------------

def feedback_budget(stars: DataFrame, energy_per_mass: float, thermal: float, kinetic: float, momentum_per_mass: float, mode: str = "thermal_kinetic") -> DataFrame:
    """Mass, metals and energies by mode; more metals than returned mass is an error at run time."""
    energy = F.greatest("returned_mass", F.lit(0.0)) * energy_per_mass
    th, ki, mo = energy * thermal, energy * kinetic, F.col("returned_mass") * momentum_per_mass
    zero = F.lit(0.0)
    split = {"thermal": (th, zero, zero), "kinetic": (zero, ki, zero), "momentum": (zero, zero, mo), "thermal_kinetic": (th, ki, mo)}[mode]
    checked = F.when(F.col("returned_metals") > F.col("returned_mass") * (1 + 1e-12), F.raise_error(F.lit("more metals than mass returned")).cast("double")).otherwise(F.col("returned_metals"))
    return stars.withColumns({"returned_metals": checked, "thermal": split[0], "kinetic": split[1], "momentum": split[2]})


def deposit(budget: DataFrame, weights: DataFrame, cells: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cells, carry): budgets spread over each star's targets and summed per cell; energy ends as specific internal energy.

    Momentum is never deposited, and stars without a target carry all of their budget.
    """
    shares = weights.join(budget, keys)
    adds = shares.groupBy("cell").agg(*[F.sum(F.col("weight") * F.col(c)).alias(f"_{c}") for c in ("returned_mass", "returned_metals", "thermal", "kinetic")])
    j = cells.join(adds, "cell", "left").fillna(0.0, ["_returned_mass", "_returned_metals", "_thermal", "_kinetic"])
    mass = F.col("mass") + F.col("_returned_mass")
    out = j.withColumns({
        "density": F.when(F.col("mass") > 0, F.col("density") * mass / F.col("mass")).otherwise(F.col("density")), "metal_mass": F.col("metal_mass") + F.col("_returned_metals"),
        "internal_energy": F.when(mass > 0, (F.col("mass") * F.col("internal_energy") + F.col("_thermal") + F.col("_kinetic")) / mass).otherwise(F.col("internal_energy")), "mass": mass,
    }).drop("_returned_mass", "_returned_metals", "_thermal", "_kinetic")
    reached = weights.select(*keys).distinct().withColumn("_hit", F.lit(True))
    left = budget.join(reached, keys, "left")
    carry = left.select(*keys, "momentum", *[F.when(F.col("_hit"), 0.0).otherwise(F.col(c)).alias(f"carry_{c}") for c in ("returned_mass", "returned_metals", "thermal", "kinetic")])
    return out, carry


# --- metal diffusion ----------------------------------------------------------------------------------------

def _transfers(cells: DataFrame, faces: DataFrame) -> DataFrame:
    """Rate of metals from left to right over each face: conductance · (Z_left − Z_right)."""
    z = F.when(F.col("gas") > 0, F.col("metals") / F.col("gas")).otherwise(0.0)
    side = lambda k: cells.select(F.col("cell").alias(k), z.alias(f"z_{k}"))
    return faces.where("conductance > 0").join(side("left"), "left").join(side("right"), "right").withColumn("rate", F.col("conductance") * (F.col("z_left") - F.col("z_right")))


def diffusion_rate(cells: DataFrame, faces: DataFrame) -> DataFrame:
    """(cell, rate): what every cell gains; the sum over all cells is zero."""
    t = _transfers(cells, faces)
    both = t.select(F.col("left").alias("cell"), (-F.col("rate")).alias("r")).unionByName(t.select(F.col("right").alias("cell"), F.col("rate").alias("r")))
    return cells.select("cell").join(both.groupBy("cell").agg(F.sum("r").alias("rate")), "cell", "left").fillna(0.0, ["rate"])


def stable_step(cells: DataFrame, faces: DataFrame, courant: float) -> float:
    """Largest explicit step: courant · gas / Σ conductance, least over all cells."""
    ends = faces.where("conductance > 0").select(F.explode(F.array("left", "right")).alias("cell"), "conductance").groupBy("cell").agg(F.sum("conductance").alias("c"))
    out = cells.where("gas > 0").join(ends, "cell").agg(F.min(courant * F.col("gas") / F.col("c"))).first()[0]
    return float("inf") if out is None else out


def limited_euler(cells: DataFrame, faces: DataFrame, dt: float) -> DataFrame:
    """One step in which no cell gives more metals than it has nor takes more than its gas can hold."""
    t = _transfers(cells, faces).withColumns({"donor": F.when(F.col("rate") > 0, F.col("left")).otherwise(F.col("right")), "taker": F.when(F.col("rate") > 0, F.col("right")).otherwise(F.col("left")), "amount": F.abs("rate") * dt})
    gives = t.groupBy(F.col("donor").alias("cell")).agg(F.sum("amount").alias("out"))
    takes = t.groupBy(F.col("taker").alias("cell")).agg(F.sum("amount").alias("in"))
    scales = cells.join(gives, "cell", "left").join(takes, "cell", "left").select(
        "cell", F.when(F.col("out") > F.col("metals"), F.col("metals") / F.col("out")).otherwise(1.0).alias("give"),
        F.when(F.col("in") > F.greatest(F.col("gas") - F.col("metals"), F.lit(0.0)), F.greatest(F.col("gas") - F.col("metals"), F.lit(0.0)) / F.col("in")).otherwise(1.0).alias("take"),
    )
    moved = t.join(scales.select(F.col("cell").alias("donor"), "give"), "donor").join(scales.select(F.col("cell").alias("taker"), "take"), "taker").withColumn("moved", F.col("amount") * F.least("give", "take"))
    delta = moved.select(F.col("donor").alias("cell"), (-F.col("moved")).alias("d")).unionByName(moved.select(F.col("taker").alias("cell"), F.col("moved").alias("d"))).groupBy("cell").agg(F.sum("d").alias("d"))
    return cells.join(delta, "cell", "left").withColumn("metals", F.col("metals") + F.coalesce("d", F.lit(0.0))).drop("d")


def limited_rk2(cells: DataFrame, faces: DataFrame, dt: float) -> DataFrame:
    """Two limited steps averaged with the start."""
    scratch = Scratch(cells.sparkSession, "diffusion")
    once = scratch.write(limited_euler(cells, faces, dt))
    twice = limited_euler(once, faces, dt).select("cell", F.col("metals").alias("_two"))
    return cells.join(twice, "cell").withColumn("metals", 0.5 * F.col("metals") + 0.5 * F.col("_two")).drop("_two")


def super_time_step(cells: DataFrame, faces: DataFrame, dt: float, courant: float = 0.4, most: int = 32) -> tuple[DataFrame, int]:
    """Second-order Legendre super time step; the stages follow from dt over the explicit step. Each stage is a written table."""
    explicit = stable_step(cells, faces, courant)
    s = 2 if not dt > explicit else min(max(math.ceil(0.5 * (-1 + math.sqrt(9 + 16 * dt / explicit))), 2), most)
    scratch = Scratch(cells.sparkSession, "rkl2")
    b = [1 / 3, 1 / 3, *[(j * j + j - 2) / (2 * j * (j + 1)) for j in range(2, s + 1)]]
    w1 = 4 / (s * s + s - 2)
    start = scratch.write(cells.select("cell", "gas", "metals"))
    base = scratch.write(diffusion_rate(start, faces))
    older = start
    now = scratch.write(start.join(base, "cell").select("cell", "gas", (F.col("metals") + b[1] * w1 * dt * F.col("rate")).alias("metals")))
    for j in range(2, s + 1):
        mu, nu = (2 * j - 1) / j * b[j] / b[j - 1], -(j - 1) / j * b[j] / b[j - 2]
        mt = mu * w1
        gt = -(1 - b[j - 1]) * mt
        rate = diffusion_rate(now, faces).withColumnRenamed("rate", "_r")
        nxt = (
            now.withColumnRenamed("metals", "_1").join(older.select("cell", F.col("metals").alias("_2")), "cell").join(start.select("cell", F.col("metals").alias("_0")), "cell").join(base.withColumnRenamed("rate", "_b"), "cell").join(rate, "cell")
            .select("cell", "gas", (mu * F.col("_1") + nu * F.col("_2") + (1 - mu - nu) * F.col("_0") + mt * dt * F.col("_r") + gt * dt * F.col("_b")).alias("metals"))
        )
        older, now = now, scratch.write(nxt)
    return now, s


# --- tracers ------------------------------------------------------------------------------------------------

def inject_tracers(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """fraction = injected / host mass; ``state`` tells rejected requests: no host, host without mass, negative mass."""
    j = requests.join(cells.select(F.col("gas_cell_id").alias("host"), F.col("mass").alias("host_mass"), F.lit(True).alias("_found")), "host", "left")
    state = F.when(F.col("_found").isNull(), "no_host").when(~(F.col("host_mass") > 0), "empty_host").when(F.col("injected") < 0, "negative").otherwise("ok")
    return j.withColumn("state", state).withColumn("fraction", F.when(F.col("state") == "ok", F.col("injected") / F.col("host_mass"))).drop("_found")


def update_tracers(tracers: DataFrame, cells: DataFrame, least_host: float = 0.0) -> DataFrame:
    """New mass = fraction · host mass with the exchanged mass added up; skipped rows keep their values and say why."""
    hosts = cells.select(F.col("gas_cell_id").alias("tracer_host"), F.col("mass").alias("_host"), F.col("active").alias("_active"), F.lit(True).alias("_found"))
    j = tracers.join(hosts, "tracer_host", "left")
    state = F.when(F.col("_found").isNull(), "invalid_host").when(~F.col("_active"), "inactive_host").when(~(F.col("_host") > least_host), "low_host_mass").otherwise("updated")
    new = F.col("fraction") * F.col("_host")
    on = F.col("state") == "updated"
    return j.withColumn("state", state).withColumns({
        "exchanged": F.when(on, F.col("exchanged") + F.abs(new - F.col("tracer_mass"))).otherwise(F.col("exchanged")), "last_host_mass": F.when(on, F.col("_host")).otherwise(F.col("last_host_mass")),
        "tracer_mass": F.when(on, new).otherwise(F.col("tracer_mass")),
    }).drop("_host", "_active", "_found")


# --- effective equation of state ----------------------------------------------------------------------------

@dataclass(frozen=True)
class EffectiveGas:
    bins: int = 64
    most_ratio: float = 1e4
    threshold: float = 1.0
    t_star: float = 2.0
    evaporation: float = 1000.0
    exponent: float = -0.8
    supernova: float = 1e4
    cold: float = 10.0
    isothermal: float = 150.0
    beta: float = 0.1
    q: float = 1.0
    gamma: float = 5 / 3
    cooling_scale: float = 1e-2


def effective_table(spark, cfg: EffectiveGas) -> DataFrame:
    """(bin, density, hot, cold_fraction, energy, pressure, signal_speed2) over density ratios spaced evenly in the logarithm.

    Hot gas balances supernovae against evaporation and cooling; the table's energy is shifted to meet the isothermal
    one at the threshold, and the signal speed is the derivative of pressure, a polytropic one where that isn't positive.
    """
    from nebulith.operators.tables import central_derivative

    ratio = F.exp(F.col("id") / (cfg.bins - 1) * math.log(cfg.most_ratio))
    t = spark.range(cfg.bins).select(F.col("id").alias("bin"), ratio.alias("ratio")).withColumn("density", F.col("ratio") * cfg.threshold)
    hot = cfg.cold + cfg.supernova / (1 + cfg.evaporation * F.pow("ratio", F.lit(cfg.exponent)))
    t = t.withColumns({"hot": hot, "t_star": cfg.t_star / F.sqrt("ratio")})
    cool_time = cfg.cooling_scale * F.sqrt("hot") / F.col("ratio")
    y = F.col("t_star") / cool_time * F.col("hot") / (cfg.beta * cfg.supernova - (1 - cfg.beta) * cfg.cold)
    # the root in (0, 1) of x = 1 + 1/(2y) − √(1/y + 1/(4y²)), in a form that is stable for small y
    x = F.when(y > 0, 2 * y / (1 + 2 * y + F.sqrt(1 + 4 * y))).otherwise(0.0)
    t = t.withColumn("cold_fraction", x)
    full = (1 - F.col("cold_fraction")) * F.col("hot") + F.col("cold_fraction") * cfg.cold
    t = t.withColumn("raw", cfg.q * full + (1 - cfg.q) * cfg.isothermal)
    first = t.where("bin = 0").select(F.col("raw").alias("first"))
    t = t.join(F.broadcast(first), F.lit(True)).withColumn("energy", F.greatest(F.col("raw") + (cfg.isothermal - F.col("first")), F.lit(cfg.cold)))  # first: one row
    t = t.withColumn("pressure", (cfg.gamma - 1) * F.col("density") * F.col("energy"))
    d = central_derivative(t, "bin", "density", "pressure")
    return d.select("bin", "density", "hot", "cold_fraction", "energy", "pressure", F.when(F.col("derivative") > 0, F.col("derivative")).otherwise(cfg.gamma * F.col("pressure") / F.col("density")).alias("signal_speed2"))


def relax_to_effective(energy: Column, effective: Column, dt: float, timescale: float) -> tuple[Column, Column]:
    """Energy relaxed exponentially to the effective one, and what that adds."""
    new = effective + (energy - effective) * math.exp(-dt / timescale)
    return new, new - energy


def velocity_gradient(cells: DataFrame, n: int, dx: float) -> DataFrame:
    """Central differences of (u, v, w) along the three axes of a periodic grid: columns g_<component><axis>."""
    from nebulith.operators.hydro_step import INDEX, VELOCITY, neighbours

    out = None
    for axis in range(3):
        d = neighbours(cells, n, axis).select(*INDEX, *[((F.col(f"hi.{v}") - F.col(f"lo.{v}")) / (2 * dx)).alias(f"g_{v}{'xyz'[axis]}") for v in VELOCITY])
        out = d if out is None else out.join(d, list(INDEX))
    return out


def run_sources(state: dict[str, DataFrame], stages: list[tuple[str, object]]) -> dict[str, DataFrame]:
    """Source stages in their order: star formation, stellar evolution and enrichment, diffusion, black holes. Each maps the tables to new ones."""
    for _, stage in stages:
        state = stage(state)
    return state
