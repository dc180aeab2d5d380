"""Ideal-gas states, slope limiters and interface fluxes as struct-valued columns, so they stay in generated code.

A primitive state is a struct (rho, u, v, w, p, z) and a conserved state or flux a struct (d, mx, my, mz, e, zd),
with u along the face normal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 1e-14
PRIMITIVE, CONSERVED = ("rho", "u", "v", "w", "p", "z"), ("d", "mx", "my", "mz", "e", "zd")


def state(names: tuple[str, ...], *values: Column) -> Column:
    return F.struct(*[v.alias(n) for n, v in zip(names, values)])


def combine(f: Callable[..., Column], *states: Column) -> Column:
    """A conserved struct, field by field from those of ``states``."""
    return state(CONSERVED, *[f(*[s[n] for s in states]) for n in CONSERVED])


def conserved(q: Column, gamma: float) -> Column:
    kinetic = 0.5 * q["rho"] * (q["u"] ** 2 + q["v"] ** 2 + q["w"] ** 2)
    return state(CONSERVED, q["rho"], q["rho"] * q["u"], q["rho"] * q["v"], q["rho"] * q["w"], q["p"] / (gamma - 1) + kinetic, q["rho"] * q["z"])


def primitive(c: Column, gamma: float) -> Column:
    """Pressure is floored; a density that isn't positive gives a null state."""
    d = c["d"]
    internal = c["e"] - 0.5 * (c["mx"] ** 2 + c["my"] ** 2 + c["mz"] ** 2) / d
    return F.when(d > 0, state(PRIMITIVE, d, c["mx"] / d, c["my"] / d, c["mz"] / d, F.greatest((gamma - 1) * internal, F.lit(SMALL)), F.least(F.greatest(c["zd"] / d, F.lit(0.0)), F.lit(1.0))))


def sound_speed(q: Column, gamma: float) -> Column:
    return F.sqrt(F.greatest(gamma * F.greatest(q["p"], F.lit(SMALL)) / F.greatest(q["rho"], F.lit(SMALL)), F.lit(SMALL)))


def physical_flux(q: Column, gamma: float) -> Column:
    c, m = conserved(q, gamma), q["rho"] * q["u"]
    return state(CONSERVED, m, m * q["u"] + q["p"], m * q["v"], m * q["w"], (c["e"] + q["p"]) * q["u"], m * F.least(F.greatest(q["z"], F.lit(0.0)), F.lit(1.0)))


def wave_speeds(left: Column, right: Column, gamma: float) -> tuple[Column, Column]:
    cl, cr = sound_speed(left, gamma), sound_speed(right, gamma)
    return F.least(left["u"] - cl, right["u"] - cr), F.greatest(left["u"] + cl, right["u"] + cr)


def _with_waves(faces: DataFrame, left: str, right: str, gamma: float) -> DataFrame:
    """Wave speeds, conserved states and physical fluxes of both sides as columns of their own, so that each is computed once."""
    l, r = F.col(left), F.col(right)
    sl, sr = wave_speeds(l, r, gamma)
    return faces.withColumns({"_sl": sl, "_sr": sr, "_cl": conserved(l, gamma), "_cr": conserved(r, gamma), "_fl": physical_flux(l, gamma), "_fr": physical_flux(r, gamma)})


def _two_wave() -> Column:
    sl, sr = F.col("_sl"), F.col("_sr")
    middle = combine(lambda a, b, ul, ur: (sr * a - sl * b + sl * sr * (ur - ul)) / F.greatest(sr - sl, F.lit(SMALL)), *[F.col(c) for c in ("_fl", "_fr", "_cl", "_cr")])
    return F.when(sl >= 0, F.col("_fl")).when(sr <= 0, F.col("_fr")).otherwise(middle.withField("zd", F.lit(0.0)))


def hlle(faces: DataFrame, left: str, right: str, gamma: float, out: str) -> DataFrame:
    """Adds the two-wave flux of the states ``left`` and ``right``. Between the waves the metal flux stays zero."""
    waved = _with_waves(faces, left, right, gamma)
    return waved.withColumn(out, _two_wave()).drop("_sl", "_sr", "_cl", "_cr", "_fl", "_fr")


def hllc(faces: DataFrame, left: str, right: str, gamma: float, out: str) -> DataFrame:
    """Adds the three-wave flux and ``<out>_fallback``: whether degenerate star states gave the two-wave one instead."""
    l, r, sl, sr, contact, pressure = (F.col(c) for c in (left, right, "_sl", "_sr", "_sc", "_ps"))
    waved = _with_waves(faces, left, right, gamma).withColumns({"_ml": l["rho"] * (sl - l["u"]), "_mr": r["rho"] * (sr - r["u"])})
    ml, mr = F.col("_ml"), F.col("_mr")
    waved = waved.withColumn("_sc", (r["p"] - l["p"] + ml * l["u"] - mr * r["u"]) / F.when(F.abs(ml - mr) >= SMALL, ml - mr))
    waved = waved.withColumn("_ps", 0.5 * (l["p"] + ml * (contact - l["u"]) + r["p"] + mr * (contact - r["u"])))

    def star(q: Column, c: Column, s: Column, m: Column) -> Column:
        rho = m / F.when(F.abs(s - contact) >= SMALL, s - contact)
        energy = rho * ((s - q["u"]) * c["e"] - q["p"] * q["u"] + pressure * contact) / F.when(F.abs(m) >= SMALL, m)
        z = F.least(F.greatest(q["z"], F.lit(0.0)), F.lit(1.0))
        return F.when((rho > 0) & (energy > 0), state(CONSERVED, rho, rho * contact, rho * q["v"], rho * q["w"], energy, rho * z))

    waved = waved.withColumns({"_tl": star(l, F.col("_cl"), sl, ml), "_tr": star(r, F.col("_cr"), sr, mr)})
    fine = F.coalesce((pressure > 0) & F.col("_tl").isNotNull() & F.col("_tr").isNotNull(), F.lit(False))
    add = lambda f, s, t, c: combine(lambda a, b, d: a + s * (b - d), F.col(f), F.col(t), F.col(c))
    three = F.when(contact >= 0, add("_fl", sl, "_tl", "_cl")).otherwise(add("_fr", sr, "_tr", "_cr"))
    flux = F.when((sl >= 0) | (sr <= 0) | ~fine, _two_wave()).otherwise(three)
    done = waved.withColumns({out: flux, f"{out}_fallback": (sl < 0) & (sr > 0) & ~fine})
    return done.drop("_sl", "_sr", "_cl", "_cr", "_fl", "_fr", "_ml", "_mr", "_sc", "_ps", "_tl", "_tr")


def minmod(a: Column, b: Column) -> Column:
    return F.when(a * b <= 0, 0.0).when(F.abs(a) < F.abs(b), a).otherwise(b)


def monotonized_central(a: Column, b: Column) -> Column:
    """The least of twice either difference and their mean, zero at an extremum."""
    size = F.least(2 * F.abs(a), 2 * F.abs(b), 0.5 * F.abs(a + b))
    return F.when(a * b <= 0, 0.0).otherwise(F.signum(a) * size)


def van_leer(a: Column, b: Column) -> Column:
    return F.when(a * b <= 0, 0.0).otherwise(2 * a * b / (a + b))


LIMITERS = {"minmod": minmod, "mc": monotonized_central, "van_leer": van_leer}


def cfl_step(width: Column, speed: Column, sound: Column, courant: float) -> Column:
    return courant * width / (F.abs(speed) + sound)


def cfl_step_3d(width: Column, velocity: tuple[Column, Column, Column], sound: Column, courant: float, a: Column | None = None) -> Column:
    """The least over the axes; comoving widths are stretched by the scale factor."""
    w = width if a is None else width * a
    return F.least(*[cfl_step(w, v, sound, courant) for v in velocity])
