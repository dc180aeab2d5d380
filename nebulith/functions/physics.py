"""Rates and scales of the subgrid models as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from nebulith.runtime import ship

DENSITY_FLOOR = TIME_FLOOR = MASS_FLOOR = 1e-30


def softened_inverse_cube(r2: Column, eps: Column) -> Column:
    """(r² + ε²)^(-3/2); a root and a product, as the power function takes many times longer. At 0 it is infinite."""
    s = r2 + eps * eps
    return F.when(s > 0, 1 / (s * F.sqrt(s))).otherwise(F.pow(s, F.lit(-1.5)))


def _erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc, na_action="ignore").astype(np.float64)


def erfc(x: Column) -> Column:
    """The engine has no error function; whole Arrow batches go through the library's."""
    ship()
    return F.pandas_udf(_erfc, "double")(x)


def short_range_factor(r: Column, split: float) -> Column:
    """erfc(q) + 2 q / √π · exp(−q²) with q = r / (2 r_s); the long-range factor is one less this."""
    q = r / (2 * split)
    return erfc(q) + 2 * q / math.sqrt(math.pi) * F.exp(-q * q)


def fourier_split(k2: Column, split: float) -> Column:
    return F.exp(-k2 * F.lit(split * split))


def free_fall_time(rho: Column, g: float) -> Column:
    """Infinite where the density isn't positive."""
    return F.when(rho > 0, F.sqrt(3 * math.pi / (32 * g * F.greatest(rho, F.lit(DENSITY_FLOOR))))).otherwise(F.lit(float("inf")))


def jeans_mass(rho: Column, cs: Column, g: float) -> Column:
    bottom = F.greatest(F.lit(g**1.5) * F.sqrt(rho), F.lit(DENSITY_FLOOR))
    return F.when((rho > 0) & (cs >= 0), F.lit(math.pi**2.5 / 6) * cs**3 / bottom).otherwise(F.lit(float("inf")))


def virial_parameter(rho: Column, width: Column, cs: Column, gradient2: Column, g: float) -> Column:
    """(|∇v|² + 2 (c_s/Δ)²) / (8 π G ρ)."""
    support = (cs / width) ** 2
    return (gradient2 + 2 * support) / F.greatest(8 * math.pi * g * rho, F.lit(DENSITY_FLOOR))


def compression_time(divergence: Column) -> Column:
    return F.when(divergence < 0, -1 / divergence).otherwise(F.lit(float("inf")))


def uv_scale(z: Column, model: str) -> Column:
    if model == "none":
        return F.lit(0.0)
    if model == "gaussian":  # peak at redshift 2, width 2.5
        return F.exp(-(((z - 2.0) / 2.5) ** 2))
    return 1 / (1 + ((1 + z) / 4.0) ** 2)


def self_shielding(n_h: Column, on: bool = True) -> Column:
    return 1 / (1 + F.pow(n_h / 1e-2, F.lit(1.6))) if on else F.lit(1.0)


def cooling_heating(temperature: Column, n_h: Column, z: Column, metallicity: Column, metal_rate: Column, floor: float = 10.0, uv: str = "gaussian") -> tuple[Column, Column]:
    """(cooling, heating): primordial 1e-22 √(T/1e4) n² and metal lines as table(T) · Z, which has no density factor."""
    t, n = F.greatest(temperature, F.lit(floor)), F.greatest(n_h, F.lit(1e-12))
    cooling = 1e-22 * F.sqrt(t / 1e4) * n * n + metal_rate * F.greatest(metallicity, F.lit(0.0))
    return cooling, 2e-24 * uv_scale(z, uv) * self_shielding(n) * n


def bondi(mass: Column, rho: Column, cs: Column, v: Column, alpha: float, g: float) -> Column:
    return alpha * 4 * math.pi * g * g * F.greatest(mass, F.lit(MASS_FLOOR)) ** 2 * F.greatest(rho, F.lit(1e-20)) / F.pow(F.greatest(cs * cs + v * v, F.lit(1e-40)), F.lit(1.5))


def eddington(mass: Column, g: float, proton: float, efficiency: float, thomson: float, light: float) -> Column:
    return 4 * math.pi * g * F.greatest(mass, F.lit(MASS_FLOOR)) * proton / (efficiency * thomson * light)


def shear(gradient: list[list[Column]]) -> Column:
    """√(2 S:S) of the trace-free symmetric part of a 3×3 gradient."""
    trace = (gradient[0][0] + gradient[1][1] + gradient[2][2]) / 3
    total = F.lit(0.0)
    for i in range(3):
        for j in range(3):
            s = 0.5 * (gradient[i][j] + gradient[j][i]) - (trace if i == j else 0.0)
            total = total + s * s
    return F.sqrt(2 * total)


def smagorinsky(strain: Column, width: Column, coefficient: float, most: float) -> Column:
    return F.least(coefficient * width * width * strain, F.lit(most))


def time_bin(dt: Column, dt_min: float, max_bin: int) -> Column:
    """The largest bin b with dt_min · 2^b ≤ dt, clamped; a step under the least one gives 0."""
    out = F.lit(0)
    for b in range(1, max_bin + 1):
        out = F.when(dt >= dt_min * 2.0**b, b).otherwise(out)
    return out


def gravity_step(eps: Column, acc: Column, eta: float, a: Column | None = None) -> Column:
    size = F.abs(acc) if a is None else F.abs(acc) / a**3
    return eta * F.sqrt(eps / size)


def expansion_step(hubble: Column, dlna: Column, fraction: float) -> Column:
    return F.least(dlna, F.lit(fraction)) / hubble


def least_step(*steps: Column) -> Column:
    """The least of the criteria that give one; null is no criterion, and one that isn't finite and positive is left out."""
    clean = [F.when((s > 0) & (s < float("inf")) & ~F.isnan(s), s) for s in steps]
    return F.least(*clean)
