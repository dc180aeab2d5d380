"""Matter power spectrum: mass on a mesh, its transform by planes and lines, shells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulith.operators.base import dense_bins, finite
from nebulith.operators.diagnostics import mass_on_grid
from nebulith.operators.mesh_fft import forward

FLOOR = 1e-24


def density_modes(grid: DataFrame, n: int) -> DataFrame:
    """(nx, ny, nz, re, im) of sum(δ exp(-2πi …)) / n³ from (ix, iy, iz, mass). Points without a row hold no mass."""
    total = grid.agg(F.sum("mass").alias("total"))
    modes = forward(grid.join(F.broadcast(total), F.lit(True)).withColumn("mass", F.col("mass") / F.col("total")), n, "mass")  # total: one row
    # the mean's own transform is 1 at the zero mode only
    zero = (F.col("nx") == 0) & (F.col("ny") == 0) & (F.col("nz") == 0)
    return modes.withColumn("re", F.when(zero, F.col("re") - 1).otherwise(F.col("re")))


def direct_modes(grid: DataFrame, n: int) -> DataFrame:
    """The same modes by three one-dimensional sums, each a distributed aggregation: the second algorithm."""
    total = grid.agg(F.sum("mass").alias("total"))
    now = grid.join(F.broadcast(total), F.lit(True)).select("ix", "iy", "iz", (F.col("mass") / F.col("total")).alias("re"), F.lit(0.0).alias("im"))  # total: one row
    for axis, mode in (("ix", "nx"), ("iy", "ny"), ("iz", "nz")):
        wide = now.withColumn(mode, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        angle = -2 * math.pi / n * F.col(axis) * F.col(mode)
        re, im = F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle), F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)
        keys = [c for c in wide.columns if c not in (axis, "re", "im")]
        now = wide.groupBy(*keys).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    # the mean's own transform is 1 at the zero mode only
    zero = (F.col("nx") == 0) & (F.col("ny") == 0) & (F.col("nz") == 0)
    return now.select("nx", "ny", "nz", F.when(zero, F.col("re") - 1).otherwise(F.col("re")).alias("re"), "im")


def signed_mode(c: Column, n: int) -> Column:
    return F.when(c <= n // 2, c).otherwise(c - n)


def sinc(c: Column) -> Column:
    return F.when(c == 0, 1.0).otherwise(F.sin(c) / c)


def shell_spectrum(modes: DataFrame, n: int, bins: int, box: float, exponent: int = 0, shot_noise: float = 0.0, subtract: bool = False) -> DataFrame:
    """Mean wave number and power per shell; the last shell keeps its upper edge and empty shells stay with the middle of the bin.

    ``exponent`` is that of the assignment window to divide out (0: none, 1: nearest point, 2: cloud in cell, 3: three points).
    """
    base = 2 * math.pi / box
    width = math.sqrt(3.0) * (n // 2) * base / bins
    k = [signed_mode(F.col(c), n) for c in ("nx", "ny", "nz")]
    size = F.sqrt((k[0] * k[0] + k[1] * k[1] + k[2] * k[2]).cast("double")) * base
    power = F.lit(box**3) * (F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    if exponent:
        window = F.pow(sinc(math.pi * k[0] / n) * sinc(math.pi * k[1] / n) * sinc(math.pi * k[2] / n), F.lit(exponent))
        power = power / F.greatest(window * window, F.lit(FLOOR))
    if subtract:
        power = power - shot_noise
    found = modes.select(size.alias("k"), power.alias("power")).where("k > 0").groupBy(F.least(F.floor(F.col("k") / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.avg("k").alias("k_mean"), F.avg("power").alias("power"), F.count("*").alias("mode_count")
    )
    full = dense_bins(found, {"bin": bins}, {"power": 0.0, "mode_count": 0})
    return full.select("bin", F.coalesce("k_mean", (F.col("bin") + 0.5) * width).alias("k_center"), "power", "mode_count")


def shot_noise(particles: DataFrame, box: float) -> float:
    """V Σm² / (Σm)²."""
    s, q = particles.where(finite("x", "y", "z", "mass")).agg(F.sum("mass"), F.sum(F.col("mass") * F.col("mass"))).first()
    return box**3 * q / s**2 if s else 0.0


def power_spectrum(particles: DataFrame, n: int, bins: int, box: float, scheme: str = "cic", deconvolve: bool = True, subtract: bool = False, direct: bool = False) -> DataFrame:
    """P(k) of all particles. ``direct`` takes the modes from the three sums instead of the transform."""
    grid = mass_on_grid(particles, n, box, scheme)
    modes = direct_modes(grid, n) if direct else density_modes(grid, n)
    return shell_spectrum(modes, n, bins, box, {"ngp": 1, "cic": 2, "tsc": 3}[scheme] if deconvolve else 0, shot_noise(particles, box) if subtract else 0.0, subtract)


def legacy_spectrum(particles: DataFrame, n: int, bins: int, box: float) -> DataFrame:
    """Nearest-cell mass, no deconvolution, and shells without a mode dropped."""
    return power_spectrum(particles, n, bins, box, "ngp", deconvolve=False).where("mode_count > 0")
