"""Units, background expansion and time integrals as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values in SI
NEWTON_G = 6.67430e-11
MPC = 3.0856775814913673e22
MSUN = 1.98847e30
HUBBLE_100 = 1.0e5 / MPC


@dataclass(frozen=True)
class CodeUnits:
    """SI values of one code unit."""

    length: float = MPC / 1000
    mass: float = 1e10 * MSUN
    velocity: float = 1000.0

    @property
    def time(self) -> float:
        return self.length / self.velocity

    @property
    def density(self) -> float:
        return self.mass / self.length**3

    @property
    def newton_g(self) -> float:
        """G in code units: G · M · T² / L³."""
        return NEWTON_G * self.mass * self.time**2 / self.length**3

    def factor(self, quantity: str, system: str = "si") -> float:
        """What turns a code value into SI or CGS."""
        cgs = {"length": 1e2, "mass": 1e3, "velocity": 1e2, "time": 1.0, "density": 1e-3}
        return getattr(self, quantity) * (cgs[quantity] if system == "cgs" else 1.0)


@dataclass(frozen=True)
class Background:
    """Flat or curved universe with matter, Λ, radiation."""

    h: float = 0.7
    matter: float = 0.3
    dark_energy: float = 0.7
    radiation: float = 0.0
    curvature: float = 0.0

    @property
    def hubble0(self) -> float:
        return self.h * HUBBLE_100

    def e(self, a: Column) -> Column:
        return F.sqrt(F.lit(self.radiation) / a**4 + F.lit(self.matter) / a**3 + F.lit(self.curvature) / a**2 + F.lit(self.dark_energy))

    def hubble(self, a: Column) -> Column:
        return F.lit(self.hubble0) * self.e(a)

    def critical_density(self, a: Column) -> Column:
        return 3 * self.hubble(a) ** 2 / F.lit(8 * math.pi * NEWTON_G)

    def e_of(self, a: float) -> float:
        return math.sqrt(self.radiation / a**4 + self.matter / a**3 + self.curvature / a**2 + self.dark_energy)

    def cosmic_time(self, begin: Column, end: Column, steps: int = 256) -> Column:
        """∫ da / (a H) by Simpson's rule with a fixed number of steps; negative backwards."""
        width = (end - begin) / steps
        at = lambda i: begin + width * i
        weight = lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        total = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda acc, i: acc + weight(i) / (at(i) * self.hubble(at(i))))
        return total * width / 3

    def midpoint_sum(self, begin: Column, end: Column, power: int, steps: int = 32) -> Column:
        """Σ Δa / (a^power H) at the middles of equal steps: drift (3), cosmic time (1)."""
        width = (end - begin) / steps
        at = lambda i: begin + width * (i + 0.5)
        return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0.0), lambda acc, i: acc + width / (at(i) ** power * self.hubble(at(i))))

    def drift(self, begin: Column, end: Column, steps: int = 32) -> Column:
        return self.midpoint_sum(begin, end, 3, steps)

    def kick(self, begin: Column, end: Column, steps: int = 32) -> Column:
        return self.midpoint_sum(begin, end, 2, steps) / end

    @staticmethod
    def drag(begin: Column, end: Column) -> Column:
        return begin / end

    def advance(self, a: float, seconds: float) -> float:
        """The scale factor after a time, by doubling a bracket and bisecting it; a scalar for the step loop."""

        def elapsed(b: float, n: int = 512) -> float:
            w = (b - a) / n
            f = lambda x: 1 / (x * self.hubble0 * self.e_of(x))
            return w / 3 * (f(a) + f(b) + 4 * sum(f(a + w * i) for i in range(1, n, 2)) + 2 * sum(f(a + w * i) for i in range(2, n, 2)))

        high = a * 1.001
        while elapsed(high) < seconds:
            high = a + 2 * (high - a)
        low = a
        for _ in range(96):
            mid = 0.5 * (low + high)
            low, high = (mid, high) if elapsed(mid) < seconds else (low, mid)
        return 0.5 * (low + high)


def to_scale_factor(z: Column) -> Column:
    return 1 / (1 + z)


def consistent(a: Column, z: Column, tolerance: float = 1e-4) -> Column:
    """a and z tell the same; a missing one doesn't contradict."""
    return F.coalesce(F.abs(a * (1 + z) - 1) <= tolerance, F.lit(True))


def comoving_to_physical(x: Column, a: Column) -> Column:
    return x * a


def peculiar_velocity(comoving_rate: Column, a: Column) -> Column:
    return comoving_rate * a
