"""Space-filling-curve keys as column expressions. The two orders are different on purpose and stay separate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TREE_BITS, DOMAIN_BITS = 21, 10


def spread3(c: Column, bits: int) -> Column:
    """Bit i of an integer moved to bit 3i."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1).cast("long")), 3 * i))
    return out


def unspread3(c: Column, bits: int) -> Column:
    """The inverse of ``spread3``."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(c, 3 * i).bitwiseAND(F.lit(1).cast("long")), i))
    return out


def interleave(high: Column, mid: Column, low: Column, bits: int) -> Column:
    return F.shiftleft(spread3(high, bits), 2).bitwiseOR(F.shiftleft(spread3(mid, bits), 1)).bitwiseOR(spread3(low, bits))


def tree_key(x: Column, y: Column, z: Column, low: tuple[Column, Column, Column], extent: Column) -> Column:
    """21 bits per axis, rounded to the grid of the largest extent; x is the highest bit."""
    grid = F.lit(float(2**TREE_BITS - 1))
    q = [F.floor(F.least(F.greatest((c - lo) / F.greatest(extent, F.lit(1e-12)), F.lit(0.0)), F.lit(1.0)) * grid + 0.5).cast("long") for c, lo in zip((x, y, z), low)]
    return interleave(*q, TREE_BITS)


def domain_key(x: Column, y: Column, z: Column, box: float) -> Column:
    """10 bits per axis by floor, clamped to 1023; z is the highest bit."""
    q = [F.least(F.greatest(F.floor(c / box * 1024), F.lit(0)), F.lit(1023)).cast("long") for c in (x, y, z)]
    return interleave(q[2], q[1], q[0], DOMAIN_BITS)
