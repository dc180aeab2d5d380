"""Counter-based random numbers and ids: 64-bit mixing on whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from nebulith.runtime import ship

ID_TAG = 1 << 63  # fixed: marks generated particle ids


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 (published constants) on unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _mix(values: pd.Series) -> pd.Series:
    return pd.Series(mix64(values.to_numpy(np.int64).view(np.uint64)).view(np.int64))


def _uniform(values: pd.Series) -> pd.Series:
    return pd.Series((mix64(values.to_numpy(np.int64).view(np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53)


def mixed(c: Column) -> Column:
    """The mixed counter as a signed long; its bits are those of the unsigned result."""
    ship()
    return F.pandas_udf(_mix, "long")(c.cast("long"))


def uniform(c: Column) -> Column:
    """A number in [0, 1) from a counter: the upper 53 bits of the mixed value."""
    ship()
    return F.pandas_udf(_uniform, "double")(c.cast("long"))


def unsigned(c: Column) -> Column:
    """A signed long read as an unsigned one."""
    wide = c.cast("decimal(20,0)")
    return F.when(c < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def tagged_id(c: Column) -> Column:
    """An id for a generated particle: the top bit set, the rest from the mixed key. Negative as a signed long."""
    return mixed(c).bitwiseOR(F.lit(-(1 << 63)).cast("long"))
