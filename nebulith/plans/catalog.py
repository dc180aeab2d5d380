"""A register of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulith.operators.base import current, finite
from nebulith.runtime import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a data directory by attribute; ``current_x`` has the copies of rows sent again removed."""

    KEYS = {"particles": "particle_id", "cells": "gas_cell_id", "tracers": "particle_id", "amr_ghosts": "ghost_id"}

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("current_"):
            return current(read_table(self.spark, self.d, name[8:]), self.KEYS[name[8:]])
        return read_table(self.spark, self.d, name)


#: SQL of the same tables without copies.
CURRENT = "(SELECT DISTINCT ON ({key}) * FROM {table})"
CP = CURRENT.format(key="particle_id", table="particles")
CC = CURRENT.format(key="gas_cell_id", table="cells")
CT = CURRENT.format(key="particle_id", table="tracers")
CG = CURRENT.format(key="ghost_id", table="amr_ghosts")


def query(name: str, sql: str | None = None):
    """Registers ``f(tables) -> DataFrame`` and the SQL that checks it."""

    def register(f):
        QUERIES[name] = lambda spark, d: f(Tables(spark, d))
        QUERIES[name].__doc__ = f.__doc__
        if sql:
            SQL[name] = sql
        return f

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Sums of doubles rounded, since the order of addition differs between runs."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def stated(df: DataFrame, *columns: str) -> DataFrame:
    """Each float column beside ``<column>_state``: value, null or not_finite. Where it is no finite number the column itself is null, so that no reader
    of the result mixes them up (NaN has several bit patterns, and not every engine takes all of them for NaN)."""
    state = lambda c: F.when(F.col(c).isNull(), "null").when(finite(c), "value").otherwise("not_finite")
    return df.withColumns({f"{c}_state": state(c) for c in columns}).withColumns({c: F.when(F.col(f"{c}_state") == "value", F.col(c)) for c in columns})


def stated_sql(*columns: str) -> str:
    return ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}, CASE WHEN {c} IS NULL THEN 'null' WHEN isfinite({c}) THEN 'value' ELSE 'not_finite' END AS {c}_state" for c in columns)
