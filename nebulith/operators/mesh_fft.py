"""Fourier transforms of meshes held as tables: planes, then lines through the planes, each a group of its own.

A transform moves the mesh twice; no task holds more than one plane of n² points (a limit on memory alone: 2,048 points per axis, 8.6 billion in all).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulith.runtime import parallelism, ship

MAX_AXIS = 2048  # a plane then has 4.2 million points

Planes = list[np.ndarray]


def _check(n: int) -> None:
    if n > MAX_AXIS:
        raise ValueError(f"a plane of the mesh must fit one task: {MAX_AXIS} points per axis at most")


def _pass(df: DataFrame, n: int, by: str, rows: tuple[str, str], inputs: list[str], outputs: list[str], work: Callable[[Planes, int], Planes], out_rows: tuple[str, str], out_by: str) -> DataFrame:
    """Groups ``df`` by one index and hands each group's columns, as dense planes over the other two indices (zero where there is no row), to ``work``."""
    ship(df.sparkSession)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        at = int(group[by].iloc[0])
        a, b = group[rows[0]].to_numpy(), group[rows[1]].to_numpy()
        planes = []
        for c in inputs:
            p = np.zeros((n, n))
            p[a, b] = group[c].to_numpy()
            planes.append(p)
        out = work(planes, at)
        size = out[0].shape
        i = np.indices(size).reshape(2, -1).astype(np.int32)
        return pd.DataFrame({out_by: np.full(i.shape[1], at, np.int32), out_rows[0]: i[0], out_rows[1]: i[1]} | {c: p.ravel() for c, p in zip(outputs, out)})

    schema = ", ".join([f"{c} int" for c in (out_by, *out_rows)] + [f"{c} double" for c in outputs])
    dealt = df.select(by, *rows, *inputs).repartition(min(n, parallelism(df.sparkSession)), by)
    return dealt.groupBy(by).applyInPandas(run, schema)


def _split(fields: Planes) -> Planes:
    return [p for f in fields for p in (f.real, f.imag)]


def forward(mesh: DataFrame, n: int, value: str) -> DataFrame:
    """(nx, ny, nz, re, im): Σ value · exp(−2πi (ix nx + iy ny + iz nz) / n) over rows (ix, iy, iz); points without a row are zero."""
    _check(n)
    flat = _pass(mesh, n, "iz", ("ix", "iy"), [value], ["re", "im"], lambda p, _: _split([np.fft.fft2(p[0])]), ("nx", "ny"), "iz")
    return _pass(flat, n, "nx", ("ny", "iz"), ["re", "im"], ["re", "im"], lambda p, _: _split([np.fft.fft(p[0] + 1j * p[1], axis=1)]), ("ny", "nz"), "nx")


def filtered(mesh: DataFrame, n: int, values: list[str], outputs: list[str], work: Callable[[Planes, int], Planes], keep: int | None = None) -> DataFrame:
    """(ix, iy, iz, outputs): transforms ``values``, lets ``work`` make the outputs' modes of one plane of nx (axes ny and nz), and transforms back.

    ``keep`` leaves only the first so many points of each axis.
    """
    _check(n)
    m = keep or n
    names = [f"{part}{i}" for i in range(len(values)) for part in ("re", "im")]
    back = [f"{part}_{c}" for c in outputs for part in ("re", "im")]
    flat = _pass(mesh, n, "iz", ("ix", "iy"), values, names, lambda p, _: _split([np.fft.fft2(x) for x in p]), ("nx", "ny"), "iz")

    def lines(p: Planes, nx: int) -> Planes:
        modes = [np.fft.fft(p[i] + 1j * p[i + 1], axis=1) for i in range(0, len(p), 2)]
        return _split([np.fft.ifft(f, axis=1)[:, :m] for f in work(modes, nx)])

    solved = _pass(flat, n, "nx", ("ny", "iz"), names, back, lines, ("ny", "iz"), "nx")
    return _pass(solved, n, "iz", ("nx", "ny"), back, outputs, lambda p, _: [np.fft.ifft2(p[i] + 1j * p[i + 1]).real[:m, :m] for i in range(0, len(p), 2)], ("ix", "iy"), "iz")


def dense(mesh: DataFrame, n: int, value: Column, name: str) -> DataFrame:
    """``mesh`` with a column over all n³ points; its own values are zero where it had no row."""
    i = F.col("id")
    grid = mesh.sparkSession.range(n**3).select(F.floor(i / n**2).cast("int").alias("ix"), (F.floor(i / n) % n).cast("int").alias("iy"), (i % n).cast("int").alias("iz"))
    return grid.join(mesh, ["ix", "iy", "iz"], "left").fillna(0.0).withColumn(name, value)
