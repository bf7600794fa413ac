"""Neighbourhood operators on bricks with a halo: local maxima, smoothing, Hessian.

Absent voxels count as 0. A task works on the occupied box of one brick at a
time, so the dense arrays it makes never exceed a brick and its halo.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.operators import bricks
from voxelweave.operators.overlap import COORDS

HESSIAN = ["hxx", "hyy", "hzz", "hxy", "hxz", "hyz"]


def gaussian_taps(sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Sampled Gaussian, normalised, cut at ``truncate`` deviations."""
    radius = int(truncate * sigma + 0.5)
    at = np.arange(-radius, radius + 1)
    taps = np.exp(-0.5 * (at / sigma) ** 2)
    return taps / taps.sum()


def _smooth_axis(block: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    radius = len(taps) // 2
    out = np.zeros_like(block)
    n = block.shape[axis]
    moved, target = np.moveaxis(block, axis, 0), np.moveaxis(out, axis, 0)
    for shift, weight in zip(range(-radius, radius + 1), taps):
        lo, hi = max(0, -shift), min(n, n - shift)
        if hi > lo:
            target[lo:hi] += weight * moved[lo + shift:hi + shift]
    return out


def smooth_block(block: np.ndarray, taps: list[np.ndarray]) -> np.ndarray:
    for axis, t in enumerate(taps):
        block = _smooth_axis(block, t, axis)
    return block


def _blocks(pdf: pd.DataFrame, keys: list[str], side: int, reach: int) -> Iterator[tuple]:
    """(rows in the brick itself, their indices in the block, block of values) per brick."""
    at = pdf[COORDS].to_numpy()
    core = np.ones(len(pdf), dtype=bool)
    for i, a in enumerate(COORDS):
        core &= at[:, i] // side == pdf[f"b{a}"].to_numpy()
    size = pdf[["nx", "ny", "nz"]].to_numpy() if "nx" in pdf else None
    value = pdf["value"].to_numpy(dtype=float)
    for start, stop in bricks.brick_slices(pdf, keys):
        mine = np.flatnonzero(core[start:stop]) + start
        if len(mine) == 0:
            continue
        lo, hi = at[mine].min(axis=0) - reach, at[mine].max(axis=0) + reach
        if size is not None:
            lo, hi = np.maximum(lo, 0), np.minimum(hi, size[start] - 1)
        here = at[start:stop]
        inside = np.flatnonzero(((here >= lo) & (here <= hi)).all(axis=1)) + start
        block = np.zeros(hi - lo + 1)
        block[tuple((at[inside] - lo).T)] = value[inside]
        yield mine, tuple((at[mine] - lo).T), block


def _at_core(pdf: pd.DataFrame, keys: list[str], columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """The rows that got a value (those of the brick itself) with their new columns."""
    filled = ~np.isnan(next(iter(columns.values())))
    out = pdf.loc[filled, [*keys, *COORDS]]
    return out.assign(**{name: values[filled] for name, values in columns.items()})


def _schema(df: DataFrame, columns: list[str], extra: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join([*[f"{c} {kinds[c]}" for c in columns], *[f"{e} double" for e in extra]])


def gaussian(df: DataFrame, value: str, sigma: float | tuple[float, float, float] = 1.0,
             keys: tuple[str, ...] = ("case_id",), side: int = bricks.SIDE) -> DataFrame:
    """Separable Gaussian smoothing, read at the given rows; zeros outside."""
    sigmas = (float(sigma),) * 3 if isinstance(sigma, (int, float)) else sigma
    own = df.withColumns({f"s{a}": F.lit(float(s)) for a, s in zip(COORDS, sigmas)})
    return gaussian_by_case(own, value, max(sigmas), keys, side)


def gaussian_by_case(df: DataFrame, value: str, max_sigma: float, keys: tuple[str, ...] = ("case_id",),
                     side: int = bricks.SIDE) -> DataFrame:
    """Smoothing with each case's own deviations in the columns sx, sy, sz (none above ``max_sigma``)."""
    reach = len(gaussian_taps(max_sigma)) // 2
    keys = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        deviations = pdf[["sx", "sy", "sz"]].to_numpy()
        smooth = np.full(len(pdf), np.nan)
        for mine, where, block in _blocks(pdf, keys, side, reach):
            smooth[mine] = smooth_block(block, [gaussian_taps(s) for s in deviations[mine[0]]])[where]
        return _at_core(pdf, keys, {"smooth": smooth})

    rows = df.select(*keys, *COORDS, "sx", "sy", "sz", F.col(value).cast("double").alias("value"))
    return bricks.map_bricks(rows, keys, side, run, _schema(rows, [*keys, *COORDS], ["smooth"]), halo=reach, from_zero=True)


def hessian(df: DataFrame, value: str, cases: DataFrame, sigma: float = 1.0, side: int = bricks.SIDE) -> DataFrame:
    """Hessian of the smoothed volume at the given rows.

    The derivative scheme is ours to state: central differences applied twice,
    one-sided at the edge of the grid, after zero-padded smoothing.
    """
    taps = [gaussian_taps(sigma)] * 3
    reach = len(taps[0]) // 2 + 2
    keys = ["case_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        second = {name: np.full(len(pdf), np.nan) for name in HESSIAN}
        for mine, where, block in _blocks(pdf, keys, side, reach):
            first = np.gradient(smooth_block(block, taps))
            for name in HESSIAN:
                a, b = "xyz".index(name[1]), "xyz".index(name[2])
                second[name][mine] = np.gradient(first[a], axis=b)[where]
        return _at_core(pdf, keys, second)

    rows = df.join(cases.select("case_id", "nx", "ny", "nz"), "case_id").select(
        *keys, *COORDS, "nx", "ny", "nz", F.col(value).cast("double").alias("value")
    )
    return bricks.map_bricks(rows, keys, side, run, _schema(rows, [*keys, *COORDS], HESSIAN), halo=reach, from_zero=True)


def negative_definite() -> Column:
    """All eigenvalues below 0, by the signs of the leading minors."""
    h = {n: F.col(n) for n in HESSIAN}
    two = h["hxx"] * h["hyy"] - h["hxy"] * h["hxy"]
    det = (
        h["hxx"] * (h["hyy"] * h["hzz"] - h["hyz"] * h["hyz"])
        - h["hxy"] * (h["hxy"] * h["hzz"] - h["hyz"] * h["hxz"])
        + h["hxz"] * (h["hxy"] * h["hyz"] - h["hyy"] * h["hxz"])
    )
    return (h["hxx"] < 0) & (two > 0) & (det < 0)


def local_maxima(df: DataFrame, value: str = "heat", threshold: float = 0.1, kernel: int = 3,
                 keys: tuple[str, ...] = ("case_id",), side: int = bricks.SIDE) -> DataFrame:
    """Rows strictly above ``threshold`` that equal the largest value of their kernel box.

    A row at or below the threshold cannot beat a candidate, so it is dropped
    before the shuffle.
    """
    if kernel % 2 != 1:
        raise ValueError("the kernel side must be odd")
    keys, halo = list(keys), kernel // 2
    rows = df.filter(F.col(value) > threshold).select(*keys, *COORDS, F.col(value).cast("double").alias("value"))
    if halo == 0:
        return rows.withColumnRenamed("value", value)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        code, wide = bricks.brick_codes(pdf, keys, side, halo, halo)
        heat = pdf["value"].to_numpy()
        beaten = np.zeros(len(pdf), dtype=bool)
        span = range(-halo, halo + 1)
        for step in ((dx * wide + dy) * wide + dz for dx in span for dy in span for dz in span):
            if step > 0:
                i, j = bricks.lookup(code, step)
                beaten[i[heat[j] > heat[i]]] = True
                beaten[j[heat[i] > heat[j]]] = True
        core = ~beaten
        for a in COORDS:
            core &= (pdf[a] // side == pdf[f"b{a}"]).to_numpy()
        return pdf.loc[core, [*keys, *COORDS, "value"]]

    found = bricks.map_bricks(rows, keys, side, run, _schema(rows, [*keys, *COORDS, "value"], []), halo=halo, from_zero=True)
    return found.withColumnRenamed("value", value)
