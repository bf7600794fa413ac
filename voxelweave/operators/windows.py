"""Sliding windows over a grid: cutting a volume into windows and blending window outputs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.operators.overlap import COORDS


def starts(n: Column, patch: int, overlap: float) -> Column:
    """Window origins along an axis: a fixed interval, the last window ends at the edge."""
    step = max(int(patch * (1 - overlap)), 1)
    last = F.greatest(n - patch, F.lit(0).cast("long"))
    count = F.ceil(last / step)
    return F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), count), lambda i: F.least(i * step, last)))


def tile(df: DataFrame, cases: DataFrame, patch: tuple[int, int, int], overlap: float = 0.5) -> DataFrame:
    """Each voxel once per window that covers it, with the window's origin wx, wy, wz."""
    out = df.join(cases.select("case_id", "nx", "ny", "nz"), "case_id")
    for a, p in zip(COORDS, patch):
        origins = F.explode(starts(F.col(f"n{a}"), p, overlap))
        out = out.withColumn(f"w{a}", origins).filter((F.col(a) >= F.col(f"w{a}")) & (F.col(a) < F.col(f"w{a}") + p))
    return out.drop("nx", "ny", "nz")


def gaussian_weight(patch: tuple[int, int, int], sigma_scale: float = 0.125, floor: float = 1e-3) -> Column:
    """Importance of a voxel in its window: highest in the middle, at least ``floor``."""
    power = F.lit(0.0)
    for a, p in zip(COORDS, patch):
        at = (F.col(a) - F.col(f"w{a}") - (p - 1) / 2.0) / (p * sigma_scale)
        power = power - 0.5 * at * at
    return F.greatest(F.exp(power), F.lit(floor))


def blend(outputs: DataFrame, values: list[str], patch: tuple[int, int, int], sigma_scale: float = 0.125) -> DataFrame:
    """Weighted mean over the windows of each voxel."""
    w = gaussian_weight(patch, sigma_scale)
    weighted = outputs.withColumn("__w", w)
    sums = [(F.sum(F.col("__w") * F.col(v)) / F.sum("__w")).alias(v) for v in values]
    return weighted.groupBy("case_id", *COORDS).agg(*sums)


def number_of_windows(n: int, patch: int, overlap: float = 0.5) -> int:
    step = max(int(patch * (1 - overlap)), 1)
    return math.ceil(max(n - patch, 0) / step) + 1
