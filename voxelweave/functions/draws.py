"""Reproducible draws: integer mixing of keys, the same on any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# A prime below 2**31, so that a product of two residues fits a LONG.
PRIME = 2147483647


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mix(seed: int, *keys) -> Column:
    """An integer in [0, PRIME) from whole-number keys (each at least 0)."""
    state = F.lit(seed * 7919 + 104729).cast("long")
    for key in keys:
        state = (state * 48271 + _as_col(key).cast("long")) % PRIME
    state = (state * state + 12345) % PRIME
    return (state * state + 104395303) % PRIME


def uniform(seed: int, *keys) -> Column:
    """A number in [0, 1)."""
    return mix(seed, *keys).cast("double") / float(PRIME)


def between(low: float, high: float, seed: int, *keys) -> Column:
    return F.lit(float(low)) + uniform(seed, *keys) * float(high - low)


def normal(seed: int, *keys) -> Column:
    """Standard normal by the polar form of two uniforms."""
    u = F.greatest(uniform(seed, *keys), F.lit(1.0 / PRIME))
    v = uniform(seed + 1, *keys)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)


def mix_sql(seed: int, *keys: str) -> str:
    """The DuckDB text of :func:`mix`."""
    state = f"{seed * 7919 + 104729}::BIGINT"
    for key in keys:
        state = f"(({state} * 48271 + ({key})) % {PRIME})"
    for add in (12345, 104395303):
        state = f"(({state} * {state} + {add}) % {PRIME})"
    return state


def uniform_sql(seed: int, *keys: str) -> str:
    return f"(CAST({mix_sql(seed, *keys)} AS DOUBLE) / {PRIME}.0e0)"
