"""Resampling by pushing each source voxel to the target voxels that read it.

Which targets read a source voxel follows from arithmetic on its own coordinate,
so labels need no join and no shuffle, and interpolated values need only the
final sum, which Spark combines before the shuffle. Absent voxels count as 0.

The sizes are columns: nx, ny, nz of the source and tx, ty, tz of the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.operators import bricks
from voxelweave.operators.components import pack
from voxelweave.operators.overlap import COORDS
from voxelweave.session import by_rows


def _source_position(t: Column, n: Column, m: Column, align_corners: bool) -> Column:
    """Where target index ``t`` (of m) reads along a source axis of n."""
    if align_corners:
        step = F.when(m > 1, (n - 1).cast("double") / (m - 1)).otherwise(0.0)
        return t.cast("double") * step
    return F.least(F.greatest((t.cast("double") + 0.5) * n.cast("double") / m - 0.5, F.lit(0.0)), (n - 1).cast("double"))


def _candidates(s: Column, n: Column, m: Column) -> Column:
    """Target indices that might read source index ``s``, a little too many."""
    scale = m.cast("double") / n
    low = F.greatest(F.floor((s - 1) * scale) - 2, F.lit(0).cast("long"))
    high = F.least(F.ceil((s + 2) * scale) + 2, m - 1)
    # Edge voxels are also read by every target beyond them.
    low = F.when(s == 0, 0).otherwise(low)
    high = F.when(s == n - 1, m - 1).otherwise(high)
    return F.sequence(low.cast("long"), F.greatest(low, high).cast("long"))


def linear(df: DataFrame, values: list[str], align_corners: bool = False) -> DataFrame:
    """Trilinear values on the target grid: case_id, x, y, z and ``values``."""
    sizes = [f"{p}{a}" for p in ("n", "t") for a in COORDS]
    out = df.select("case_id", *COORDS, *values, *sizes).withColumn("w", F.lit(1.0))
    for a in COORDS:
        s, n, m = F.col(a), F.col(f"n{a}"), F.col(f"t{a}")
        out = out.withColumn("t", F.explode(_candidates(s, n, m)))
        weight = 1.0 - F.abs(_source_position(F.col("t"), n, m, align_corners) - s)
        out = out.withColumn("w", F.col("w") * weight).filter(weight > 0).withColumn(a, F.col("t")).drop("t")
    sums = [F.sum(F.col("w") * F.col(v)).alias(v) for v in values]
    return out.groupBy("case_id", *COORDS).agg(*sums)


def nearest(df: DataFrame, rule: str = "centre") -> DataFrame:
    """Every target voxel takes its nearest source voxel; a map without any shuffle.

    ``centre`` reads floor((t + 0.5) n / m), ``corner`` reads floor(t n / m).
    """
    shift = {"centre": 0.5, "corner": 0.0}[rule]
    out = df
    for a in COORDS:
        s, n, m = F.col(a), F.col(f"n{a}"), F.col(f"t{a}")
        out = out.withColumn("__t", F.explode(_candidates(s, n, m)))
        read = F.least(F.floor((F.col("__t").cast("double") + shift) * n.cast("double") / m), n - 1)
        out = out.filter(read == s).withColumn(a, F.col("__t")).drop("__t")
    return out


def resized_cases(cases: DataFrame) -> DataFrame:
    """The case table of the target grid; spacing follows from the lengths."""
    changed = {}
    for a in COORDS:
        changed[f"n{a}"] = F.col(f"t{a}")
        changed[f"s{a}"] = F.col(f"s{a}") * F.col(f"n{a}") / F.col(f"t{a}")
    return cases.withColumns(changed).drop("tx", "ty", "tz")


def affine_nearest(df: DataFrame, labels: list[str], matrix: DataFrame) -> DataFrame:
    """Labels under an affine map, nearest neighbour, zeros outside.

    ``matrix`` holds, per case, the inverse map a11..a33, b1..b3 (target offset
    from the grid centre to source offset) and the sizes nx, ny, nz. Each target
    voxel reads one source voxel.
    """
    return affine(df, [], labels, matrix)


def affine_linear(df: DataFrame, values: list[str], matrix: DataFrame) -> DataFrame:
    """Interpolated values under an affine map; each target voxel reads eight source voxels."""
    return affine(df, values, [], matrix)


def affine(df: DataFrame, values: list[str], labels: list[str], matrix: DataFrame, side: int = bricks.SIDE) -> DataFrame:
    """Interpolated ``values`` and nearest ``labels`` under the same map, on the whole target grid.

    Only source voxels are shuffled, to the bricks of the target grid that may read
    them; the voxels of the grid arise in the tasks.
    """
    kinds = {n: "double" for n in values}
    kinds |= {n: "double" if df.schema[n].dataType.simpleString() in ("float", "double") else "bigint" for n in labels}
    case = df.schema["case_id"].dataType.simpleString()
    names = [f"b{i}" for i in (1, 2, 3)] + [f"a{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
    told = F.array(*[F.col(c).cast("double") for c in (*(f"n{a}" for a in COORDS), *names)])
    zero = F.lit(0).cast("long")
    brick = [f"b{a}" for a in COORDS]
    grid = matrix.select("case_id", told.alias("told"), *[F.col(f"n{a}") for a in COORDS])
    for a in COORDS:
        grid = grid.withColumn(f"b{a}", F.explode(F.sequence(zero, F.floor((F.col(f"n{a}") - 1) / side))))
    grid = grid.select("case_id", *brick, "told", *[zero.alias(a) for a in COORDS], *[F.lit(0).cast(k).alias(n) for n, k in kinds.items()])
    sent = df.select("case_id", *COORDS, *[F.coalesce(F.col(n).cast(k), F.lit(0).cast(k)).alias(n) for n, k in kinds.items()])
    sent = sent.join(by_rows(_readers(matrix)), "case_id")
    for i, a in enumerate(COORDS):
        at = sum((F.col("inv")[3 * i + j] * (F.col(b) - F.col("mid")[j]) for j, b in enumerate(COORDS)), F.col("centre")[i])
        low = F.greatest(F.floor(at - F.col("wide")[i]), zero)
        high = F.least(F.ceil(at + F.col("wide")[i]), F.col(f"n{a}") - 1)
        span = F.when(low <= high, F.sequence(F.floor(low / side), F.floor(F.greatest(low, high) / side)))
        sent = sent.withColumn(f"b{a}", F.explode(span))
    nothing = F.lit(None).cast("array<double>")
    sent = sent.select("case_id", *brick, nothing.alias("told"), *COORDS, *kinds)
    both = grid.unionByName(sent).withColumn("__read", F.col("told").isNull().cast("int"))
    schema = ", ".join([f"case_id {case}", *[f"{a} bigint" for a in COORDS], *[f"`{n}` {k}" for n, k in kinds.items()]])
    return bricks.map_placed(both, ["case_id"], _filler(values, labels, side), schema, ["__read", *COORDS])


def _readers(matrix: DataFrame) -> DataFrame:
    """What tells which targets read a voxel: the map from source to target, and how far around its image they lie."""
    a = [[F.col(f"a{i}{j}") for j in (1, 2, 3)] for i in (1, 2, 3)]
    minor = lambda i, j: (a[(i + 1) % 3][(j + 1) % 3] * a[(i + 2) % 3][(j + 2) % 3]
                          - a[(i + 1) % 3][(j + 2) % 3] * a[(i + 2) % 3][(j + 1) % 3])
    det = sum((a[0][j] * minor(0, j) for j in range(1, 3)), a[0][0] * minor(0, 0))
    # A map that cannot be turned round leaves every target open.
    sound = F.abs(det) > 1e-9
    inverse = [F.when(sound, minor(j, i) / det).otherwise(0.0) for i in range(3) for j in range(3)]
    middle = [(F.col(f"n{c}") - 1) / 2.0 for c in COORDS]
    wide = [F.when(sound, sum((F.abs(v) for v in inverse[3 * i:3 * i + 3]), F.lit(0.01))).otherwise(1e9) for i in range(3)]
    return matrix.select(
        "case_id", *[f"n{c}" for c in COORDS], F.array(*inverse).alias("inv"), F.array(*wide).alias("wide"),
        F.array(*middle).alias("centre"), F.array(*[m + F.col(f"b{i}") for i, m in enumerate(middle, 1)]).alias("mid"),
    )


def _filler(values: list[str], labels: list[str], side: int, most_rows: int = 200_000):
    """Frames of whole target bricks; the first row of a brick tells its map, the others are source voxels in scan order."""

    def brick(told: np.ndarray, low: np.ndarray, here: pd.DataFrame) -> dict[str, np.ndarray]:
        size, shift, turn = told[:3].astype(np.int64), told[3:6], told[6:].reshape(3, 3)
        high = np.minimum(low + side, size)
        at = [g.ravel() for g in np.meshgrid(*[np.arange(p, q) for p, q in zip(low, high)], indexing="ij")]
        middle = (size - 1) / 2.0
        centred = [at[j] - middle[j] for j in range(3)]
        place = [shift[i] + turn[i, 0] * centred[0] + turn[i, 1] * centred[1] + turn[i, 2] * centred[2] + middle[i] for i in range(3)]
        code = pack(*[here[a].to_numpy() for a in COORDS])

        def find(read: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            """Targets whose wanted source voxel is there, and its row."""
            inside = np.flatnonzero(np.logical_and.reduce([(r >= 0) & (r < n) for r, n in zip(read, size)]))
            want = pack(*[r[inside].astype(np.int64) for r in read])
            row = np.minimum(np.searchsorted(code, want), max(len(code) - 1, 0))
            hit = code[row] == want if len(code) else np.zeros(len(want), dtype=bool)
            return inside[hit], row[hit]

        out = dict(zip(COORDS, at))
        sums = {n: np.zeros(len(at[0])) for n in values}
        base = [np.floor(p) for p in place]
        for corner in np.ndindex(2, 2, 2) if values else ():
            read = [b + c for b, c in zip(base, corner)]
            target, row = find(read)
            weight = np.ones(len(target))
            for p, r in zip(place, read):
                weight = weight * (1.0 - np.abs(p[target] - r[target]))
            for n in values:
                sums[n][target] += weight * here[n].to_numpy()[row]
        out |= sums
        if labels:
            target, row = find([np.floor(p + 0.5) for p in place])
            for n in labels:
                source = here[n].to_numpy()
                out[n] = np.zeros(len(at[0]), dtype=source.dtype)
                out[n][target] = source[row]
        return out

    def run(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        made, rows = [], 0
        corner = pdf[[f"b{a}" for a in COORDS]].to_numpy() * side
        case = pdf["case_id"].to_numpy()
        for start, stop in bricks.brick_slices(pdf, ["case_id"]):
            filled = brick(np.asarray(pdf["told"].iloc[start], dtype=float), corner[start], pdf.iloc[start + 1:stop])
            made.append(pd.DataFrame({"case_id": np.full(len(filled["x"]), case[start]), **filled}))
            rows += len(made[-1])
            if rows >= most_rows:
                yield pd.concat(made, ignore_index=True)
                made, rows = [], 0
        if made:
            yield pd.concat(made, ignore_index=True)

    return run
