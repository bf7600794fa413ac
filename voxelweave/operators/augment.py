"""Offline augmentation of images, one random decision per case.

``params`` holds a row per case with ``on`` and the drawn numbers; a case that is
off keeps its values. Decisions come from :func:`decisions`, so that all
attributes of a case share them and a rerun gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.functions import draws
from voxelweave.operators import resample, stencil
from voxelweave.operators.intensity import image_stats
from voxelweave.operators.overlap import COORDS
from voxelweave.schema import voxel_key
from voxelweave.session import shuffled

# Probabilities and ranges of the training chain, in its order (fixed values).
TRAIN_CHAIN = {
    "scale_affine": (0.2, (-0.3, 0.4)),
    "rotate_affine": (0.2, (-0.52, 0.52)),
    "shift_affine": (0.2, (-10.0, 10.0)),
    "noise": (0.15, 0.1),
    "smooth": (0.2, (0.5, 1.0)),
    "scale": (0.15, (-0.3, 0.3)),
    "scale_fixed_mean": (0.15, (-0.25, 0.25)),
    "low_resolution": (0.25, (0.5, 1.0)),
    "gamma_inverted": (0.1, (0.7, 1.5)),
    "gamma": (0.3, (0.7, 1.5)),
    "mirror": (0.5, (0, 1, 2)),
}


def decisions(cases: DataFrame, seed: int, probability: float, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """case_id, on, and one uniform draw per named range."""
    drawn = [draws.between(lo, hi, seed + 2 + i, "case_id").alias(n) for i, (n, (lo, hi)) in enumerate(ranges.items())]
    return cases.select("case_id", (draws.uniform(seed, "case_id") < probability).alias("on"), *drawn)


def gamma(df: DataFrame, params: DataFrame, value: str = "intensity", invert: bool = False, retain_stats: bool = True) -> DataFrame:
    """Power curve over the case's range; optionally on the negative, optionally with mean and deviation restored.

    Two passes for statistics at most: of the input, and of the curve's output.
    """
    sign = -1.0 if invert else 1.0
    signed = df.join(params.select("case_id", "on", "gamma"), "case_id").withColumn("__v", F.col(value) * sign)
    stats = image_stats(signed.filter("on"), "__v")
    joined = signed.join(stats, "case_id", "left")
    span = F.col("high") - F.col("low")
    curve = F.pow((F.col("__v") - F.col("low")) / (span + 1e-7), F.col("gamma")) * span + F.col("low")
    bent = joined.withColumn("__c", F.when(F.col("on"), curve))
    if retain_stats:
        after = bent.filter("on").groupBy("case_id").agg(F.avg("__c").alias("__m2"), F.stddev_samp("__c").alias("__s2"))
        bent = bent.join(after, "case_id", "left")
        bent = bent.withColumn("__c", F.col("sd") * ((F.col("__c") - F.col("__m2")) / (F.col("__s2") + 1e-8)) + F.col("mean"))
    return bent.withColumn(value, F.when(F.col("on"), F.col("__c") * sign).otherwise(F.col(value))).select(*df.columns)


def scale_fixed_mean(df: DataFrame, params: DataFrame, value: str = "intensity", fixed_mean: bool = True,
                     preserve_range: bool = True, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """(x - m)(1 + f) + m, clipped to the image's own range; add the channel to ``keys`` for channel-wise work."""
    joined = df.join(params.select("case_id", "on", "factor"), "case_id").join(image_stats(df, value, keys), list(keys))
    centre = F.col("mean") if fixed_mean else F.lit(0.0)
    out = (F.col(value) - centre) * (1.0 + F.col("factor")) + centre
    if preserve_range:
        out = F.least(F.greatest(out, F.col("low")), F.col("high"))
    return joined.withColumn(value, F.when(F.col("on"), out).otherwise(F.col(value))).select(*df.columns)


def scale(df: DataFrame, params: DataFrame, value: str = "intensity") -> DataFrame:
    joined = df.join(params.select("case_id", "on", "factor"), "case_id")
    return joined.withColumn(value, F.when(F.col("on"), F.col(value) * (1.0 + F.col("factor"))).otherwise(F.col(value))).select(*df.columns)


def noise(df: DataFrame, params: DataFrame, seed: int, value: str = "intensity", mean: float = 0.0, std: float = 0.1) -> DataFrame:
    """Gaussian noise from draws on case and position, so partitioning does not change it."""
    joined = df.join(params.select("case_id", "on"), "case_id")
    noisy = F.col(value) + mean + std * draws.normal(seed, "case_id", voxel_key())
    return joined.withColumn(value, F.when(F.col("on"), noisy).otherwise(F.col(value))).select(*df.columns)


def smooth(df: DataFrame, params: DataFrame, value: str = "intensity", max_sigma: float = 1.0) -> DataFrame:
    """Gaussian smoothing of the chosen cases with their drawn deviations sx, sy, sz."""
    joined = df.join(params.select("case_id", "on", "sx", "sy", "sz"), "case_id")
    smoothed = stencil.gaussian_by_case(joined.filter("on"), value, max_sigma)
    merged = joined.filter("on").drop(value).join(shuffled(smoothed.withColumnRenamed("smooth", value)), ["case_id", *COORDS])
    return joined.filter("NOT on").select(*df.columns).unionByName(merged.select(*df.columns))


def mirror(df: DataFrame, params: DataFrame, cases: DataFrame, axes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """All given axes are turned round together."""
    joined = df.join(params.select("case_id", "on"), "case_id").join(cases.select("case_id", "nx", "ny", "nz"), "case_id")
    turned = {COORDS[i]: F.when(F.col("on"), F.col(f"n{COORDS[i]}") - 1 - F.col(COORDS[i])).otherwise(F.col(COORDS[i])) for i in axes}
    return joined.withColumns(turned).select(*df.columns)


def low_resolution(df: DataFrame, params: DataFrame, cases: DataFrame, value: str = "intensity") -> DataFrame:
    """Nearest reduction by the drawn zoom, then trilinear enlargement to the old grid (corners aligned)."""
    sized = df.join(params.select("case_id", "on", "zoom"), "case_id").join(cases.select("case_id", "nx", "ny", "nz"), "case_id")
    chosen = sized.filter("on")
    small = {f"t{a}": F.greatest(F.rint(F.col(f"n{a}") * F.col("zoom")).cast("long"), F.lit(1).cast("long")) for a in COORDS}
    down = resample.nearest(chosen.withColumns(small), "corner")
    back = down.withColumns({
        **{f"t{a}": F.col(f"n{a}") for a in COORDS}, **{f"n{a}": F.col(f"t{a}") for a in COORDS}
    })
    up = resample.linear(back, [value], align_corners=True)
    rest = sized.filter("NOT on").select("case_id", *COORDS, value)
    return up.select("case_id", *COORDS, value).unionByName(rest)


def affine_matrix(params: DataFrame, cases: DataFrame) -> DataFrame:
    """Inverse map of scale, rotation and shift per case.

    ``params`` may hold zx, zy, zz (scale change), rx, ry, rz (radians) and
    tx, ty, tz (shift in voxels); missing ones count as 0. The target offset from
    the centre is rotated, scaled and shifted to give the source offset.
    """
    have = set(params.columns)
    get = lambda n: F.col(n) if n in have else F.lit(0.0)
    cx, sx = F.cos(get("rx")), F.sin(get("rx"))
    cy, sy = F.cos(get("ry")), F.sin(get("ry"))
    cz, sz = F.cos(get("rz")), F.sin(get("rz"))
    zero, one = F.lit(0.0), F.lit(1.0)
    about_x = [[one, zero, zero], [zero, cx, -sx], [zero, sx, cx]]
    about_y = [[cy, zero, sy], [zero, one, zero], [-sy, zero, cy]]
    about_z = [[cz, -sz, zero], [sz, cz, zero], [zero, zero, one]]

    def times(p, q):
        return [[sum((p[i][k] * q[k][j] for k in range(3)), F.lit(0.0)) for j in range(3)] for i in range(3)]

    turn = times(times(about_x, about_y), about_z)
    grow = [1.0 + get(f"z{a}") for a in COORDS]
    sized = params.join(cases.select("case_id", "nx", "ny", "nz"), "case_id")
    columns = {f"a{i + 1}{j + 1}": turn[i][j] * grow[j] for i in range(3) for j in range(3)}
    columns |= {f"b{i + 1}": get(f"t{a}") for i, a in enumerate(COORDS)}
    on = F.col("on") if "on" in have else F.lit(True)
    same = {f"a{i}{j}": 1.0 if i == j else 0.0 for i in (1, 2, 3) for j in (1, 2, 3)} | {f"b{i}": 0.0 for i in (1, 2, 3)}
    return sized.select("case_id", "nx", "ny", "nz", on.alias("on"), *[F.when(on, c).otherwise(F.lit(same[n])).alias(n) for n, c in columns.items()])


def affine(df: DataFrame, matrix: DataFrame, values: list[str], labels: list[str]) -> DataFrame:
    """Interpolated values and nearest labels under the same map.

    Cases whose decision is off keep their rows as they are and join nothing.
    """
    columns = ["case_id", *COORDS, *values, *labels]
    decided = df.join(matrix.select("case_id", "on"), "case_id")
    moved, matrix = decided.filter("on").select(*columns), matrix.filter("on")
    image = resample.affine(moved, values, labels, matrix)
    return image.select(*columns).unionByName(decided.filter("NOT on").select(*columns))
