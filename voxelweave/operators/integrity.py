"""Checks of a dataset before it is used. Each returns the rows that fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrong_case_counts(descriptors: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """Datasets whose number of cases is not the declared ``num_training``."""
    found = cases.groupBy(key).agg(F.count("*").alias("found"))
    both = descriptors.select(key, "num_training").join(found, key, "left")
    return both.withColumn("found", F.coalesce("found", F.lit(0))).filter("found <> num_training")


def without_label(images: DataFrame, labels: DataFrame, key: str = "case") -> DataFrame:
    return images.select(key).distinct().join(labels.select(key), key, "left_anti")


def absent_files(referenced: DataFrame, catalog: DataFrame) -> DataFrame:
    """Referenced files that the catalog does not hold."""
    return referenced.join(catalog.select("path"), "path", "left_anti")


def outside_grid(voxels: DataFrame, cases: DataFrame) -> DataFrame:
    """Voxels counted by fault: case_id, fault (``no case`` or ``outside``), n.

    A voxel has no case when the case table lacks its ``case_id``, and lies
    outside when a coordinate is NULL, negative or not below the grid size.
    """
    grid = cases.select("case_id", "nx", "ny", "nz", F.lit(True).alias("__known"))
    inside = F.lit(True)
    for a in ("x", "y", "z"):
        inside = inside & (F.col(a) >= 0) & (F.col(a) < F.col(f"n{a}"))
    fault = F.when(F.col("__known").isNull(), "no case").when(~F.coalesce(inside, F.lit(False)), "outside")
    both = voxels.join(grid, "case_id", "left").withColumn("fault", fault).filter("fault IS NOT NULL")
    return both.groupBy("case_id", "fault").agg(F.count("*").alias("n"))


def require_grid(boxes: DataFrame, cases: DataFrame) -> None:
    """Stops where a box (lo and hi per axis, hi inside) has no case or leaves its case's grid."""
    ends = F.array(*[F.struct(*[F.col(f"{end}_{a}").alias(a) for a in ("x", "y", "z")]) for end in ("lo", "hi")])
    corners = boxes.select("case_id", F.explode(ends).alias("r")).select("case_id", "r.*")
    bad = outside_grid(corners, cases).first()
    if bad is not None:
        raise ValueError(f"case {bad['case_id']}: {bad['fault']}; outside_grid lists all such voxels")


def require_voxels(voxels: DataFrame, cases: DataFrame) -> None:
    """:func:`require_grid` for a voxel table, by the box of each case; a NULL coordinate stops as well."""
    boxes = voxels.groupBy("case_id").agg(
        *[F.when(F.count(a) == F.count(F.lit(1)), end(a)).alias(f"{name}_{a}") for a in ("x", "y", "z") for name, end in (("lo", F.min), ("hi", F.max))])
    require_grid(boxes, cases)


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| within atol + rtol |b|: relative to the second value."""
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def arrays_differ(a: str, b: str) -> Column:
    return F.exists(F.zip_with(F.col(a), F.col(b), lambda p, q: ~close(p, q)), lambda bad: bad)


def grid_disagreements(images: DataFrame, labels: DataFrame, n_channels: int) -> DataFrame:
    """Cases whose image and label differ in shape or spacing, or with a wrong channel count.

    Both sides hold case_id, shape ARRAY<BIGINT> and spacing ARRAY<DOUBLE>;
    images also n_channels.
    """
    label = labels.select("case_id", F.col("shape").alias("l_shape"), F.col("spacing").alias("l_spacing"))
    both = images.join(label, "case_id")
    checks = both.select(
        "case_id", (F.col("shape") != F.col("l_shape")).alias("shape_differs"),
        arrays_differ("spacing", "l_spacing").alias("spacing_differs"),
        (F.col("n_channels") != n_channels).alias("channels_differ"),
    )
    return checks.filter("shape_differs OR spacing_differs OR channels_differ")


def spacing_warnings(preds: DataFrame, refs: DataFrame) -> DataFrame:
    """Cases whose reference spacing is not close to the predicted one."""
    both = preds.select("case_id", F.col("spacing").alias("p")).join(refs.select("case_id", F.col("spacing").alias("r")), "case_id")
    return both.filter(arrays_differ("r", "p")).select("case_id")


def instance_map_faults(voxels: DataFrame, cases: DataFrame, side: str = "ref_id") -> DataFrame:
    """Cases with a negative id, or with no background voxel at all."""
    per_case = voxels.groupBy("case_id").agg(
        F.min(side).alias("smallest"), F.sum(F.when(F.col(side) != 0, 1).otherwise(0)).alias("labelled")
    )
    sized = per_case.join(cases.select("case_id", (F.col("nx") * F.col("ny") * F.col("nz")).alias("n_all")), "case_id")
    faults = sized.select(
        "case_id", (F.col("smallest") < 0).alias("negative_id"), (F.col("labelled") >= F.col("n_all")).alias("no_background")
    )
    return faults.filter("negative_id OR no_background")


def not_binary(voxels: DataFrame, column: str) -> DataFrame:
    """Number of values other than 0 and 1 per case."""
    return voxels.filter(~F.col(column).isin(0, 1)).groupBy("case_id").agg(F.count("*").alias("n"))
