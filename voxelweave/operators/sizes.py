"""Physical size of instances, and the filters that rest on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.functions import ratios
from voxelweave.operators import overlap

SPACING = ("sx", "sy", "sz")


def extents(inst: DataFrame) -> DataFrame:
    """Voxel extents ``ex, ey, ez`` from a bounding box."""
    return inst.withColumns({f"e{a}": F.col(f"hi_{a}") - F.col(f"lo_{a}") + 1 for a in overlap.COORDS})


def size_verdicts(inst: DataFrame, cases: DataFrame, min_volume: float = 14, min_axis: float = 3) -> DataFrame:
    """Adds volume, extents in mm and ``too_small`` to an instance table with bounding boxes."""
    spaced = extents(inst).join(cases.select("case_id", *SPACING), "case_id")
    return spaced.withColumns(
        {
            "volume": ratios.volume_mm3("n"),
            **{f"mm_{a}": ratios.dbl(f"e{a}") * F.col(f"s{a}") for a in overlap.COORDS},
            "too_small": ratios.too_small("n", ["ex", "ey", "ez"], SPACING, min_volume, min_axis),
        }
    )


def size_verdicts_2d(inst: DataFrame, cases: DataFrame, min_volume: float = 14, min_axis: float = 3) -> DataFrame:
    """The two-axis variant: only x and y count, for instances of one slice."""
    spaced = extents(inst).join(cases.select("case_id", *SPACING), "case_id")
    return spaced.withColumn("too_small", ratios.too_small("n", ["ex", "ey"], ["sx", "sy"], min_volume, min_axis))


def verdict_of_ids(ids: DataFrame, verdicts: DataFrame, side: str) -> DataFrame:
    """Looks ids up among the verdicts; an id with no voxel counts as too small."""
    found = verdicts.select("case_id", side, "too_small")
    return ids.join(found, ["case_id", side], "left").withColumn("too_small", F.coalesce("too_small", F.lit(True)))


def drop_small(table: DataFrame, cases: DataFrame, side: str, min_volume: float = 14, min_axis: float = 3) -> DataFrame:
    """A contingency table in which too-small instances of ``side`` became background."""
    small = size_verdicts(overlap.instances(table, side), cases, min_volume, min_axis).filter("too_small")
    marked = table.join(small.select("case_id", side, F.lit(True).alias("__small")), ["case_id", side], "left")
    rows = marked.withColumn(side, F.when(F.col("__small"), 0).otherwise(F.col(side)).cast("long")).drop("__small")
    return rows.groupBy("case_id", "pred_id", "ref_id").agg(F.sum("n").alias("n"), *overlap.merged_bounds())


def remove_small_instances(voxels: DataFrame, cases: DataFrame, side: str = "ref_id", min_volume: float = 14,
                           min_axis: float = 3, also_clear: tuple[str, ...] = ()) -> DataFrame:
    """Voxels without the too-small instances of ``side``; background of ``side`` stays.

    ``also_clear`` names attributes that become 0 wherever no kept instance is.
    Thresholds of 0 and 0 leave the volume as it is.
    """
    if min_volume == 0 and min_axis == 0:
        return voxels
    inst = voxels.filter(F.col(side) > 0).groupBy("case_id", side).agg(F.count("*").alias("n"), *overlap.bounds())
    small = size_verdicts(inst, cases, min_volume, min_axis).filter("too_small")
    marked = overlap.with_instance(voxels, small.select("case_id", side, F.lit(True).alias("__small")), side)
    cleaned = marked.withColumn(side, F.when(F.col("__small"), 0).otherwise(F.col(side)).cast("long"))
    for name in also_clear:
        kind = voxels.schema[name].dataType
        cleaned = cleaned.withColumn(name, F.when(F.col(side) > 0, F.col(name)).otherwise(F.lit(0)).cast(kind))
    return cleaned.select(*voxels.columns)


def size_classes(voxels: DataFrame, side: str = "ref_id", threshold: int = 100) -> DataFrame:
    """case_id, id and class per instance: 2 below ``threshold`` voxels, else 1."""
    return (
        voxels.filter(F.col(side) > 0).groupBy("case_id", side).agg(F.count("*").alias("n"))
        .withColumn("small_class", F.when(F.col("n") < threshold, 2).otherwise(1).cast("long"))
    )


def paint(voxels: DataFrame, inst: DataFrame, side: str, column: str) -> DataFrame:
    """Writes an instance-level value on every voxel of the instance; 0 elsewhere."""
    marked = overlap.with_instance(voxels, inst.select("case_id", side, column), side)
    return marked.withColumn(column, F.coalesce(column, F.lit(0).cast("long")))


def centres_of_mass(voxels: DataFrame, side: str = "ref_id", keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    return voxels.filter(F.col(side) > 0).groupBy(*keys, side).agg(
        *[F.avg(a).alias(f"c{a}") for a in overlap.COORDS], F.count("*").alias("n")
    )
