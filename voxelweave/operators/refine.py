"""Contiguous ids, and the final clean-up of predicted instances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.operators import bricks, sizes
from voxelweave.operators.components import component_table, components
from voxelweave.operators.overlap import COORDS, with_instance
from voxelweave.operators.ranking import rank_in_group
from voxelweave.session import materialize


def relabel(voxels: DataFrame, side: str) -> DataFrame:
    """Ids 1..n per case in ascending order; background stays 0."""
    ids = voxels.filter(F.col(side) > 0).select("case_id", side).distinct()
    numbered = rank_in_group(ids, ["case_id"], [F.col(side)], [F.floor(F.col(side) / 4096)], "__new")
    joined = with_instance(voxels, numbered.select("case_id", side, "__new"), side)
    return joined.withColumn(side, F.coalesce("__new", F.lit(0).cast("long"))).select(*voxels.columns)


def component_sizes(voxels: DataFrame, cases: DataFrame, inst: str = "inst", brick: int = bricks.SIDE) -> DataFrame:
    """Connected components of every instance with their size and box."""
    rows = voxels.filter(F.col(inst) > 0)
    return component_table(components(rows, cases, 6, ("case_id", inst), brick), ("case_id", inst))


def remove_small_components(mask: DataFrame, cases: DataFrame, min_volume: float = 14, min_axis: float = 3, conn: int = 6,
                            brick: int = bricks.SIDE) -> DataFrame:
    """The mask (case_id, x, y, z) without its too-small components."""
    rooted = materialize(components(mask.select("case_id", *COORDS), cases, conn, side=brick), "rooted")
    small = sizes.size_verdicts(component_table(rooted), cases, min_volume, min_axis).filter("too_small")
    return rooted.join(small.select("case_id", "root"), ["case_id", "root"], "left_anti").select("case_id", *COORDS)


def refine(voxels: DataFrame, cases: DataFrame, inst: str = "inst", min_volume: float = 0, min_axis: float = 0,
           brick: int = bricks.SIDE) -> DataFrame:
    """Splits instances into components, drops small ones, numbers the rest 1..n.

    Components of an instance count from the largest (ties: first in scan order).
    From the first too-small one on, the rest of the instance goes. The largest
    keeps its id; further ones follow after all ids, in order of instance and
    size. Only component-sized tables are ordered, never voxels.
    """
    return refine_rooted(components(voxels.filter(F.col(inst) > 0), cases, 6, ("case_id", inst), brick), cases, inst, min_volume, min_axis)


def refine_rooted(rooted: DataFrame, cases: DataFrame, inst: str = "inst", min_volume: float = 0, min_axis: float = 0) -> DataFrame:
    """:func:`refine` for voxels whose component inside their instance is known by ``root``."""
    rooted = materialize(rooted, "rooted")
    table = materialize(sizes.size_verdicts(component_table(rooted, ("case_id", inst)), cases, min_volume, min_axis), "sizes")
    place = F.struct((-F.col("n")).alias("neg_n"), F.col("root").alias("root"))
    per_inst = table.groupBy("case_id", inst).agg(
        F.min(F.when(F.col("too_small"), place)).alias("stop"), F.min(place).alias("top")
    )
    kept = table.join(per_inst, ["case_id", inst]).filter(F.col("stop").isNull() | (place < F.col("stop")))
    kept = kept.select("case_id", inst, "root", "n", (place != F.col("top")).cast("int").alias("extra"))
    numbered = rank_in_group(
        kept, ["case_id"], [F.col("extra"), F.col(inst), F.col("n").desc(), F.col("root")],
        [F.col("extra"), F.floor(F.col(inst) / F.when(F.col("extra") == 0, 4096).otherwise(1))], "new_id",
    )
    return rooted.join(numbered.select("case_id", inst, "root", "new_id"), ["case_id", inst, "root"]).select(
        "case_id", *COORDS, F.col("new_id").alias(inst)
    )
