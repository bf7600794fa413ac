"""Canonical tables.

``voxels`` is sparse: background rows are absent, and a case's grid size and
spacing live in ``cases``. The voxel key packs a coordinate triple into one LONG
whose order is the C order of the dense volume, so no grid size is needed to
build it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AXES = ("x", "y", "z")
AXIS_BITS = 20

VOXELS = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("case_id", "x", "y", "z", "ref_id", "pred_id")]
)

BUNDLE = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("case_bucket", "case_id", "x", "y", "z")]
    + [
        T.StructField("intensity", T.DoubleType()),
        T.StructField("seg", T.LongType()),
        T.StructField("instance_seg", T.LongType()),
        T.StructField("center_heatmap", T.DoubleType()),
        T.StructField("small_object_classes", T.LongType()),
        T.StructField("confluent_instances", T.LongType()),
        T.StructField("small_objects_and_confluent_instances_classes", T.LongType()),
    ]
)


def voxel_key(x="x", y="y", z="z") -> Column:
    """Order-preserving key of a grid position (each axis below 2**20)."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.shiftleft(col(x), 2 * AXIS_BITS) + F.shiftleft(col(y), AXIS_BITS) + col(z)
