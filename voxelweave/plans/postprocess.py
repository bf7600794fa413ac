"""From model output maps to instances."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.operators import bricks, centres, integrity, stencil
from voxelweave.operators.components import components, number_components
from voxelweave.operators.overlap import COORDS
from voxelweave.operators.refine import refine, refine_rooted
from voxelweave.session import materialize, shuffled

SEMANTIC_THRESHOLD = 0.5


class Postprocessor(Protocol):
    """A post-processor turns maps and the case table into (case_id, x, y, z, inst)."""

    def __call__(self, maps: DataFrame, cases: DataFrame) -> DataFrame: ...


def foreground(maps: DataFrame, threshold: float = SEMANTIC_THRESHOLD) -> DataFrame:
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie in [0, 1]")
    return maps.filter(F.col("proba") > threshold)


def connected(maps: DataFrame, cases: DataFrame, threshold: float = SEMANTIC_THRESHOLD, min_volume: float = 0,
              min_axis: float = 0, side: int = bricks.SIDE) -> DataFrame:
    """CC: every connected component of the mask is an instance."""
    rooted = components(foreground(maps, threshold), cases, 6, side=side)
    # An instance is one component, so there is nothing to split again.
    return refine_rooted(number_components(rooted, out="inst"), cases, "inst", min_volume, min_axis)


def by_offsets(maps: DataFrame, cases: DataFrame, threshold: float = SEMANTIC_THRESHOLD, heat_threshold: float = 0.1,
               kernel: int = 3, k: int | None = None, calibrate: bool = False, min_volume: float = 0,
               min_axis: float = 0, side: int = bricks.SIDE) -> DataFrame:
    """Mask voxels go to the centre nearest to where their offset points; no centre, no instance."""
    found = materialize(centres.find_centres(maps, cases, heat_threshold, kernel, k, side), "centres")
    offsets = maps.select("case_id", *COORDS, "proba", *centres.OFFSETS.values())
    if calibrate:
        offsets = centres.calibrate_offsets(offsets, found)
    grouped = centres.assign_to_centres(foreground(offsets, threshold), found)
    return refine(grouped.select("case_id", *COORDS, "inst"), cases, "inst", min_volume, min_axis, side)


def ridge_clusters(maps: DataFrame, cases: DataFrame, threshold: float = SEMANTIC_THRESHOLD, sigma: float = 1.0,
                   conn: int = 26, side: int = bricks.SIDE) -> DataFrame:
    """Clusters of mask voxels where the masked probability curves down in every direction."""
    peaks = stencil.hessian(foreground(maps, threshold), "proba", cases, sigma, side).filter(stencil.negative_definite())
    return components(peaks, cases, conn, side=side)


def ridge_centres(maps: DataFrame, cases: DataFrame, threshold: float = SEMANTIC_THRESHOLD, sigma: float = 1.0,
                  side: int = bricks.SIDE) -> DataFrame:
    """Rounded mean position of each 6-connected cluster."""
    rooted = ridge_clusters(maps, cases, threshold, sigma, 6, side)
    return rooted.groupBy("case_id", "root").agg(
        *[F.rint(F.avg(a)).cast("long").alias(a) for a in COORDS]
    ).select("case_id", *COORDS)


def by_ridges(maps: DataFrame, cases: DataFrame, threshold: float = SEMANTIC_THRESHOLD, sigma: float = 1.0,
              conn: int = 26, min_volume: float = 0, min_axis: float = 0, side: int = bricks.SIDE) -> DataFrame:
    """ACLS: clusters grow over the mask by nearest labelled voxel; cases without clusters use components."""
    mask = foreground(maps, threshold).select("case_id", *COORDS)
    rooted = materialize(ridge_clusters(maps, cases, threshold, sigma, conn, side), "clusters")
    labelled = materialize(number_components(rooted, out="inst").select("case_id", *COORDS, "inst"), "labelled")
    rest = mask.join(shuffled(labelled), ["case_id", *COORDS], "left_anti")
    grown = centres.spread_labels(rest, labelled, "inst")
    bare = mask.join(labelled.select("case_id").distinct(), "case_id", "left_anti")
    plain = number_components(components(bare, cases, 6, side=side), out="inst").select("case_id", *COORDS, "inst")
    everything = labelled.unionByName(grown).unionByName(plain)
    return refine(everything, cases, "inst", min_volume, min_axis, side)


def ensemble(members: DataFrame, attributes: list[str], n_models: int) -> DataFrame:
    """Sum of the members' outputs divided by the number of members; a missing value adds nothing."""
    return members.groupBy("case_id", *COORDS).agg(*[(F.coalesce(F.sum(a), F.lit(0.0)) / F.lit(float(n_models))).alias(a) for a in attributes])


POSTPROCESSORS: dict[str, Postprocessor] = {"CC": connected, "ACLS": by_ridges, "OFFSETS": by_offsets}


def register_postprocessor(name: str, fn: Postprocessor) -> None:
    POSTPROCESSORS[name] = fn


def postprocess(maps: DataFrame, cases: DataFrame, names: list[str], **options) -> DataFrame:
    """Runs several post-processors and tags their rows with ``postprocessor``.

    Voxels without a case row or outside their grid raise an error.
    """
    integrity.require_voxels(maps, cases)
    parts = [POSTPROCESSORS[n](maps, cases, **options).withColumn("postprocessor", F.lit(n)) for n in names]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
