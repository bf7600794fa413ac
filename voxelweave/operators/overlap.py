"""Aligning two label volumes and matching their instances.

Everything about sizes and overlaps comes from one *contingency table*: voxel
counts and bounding boxes by (case, pred_id, ref_id). It is one partially
aggregated pass over the voxels; after it, only instance-sized rows move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.functions import ratios
from voxelweave.session import shuffled

COORDS = ["x", "y", "z"]


def align(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """Full outer join of (case_id, x, y, z, pred_id) and (…, ref_id); 0 is background."""
    zero = F.lit(0).cast("long")
    return pred.join(shuffled(ref), ["case_id", *COORDS], "full_outer").select(
        "case_id", *COORDS,
        F.coalesce("ref_id", zero).alias("ref_id"),
        F.coalesce("pred_id", zero).alias("pred_id"),
    )


def with_instance(voxels: DataFrame, inst: DataFrame, side: str) -> DataFrame:
    """Left join of instance-level columns on (case_id, ``side``).

    Background rows match nothing, and a case has very many of them: they get
    spread-out keys instead of all meeting in the task of (case, 0).
    """
    spread = -1 - F.pmod(F.xxhash64(*COORDS), F.lit(4096))
    keyed = voxels.withColumn("__id", F.when(F.col(side) > 0, F.col(side)).otherwise(spread))
    return keyed.join(inst.withColumnRenamed(side, "__id"), ["case_id", "__id"], "left").drop("__id")


def bounds() -> list[Column]:
    return [agg(a).alias(f"{name}_{a}") for a in COORDS for name, agg in (("lo", F.min), ("hi", F.max))]


def merged_bounds() -> list[Column]:
    return [
        agg(f"{name}_{a}").alias(f"{name}_{a}") for a in COORDS for name, agg in (("lo", F.min), ("hi", F.max))
    ]


def contingency(voxels: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """keys, pred_id, ref_id, n, and the bounding box of each combination."""
    return voxels.groupBy(*keys, "pred_id", "ref_id").agg(F.count("*").alias("n"), *bounds())


def instances(table: DataFrame, side: str, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Instance sizes and boxes of one side (``pred_id`` or ``ref_id``) of a contingency table."""
    return (
        table.filter(F.col(side) > 0)
        .groupBy(*keys, side)
        .agg(F.sum("n").alias("n"), *merged_bounds())
    )


def overlap_pairs(table: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """keys, pred_id, ref_id, inter, n_pred, n_ref, iou, dice for every touching pair."""
    keys = list(keys)
    n_pred = table.filter("pred_id > 0").groupBy(*keys, "pred_id").agg(F.sum("n").alias("n_pred"))
    n_ref = table.filter("ref_id > 0").groupBy(*keys, "ref_id").agg(F.sum("n").alias("n_ref"))
    both = table.filter("pred_id > 0 AND ref_id > 0").select(*keys, "pred_id", "ref_id", F.col("n").alias("inter"))
    pairs = both.join(n_pred, [*keys, "pred_id"]).join(n_ref, [*keys, "ref_id"])
    return pairs.select(
        *keys, "pred_id", "ref_id", "inter", "n_pred", "n_ref",
        ratios.iou("inter", "n_pred", "n_ref").alias("iou"),
        ratios.dice("inter", "n_pred", "n_ref").alias("dice"),
    )


_PAIR = ["inter", "n_pred", "n_ref", "iou", "dice"]


def best_ref_per_pred(pairs: DataFrame, threshold: float = 0.1, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """The ref of largest IoU of each pred, ties to the smallest ref id, strictly above ``threshold``."""
    best = F.max(F.struct("iou", (-F.col("ref_id")).alias("__r"), *[c for c in _PAIR if c != "iou"])).alias("b")
    return (
        pairs.groupBy(*keys, "pred_id").agg(best)
        .filter(F.col("b.iou") > threshold)
        .select(*keys, "pred_id", (-F.col("b.__r")).alias("ref_id"), *[F.col(f"b.{c}").alias(c) for c in _PAIR])
    )


def best_pred_per_ref(best: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Adds ``kept``: true for the pred of largest IoU of each ref (ties to the smallest id).

    A pred that loses its ref is *removed*; it is never matched to a second choice.
    """
    winner = best.groupBy(*keys, "ref_id").agg(
        F.max(F.struct("iou", (-F.col("pred_id")).alias("__p"))).alias("w")
    ).select(*keys, "ref_id", (-F.col("w.__p")).alias("__winner"))
    return best.join(winner, [*keys, "ref_id"]).withColumn("kept", F.col("pred_id") == F.col("__winner")).drop("__winner")


def match(table: DataFrame, threshold: float = 0.1, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Matched pairs of a contingency table, with ``kept`` telling matches from removed ones."""
    return best_pred_per_ref(best_ref_per_pred(overlap_pairs(table, keys), threshold, keys), keys)


def unmatched(table: DataFrame, matches: DataFrame, side: str, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Instances of one side that no kept pair holds; removed preds count as unmatched."""
    kept = matches.filter("kept").select(*keys, side)
    return instances(table, side, keys).select(*keys, side, "n").join(kept, [*keys, side], "left_anti")


def ids_missing_from(ids: DataFrame, table: DataFrame, side: str, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Ids that the label volume does not hold; empty when ``ids`` is a subset."""
    present = table.select(*keys, side).distinct()
    return ids.select(*keys, side).join(present, [*keys, side], "left_anti")
