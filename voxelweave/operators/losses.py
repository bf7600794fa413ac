"""Training losses as offline scores per case (no gradients)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Smoothing of numerator and denominator in the soft Dice formula.
DICE_SMOOTH = 1e-5


def softmax_foreground(l0: str = "l0", l1: str = "l1", mask: Column | None = None) -> Column:
    """Foreground probability of two logits, times a mask."""
    p = 1.0 / (1.0 + F.exp(F.col(l0) - F.col(l1)))
    return p if mask is None else p * mask.cast("double")


def cross_entropy(l0: str = "l0", l1: str = "l1", ref: str = "g") -> Column:
    """Stable log(1 + exp(-margin)) of the true class."""
    margin = F.when(F.col(ref) > 0, F.col(l1) - F.col(l0)).otherwise(F.col(l0) - F.col(l1))
    return F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))


def focal(gamma: float = 2.0, weight: str | None = None) -> Column:
    ce = cross_entropy()
    loss = F.pow(1.0 - F.exp(-ce), F.lit(gamma)) * ce
    return loss if weight is None else loss * F.col(weight)


def _segmentation_sums(weight: str | None, gamma: float) -> list[Column]:
    p, g = softmax_foreground(), F.col("g").cast("double")
    return [F.sum(p * g).alias("__pg"), F.sum(p).alias("__p"), F.sum(g).alias("__g"), F.avg(focal(gamma, weight)).alias("focal")]


def _segmentation(sums: DataFrame, dice_weight: float, focal_weight: float, smooth: float) -> DataFrame:
    scored = sums.withColumn("dice", 1.0 - (2.0 * F.col("__pg") + smooth) / (F.col("__p") + F.col("__g") + smooth))
    return scored.withColumn("segmentation", dice_weight * F.col("dice") + focal_weight * F.col("focal"))


def segmentation_loss(df: DataFrame, weight: str | None = None, gamma: float = 2.0, dice_weight: float = 0.5,
                      focal_weight: float = 1.0, smooth: float = DICE_SMOOTH) -> DataFrame:
    """dice, focal and their weighted sum per case from logits l0, l1 and reference g in {0, 1}.

    The focal mean runs over all voxels, weighted or not.
    """
    sums = df.groupBy("case_id").agg(*_segmentation_sums(weight, gamma))
    return _segmentation(sums, dice_weight, focal_weight, smooth).select("case_id", "dice", "focal", "segmentation")


def _heatmap_mean(weight: str | None) -> Column:
    square = F.pow(F.col("heat") - F.col("heat_ref"), F.lit(2.0))
    return F.avg(square if weight is None else square * F.col(weight)).alias("heatmap")


def heatmap_loss(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Mean squared error of ``heat`` against ``heat_ref``."""
    return df.groupBy("case_id").agg(_heatmap_mean(weight))


def offset_distance(kind: str, d: Column) -> Column:
    size = F.abs(d)
    if kind == "l1":
        return size
    if kind == "smooth_l1":
        return F.when(size < 1.0, 0.5 * size * size).otherwise(size - 0.5)
    raise ValueError("the offset loss is l1 or smooth_l1")


def _offset_sums(kind: str, weight: str | None) -> list[Column]:
    g = F.col("g").cast("double")
    total = sum((offset_distance(kind, F.col(f"o{a}") - F.col(f"o{a}_ref")) for a in "xyz"), F.lit(0.0)) * g
    if weight is not None:
        total = total * F.col(weight)
    return [F.sum(total).alias("__t"), (3.0 * F.sum(g)).alias("__n")]


def _offsets() -> Column:
    return F.when(F.col("__n") > 0, F.col("__t") / F.col("__n")).otherwise(0.0).alias("offsets")


def offset_loss(df: DataFrame, kind: str = "l1", weight: str | None = None) -> DataFrame:
    """Sum over foreground and components by the foreground's component count; 0 without foreground."""
    return df.groupBy("case_id").agg(*_offset_sums(kind, weight)).select("case_id", _offsets())


def total_loss(df: DataFrame, weighted: bool = True, weight: str = "weight", kind: str = "l1", w_seg: float = 1.0,
               w_heat: float = 1.0, w_off: float = 1.0) -> DataFrame:
    """All parts and their weighted sum per case, from one pass over the voxels; the unweighted variant ignores voxel weights."""
    w = weight if weighted else None
    sums = df.groupBy("case_id").agg(*_segmentation_sums(w, 2.0), _heatmap_mean(w), *_offset_sums(kind, w))
    parts = _segmentation(sums, 0.5, 1.0, DICE_SMOOTH).select("case_id", "dice", "focal", "segmentation", "heatmap", _offsets())
    loss = w_seg * F.col("segmentation") + w_heat * F.col("heatmap") + w_off * F.col("offsets")
    return parts.withColumn("loss", loss)
