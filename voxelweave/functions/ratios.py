"""Scalar formulas of the metrics, as column expressions.

``EPS`` and the nDSC reference rate are fixed values of the metric definitions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
NDSC_RATE = 0.001


def dbl(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def iou(inter, n_pred, n_ref) -> Column:
    union = dbl(n_pred) + dbl(n_ref) - dbl(inter)
    return F.when(union == 0, 0.0).otherwise(dbl(inter) / union)


def dice(inter, n_pred, n_ref) -> Column:
    """1 when both masks are empty."""
    total = dbl(n_pred) + dbl(n_ref)
    return F.when(total == 0, 1.0).otherwise(2.0 * dbl(inter) / total)


def normalised_dice(inter, n_pred, n_ref, n_all) -> Column:
    """nDSC; NULL when the reference fills the whole volume and k is undefined."""
    ref, rest = dbl(n_ref), dbl(n_all) - dbl(n_ref)
    k = F.when(ref == 0, 1.0).when(rest > 0, (1 - NDSC_RATE) * ref / (NDSC_RATE * rest))
    tp = dbl(inter)
    fp, fn = dbl(n_pred) - tp, ref - tp
    return F.when(ref + dbl(n_pred) == 0, 1.0).otherwise(2.0 * tp / (k * fp + 2.0 * tp + fn))


def hit_rate(tp, missed) -> Column:
    """tp / (tp + missed), and 1 when there was nothing to find."""
    return F.when((dbl(tp) == 0) & (dbl(missed) == 0), 1.0).otherwise(dbl(tp) / (dbl(tp) + dbl(missed) + EPS))


def f_beta(tp, fp, fn, beta: float = 1.0) -> Column:
    p = dbl(tp) / (dbl(tp) + dbl(fp) + EPS)
    r = dbl(tp) / (dbl(tp) + dbl(fn) + EPS)
    return (1 + beta**2) * ((p * r) / (beta**2 * p + r + EPS))


def panoptic_quality(sum_iou, tp, fp, fn, n_pred_inst, n_ref_inst) -> Column:
    """PQ with its empty-set rules: both empty is perfect, one-sided is 0."""
    quality = dbl(sum_iou) / F.greatest(dbl(tp), F.lit(EPS))
    found = dbl(tp) / F.greatest(dbl(tp) + 0.5 * dbl(fp) + 0.5 * dbl(fn), F.lit(EPS))
    return (
        F.when((dbl(n_pred_inst) == 0) & (dbl(n_ref_inst) == 0), 1.0)
        .when((dbl(n_ref_inst) == 0) & (dbl(fp) > 0), 0.0)
        .when((dbl(n_pred_inst) == 0) & (dbl(fn) > 0), 0.0)
        .otherwise(quality * found)
    )


def volume_mm3(n, sx="sx", sy="sy", sz="sz") -> Column:
    return dbl(n) * dbl(sx) * dbl(sy) * dbl(sz)


def too_small(n, extents, spacings, min_volume: float = 14, min_axis: float = 3) -> Column:
    """Volume at or below ``min_volume`` mm3, or any extent strictly below ``min_axis`` mm.

    ``extents`` and ``spacings`` may have two or three axes.
    """
    verdict = F.lit(False)
    volume = dbl(n)
    for extent, spacing in zip(extents, spacings):
        verdict = verdict | (dbl(extent) * dbl(spacing) < min_axis)
        volume = volume * dbl(spacing)
    return verdict | (volume <= min_volume)
