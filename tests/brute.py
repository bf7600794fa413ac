"""Slow per-case reference rules in plain NumPy, for small volumes only."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd

REACH = {6: 1, 18: 2, 26: 3}


def label(mask: np.ndarray, conn: int) -> np.ndarray:
    """Components numbered in scan order."""
    steps = [s for s in itertools.product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, s)) <= REACH[conn]]
    out, n = np.zeros(mask.shape, dtype=int), 0
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n += 1
        out[start], todo = n, [start]
        while todo:
            at = todo.pop()
            for s in steps:
                to = tuple(a + b for a, b in zip(at, s))
                if all(0 <= c < m for c, m in zip(to, mask.shape)) and mask[to] and not out[to]:
                    out[to] = n
                    todo.append(to)
    return out


def dilate(mask: np.ndarray) -> np.ndarray:
    out = mask.copy()
    for axis in range(3):
        for shift in (-1, 1):
            rolled = np.roll(mask, shift, axis)
            edge = [slice(None)] * 3
            edge[axis] = 0 if shift == 1 else -1
            rolled[tuple(edge)] = False
            out |= rolled
    return out


def confluent(ref: np.ndarray, tier: int, conn: int) -> set[int]:
    """Ids that share a component of the dilated mask with another id."""
    mask = ref > 0
    for _ in range(tier):
        mask = dilate(mask)
    pairs = pd.DataFrame({"part": label(mask, conn)[ref > 0], "id": ref[ref > 0]}).drop_duplicates()
    return set(pairs.loc[pairs.groupby("part")["id"].transform("size") > 1, "id"])


def match(pred: np.ndarray, ref: np.ndarray, threshold: float = 0.1):
    """(kept, removed) as dicts pred -> (ref, iou): each pred's best ref, then each ref's best pred; ties to the smaller id."""
    voxels = pd.DataFrame({"pred": pred.ravel(), "ref": ref.ravel()})
    pairs = voxels[(voxels["pred"] > 0) & (voxels["ref"] > 0)].value_counts().rename("inter").reset_index()
    total = pairs["pred"].map(voxels["pred"].value_counts()) + pairs["ref"].map(voxels["ref"].value_counts())
    pairs["iou"] = pairs["inter"] / (total - pairs["inter"])
    ordered = pairs.sort_values(["iou", "pred", "ref"], ascending=[False, True, True])
    best = ordered.drop_duplicates("pred")
    best = best[best["iou"] > threshold]
    first = ~best.duplicated("ref")
    table = lambda part: {r.pred: (r.ref, r.iou) for r in part.itertuples()}
    return table(best[first]), table(best[~first])


def rows(volume: np.ndarray, case: int = 0) -> list[tuple]:
    return [(case, *map(int, at), int(volume[at])) for at in zip(*np.nonzero(volume))]
