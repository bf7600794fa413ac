"""Dilation, and instances that touch once dilated."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.operators import bricks
from voxelweave.operators.components import REACH, face_links, label_codes, merge_pieces, pack
from voxelweave.operators.overlap import COORDS
from voxelweave.session import by_rows, materialize, shuffled

def cross_ball(times: int) -> list[tuple[int, int, int]]:
    """Offsets reached by ``times`` steps of the 6-neighbour cross."""
    span = range(-times, times + 1)
    return [(a, b, c) for a in span for b in span for c in span if abs(a) + abs(b) + abs(c) <= times]


def dilate(mask: DataFrame, cases: DataFrame, times: int = 1, keys: tuple[str, ...] = ("case_id",), side: int = bricks.SIDE) -> DataFrame:
    """The mask grown ``times`` times by the cross, clipped to the grid.

    Inside a brick with a halo of ``times``, every step ors the mask with its six
    shifts; no voxel travels more often than the halo asks.
    """
    keys = list(keys)
    rows = mask.select(*keys, *COORDS).join(cases.select("case_id", "nx", "ny", "nz"), "case_id")
    columns = [*keys, *COORDS]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    wide = side + 2 * times

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pdf.iloc[:0][columns]]
        for low, high in bricks.brick_slices(pdf, keys):
            part = pdf.iloc[low:high]
            head = part.iloc[0]
            origin = np.array([head[f"b{a}"] * side for a in COORDS], dtype=np.int64)
            here = np.zeros((wide,) * 3, dtype=bool)
            here[tuple(part[a].to_numpy() - o + times for a, o in zip(COORDS, origin))] = True
            for _ in range(times):
                grown = here.copy()
                for axis in range(3):
                    ahead, behind = [slice(None)] * 3, [slice(None)] * 3
                    ahead[axis], behind[axis] = slice(1, None), slice(None, -1)
                    grown[tuple(ahead)] |= here[tuple(behind)]
                    grown[tuple(behind)] |= here[tuple(ahead)]
                here = grown
            # What leaves the grid comes back only by a longer way.
            at = np.argwhere(here[(slice(times, times + side),) * 3]) + origin
            at = at[((at >= 0) & (at < head[["nx", "ny", "nz"]].to_numpy(dtype=np.int64))).all(axis=1)]
            out.append(pd.DataFrame({**{k: np.full(len(at), head[k]) for k in keys}, **dict(zip(COORDS, at.T))})[columns])
        return pd.concat(out, ignore_index=True)

    return bricks.map_bricks(rows, keys, side, run, ", ".join(f"{c} {kinds[c]}" for c in columns), halo=times)


def _brick_confluence(side: int, variants: list[tuple[int, int]]):
    """Per brick and variant: the (piece, ref_id) pairs, and the voxels on the brick's faces.

    Dilation happens inside the brick: the halo brings every voxel that can reach it.
    """
    halo = max(t for t, _ in variants)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        code, wide = bricks.brick_codes(pdf, ["case_id"], side, halo, halo + 1)
        cube, shift = wide**3, halo + halo + 1
        group, starts = np.unique(code // cube, return_index=True)
        origin = {a: pdf[f"b{a}"].to_numpy()[starts] * side for a in COORDS}
        case, size = pdf["case_id"].to_numpy()[starts], pdf[["nx", "ny", "nz"]].to_numpy()[starts]
        ids = pdf["ref_id"].to_numpy()
        parts = []
        for tier in sorted({t for t, _ in variants}):
            grown = code
            if tier:
                steps = [(a * wide + b) * wide + c for a, b, c in cross_ball(tier)]
                grown = np.unique(np.concatenate([code + s for s in steps]))
            g = np.searchsorted(group, grown // cube)
            local = np.stack([grown // wide**2 % wide, grown // wide % wide, grown % wide]) - shift
            at = [local[i] + origin[a][g] for i, a in enumerate(COORDS)]
            mine = ((local >= 0) & (local < side)).all(axis=0)
            for i in range(3):
                mine &= (at[i] >= 0) & (at[i] < size[g, i])
            grown, g, local, at = grown[mine], g[mine], local[:, mine], [v[mine] for v in at]
            if len(grown) == 0:
                continue
            found = np.minimum(np.searchsorted(code, grown), len(code) - 1)
            ref = np.where(code[found] == grown, ids[found], 0)
            rim = ((local == 0) | (local == side - 1)).any(axis=0)
            for conn in [c for t, c in variants if t == tier]:
                first = label_codes(grown, wide, REACH[conn])
                frame = pd.DataFrame({
                    "case_id": case[g], "tier": tier, "conn": conn, "piece": pack(*[v[first] for v in at]),
                    "ref_id": ref, "x": at[0], "y": at[1], "z": at[2],
                })
                held = frame.loc[ref > 0, ["case_id", "tier", "conn", "piece", "ref_id"]].drop_duplicates()
                parts += [held.assign(x=-1, y=-1, z=-1), frame[rim].assign(ref_id=0)]
        columns = ["case_id", "tier", "conn", "piece", "ref_id", *COORDS]
        return pd.concat(parts)[columns] if parts else pd.DataFrame(columns=columns, dtype="int64")

    return run


def confluent_instances(voxels: DataFrame, cases: DataFrame, variants=((0, 6),), side: int = bricks.SIDE) -> DataFrame:
    """Ids of reference instances that share a (dilated) component with another one.

    One shuffle of the reference voxels serves all (tier, connectivity) variants.
    Bricks give back pairs of piece and id, and only for grids that need several
    bricks the voxels on their faces, by which pieces are joined.
    Result: case_id, tier, conn, ref_id.
    """
    variants = [tuple(v) for v in variants]
    refs = voxels.filter("ref_id > 0").join(cases.select("case_id", "nx", "ny", "nz"), "case_id")
    rows = refs.select("case_id", *COORDS, "ref_id", "nx", "ny", "nz")
    problem = ["case_id", "tier", "conn"]
    schema = ", ".join(f"{c} bigint" for c in [*problem, "piece", "ref_id", *COORDS])
    found = bricks.map_bricks(rows, ["case_id"], side, _brick_confluence(side, variants), schema,
                              halo=max(t for t, _ in variants))
    found = materialize(found, "confluence")
    faces = found.filter("ref_id = 0").select(*problem, *COORDS, "piece")
    merged = merge_pieces(face_links(faces, ["case_id", "tier"], side), problem)
    held = found.filter("ref_id > 0").select(*problem, "piece", "ref_id")
    held = (
        held.withColumnRenamed("piece", "root") if merged is None
        else held.join(by_rows(merged), [*problem, "piece"], "left").select(*problem, F.coalesce("root", "piece").alias("root"), "ref_id")
    )
    # A root has two distinct ids exactly when its smallest and largest id differ.
    shared = held.groupBy(*problem, "root").agg(F.min("ref_id").alias("a"), F.max("ref_id").alias("b")).filter("a < b")
    return held.join(shuffled(shared.select(*problem, "root")), [*problem, "root"], "left_semi").select(*problem, "ref_id").distinct()


def confluence_classes(voxels: DataFrame, cases: DataFrame, side: int = bricks.SIDE) -> DataFrame:
    """case_id, ref_id and class per instance: 2 when confluent (tier 0, 6 neighbours), else 1."""
    ids = voxels.filter("ref_id > 0").select("case_id", "ref_id").distinct()
    hit = confluent_instances(voxels, cases, ((0, 6),), side).select("case_id", "ref_id", F.lit(True).alias("__c"))
    return ids.join(hit, ["case_id", "ref_id"], "left").select(
        "case_id", "ref_id", F.when(F.col("__c"), 2).otherwise(1).cast("long").alias("confluent_class")
    )
