"""Instance centres from a heatmap, and the votes of offset fields."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelweave.operators import bricks
from voxelweave.operators.components import _key_bucket, components
from voxelweave.operators.nearest import nearest_site
from voxelweave.operators.overlap import COORDS
from voxelweave.operators.ranking import rank_in_group
from voxelweave.operators.stencil import local_maxima
from voxelweave.schema import AXIS_BITS, voxel_key
from voxelweave.session import materialize, shuffled, ship_package

OFFSETS = {"x": "ox", "y": "oy", "z": "oz"}


def one_per_plateau(maxima: DataFrame, cases: DataFrame, side: int = bricks.SIDE) -> DataFrame:
    """Of touching maxima (which are equal) only the first in scan order stays."""
    rooted = components(maxima, cases, 6, side=side)
    first = rooted.filter(voxel_key() == F.col("root")).select("case_id", *COORDS)
    return maxima.join(shuffled(first), ["case_id", *COORDS], "left_semi")


def top_k(centres: DataFrame, k: int | None) -> DataFrame:
    """Per case the centres whose heat is at least the k-th largest; ties stay."""
    if k is None:
        return centres
    # rank() <= k lets Spark keep only candidates of each partition before the shuffle.
    ranked = centres.withColumn("__rank", F.rank().over(W.partitionBy("case_id").orderBy(F.col("heat").desc())))
    return ranked.filter(F.col("__rank") <= k).drop("__rank")


def number_centres(centres: DataFrame) -> DataFrame:
    """centre_id 1..n in scan order."""
    keyed = centres.withColumn("__key", voxel_key())
    return rank_in_group(keyed, ["case_id"], [F.col("__key")], _key_bucket(F.col("__key"))[1:], "centre_id").drop("__key")


def find_centres(heat: DataFrame, cases: DataFrame, threshold: float = 0.1, kernel: int = 3, k: int | None = None,
                 side: int = bricks.SIDE) -> DataFrame:
    """case_id, x, y, z, heat of the instance centres."""
    maxima = local_maxima(heat.select("case_id", *COORDS, "heat"), "heat", threshold, kernel, side=side)
    return top_k(one_per_plateau(maxima, cases, side), k)


def calibrate_offsets(offsets: DataFrame, centres: DataFrame) -> DataFrame:
    """Subtracts each case's mean offset at its centre voxels."""
    bias = (
        offsets.join(centres.select("case_id", *COORDS), ["case_id", *COORDS], "left_semi")
        .groupBy("case_id").agg(*[F.avg(o).alias(f"bias_{o}") for o in OFFSETS.values()])
    )
    joined = offsets.join(bias, "case_id", "left")
    return joined.withColumns({
        o: F.col(o) - F.coalesce(f"bias_{o}", F.lit(0.0)) for o in OFFSETS.values()
    }).select(*offsets.columns)


#: Votes travel in cubes of this many bits a side.
VOTE_BITS = 3
#: A batch is counted in an array of its whole box if that has at most so many cells for each row, else sorted.
SPARSE = 16


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """case_id and voxel key to one row for each cube of the batch: its place, the voxels in it and how often each one came."""
    inner = 3 * VOTE_BITS
    for batch in batches:
        if batch.num_rows == 0:
            continue
        case, key = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
        at = [(key >> AXIS_BITS * (2 - i)) & (1 << AXIS_BITS) - 1 for i in range(3)]
        run = np.cumsum(np.r_[False, case[1:] != case[:-1]])  # a case may have several runs; their counts are added later
        low = [int(v.min()) >> VOTE_BITS for v in at]
        wide = [(int(v.max()) >> VOTE_BITS) + 1 - lo for v, lo in zip(at, low)]
        code = np.zeros(len(case), dtype=np.int64)
        for v, lo, w in zip(at, low, wide):
            code = code * w + ((v >> VOTE_BITS) - lo)
        for v in at:
            code = (code << VOTE_BITS) | (v & (1 << VOTE_BITS) - 1)
        cells = math.prod(wide) << inner
        if cells * (int(run[-1]) + 1) <= SPARSE * len(case):
            total = np.bincount(run * cells + code)
            start = np.flatnonzero(total)
            n, run, code = total[start], start // cells, start % cells
        else:
            order = np.lexsort((code, run))
            run, code = run[order], code[order]
            start = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (code[1:] != code[:-1])])
            n, run, code = np.diff(start, append=len(code)), run[start], code[start]
        cube = code >> inner
        first = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (cube[1:] != cube[:-1])])
        begins = np.flatnonzero(np.r_[True, case[1:] != case[:-1]])
        ends, left, place = pa.array(np.append(first, len(code)).astype(np.int32)), cube[first], {}
        for a, lo, w in reversed(list(zip(COORDS, low, wide))):
            left, place[a] = left // w, left % w + lo
        yield pa.RecordBatch.from_arrays([
            pa.array(case[begins[run[first]]]), *[pa.array(place[a]) for a in COORDS],
            pa.ListArray.from_arrays(ends, pa.array((code & (1 << inner) - 1).astype(np.int16))),
            pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32))),
        ], names=["case_id", *[f"o{a}" for a in COORDS], "at", "n"])


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The counts of whole cubes, clamped to the grid."""
    side = 1 << VOTE_BITS
    row = np.repeat(np.arange(len(pdf)), pdf["at"].map(len).to_numpy())
    at, n = np.concatenate(pdf["at"].to_list()).astype(np.int64), np.concatenate(pdf["n"].to_list())
    cubes = bricks.brick_slices(pdf, ["case_id"])
    first = np.array([start for start, _ in cubes])
    code = np.repeat(np.arange(len(cubes)), np.diff(first, append=len(pdf)))[row]
    for i, a in enumerate(COORDS):
        place = (pdf[f"o{a}"].to_numpy()[row] << VOTE_BITS) + ((at >> VOTE_BITS * (2 - i)) & side - 1)
        code = code * side + (np.minimum(place, pdf[f"n{a}"].to_numpy()[row] - 1) & side - 1)
    total = np.bincount(code, weights=n)
    code = np.flatnonzero(total)
    there = first[code >> 3 * VOTE_BITS]
    where = {a: (pdf[f"b{a}"].to_numpy()[there] << VOTE_BITS) + ((code >> VOTE_BITS * (2 - i)) & side - 1) for i, a in enumerate(COORDS)}
    return pd.DataFrame({"case_id": pdf["case_id"].to_numpy()[there], **where, "votes": total[code].astype(np.int64)})


def votes(offsets: DataFrame, cases: DataFrame) -> DataFrame:
    """Number of voxels that point at each voxel: half-even rounding, clamped to the grid.

    A batch of voxels becomes counts in small cubes before anything is shuffled, so a
    task holds one batch or the counts of a few cubes, however many voxels there are.
    """
    def target(a: str) -> Column:
        at = F.rint(F.col(a) + F.col(OFFSETS[a])).cast("long")
        return F.least(F.greatest(at, F.lit(0).cast("long")), F.lit(2 ** AXIS_BITS - 1).cast("long"))

    kind = offsets.schema["case_id"].dataType.simpleString()
    aimed = offsets.filter("case_id IS NOT NULL").select("case_id", voxel_key(*[target(a) for a in COORDS]).alias("key"))
    ship_package(offsets.sparkSession)
    counted = aimed.mapInArrow(_counted, f"case_id {kind}, ox bigint, oy bigint, oz bigint, at array<smallint>, n array<int>")
    sized = counted.join(cases.select("case_id", "nx", "ny", "nz"), "case_id").withColumns({
        f"b{a}": F.least(F.col(f"o{a}"), F.shiftright(F.col(f"n{a}") - 1, VOTE_BITS)) for a in COORDS})
    return bricks.map_placed(sized, ["case_id"], _summed, f"case_id {kind}, x bigint, y bigint, z bigint, votes bigint", [])


def assign_to_centres(foreground: DataFrame, centres: DataFrame, radius: int = 4) -> DataFrame:
    """instance id of each foreground voxel: the numbered centre nearest to where its offset points."""
    numbered = number_centres(centres).select(
        "case_id", F.col("centre_id").alias("site"), *[F.col(a).alias(f"s{a}") for a in COORDS]
    )
    pointing = foreground.select(
        "case_id", *COORDS, *[(F.col(a) + F.col(OFFSETS[a])).alias(f"p{a}") for a in COORDS]
    )
    return nearest_site(pointing, numbered, COORDS, radius=radius, label="votes").select(
        "case_id", *COORDS, F.col("site").alias("inst"), "d2"
    )


def _ball(radius: int) -> list[tuple[int, int, int, int]]:
    """Offsets by distance, then in scan order: (d2, dx, dy, dz), all within ``radius``."""
    span = range(-radius, radius + 1)
    steps = [(a * a + b * b + c * c, a, b, c) for a in span for b in span for c in span]
    return sorted(s for s in steps if 0 < s[0] <= radius * radius)


def spread_labels(unlabelled: DataFrame, labelled: DataFrame, value: str, radius: int = 4,
                  side: int = bricks.SIDE) -> DataFrame:
    """``value`` of the nearest labelled voxel, ties to the first in scan order.

    Within ``radius`` the answer is the first labelled voxel met when walking the
    offsets by distance; a brick with a halo holds all of them. Voxels that are
    farther from any label go to the general search. Its sites are the labelled
    voxels with an unlabelled face neighbour: from any other one, a step towards
    the voxel leads to a nearer label.
    """
    kind = labelled.schema[value].dataType.simpleString()
    nothing = F.lit(None).cast(kind)
    rows = labelled.select("case_id", *COORDS, F.col(value).alias("value")).unionByName(
        unlabelled.select("case_id", *COORDS, nothing.alias("value"))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        code, wide = bricks.brick_codes(pdf, ["case_id"], side, radius, radius)
        known = pdf["value"].notna().to_numpy()
        sites, label = code[known], pdf["value"].to_numpy()[known]
        inside = np.ones(len(pdf), dtype=bool)
        for a in COORDS:
            inside &= (pdf[a] // side == pdf[f"b{a}"]).to_numpy()
        core = ~known & inside
        todo = np.flatnonzero(core)
        found = np.zeros(len(pdf), dtype=label.dtype)
        hit = np.zeros(len(pdf), dtype=bool)
        for _, dx, dy, dz in _ball(radius) if len(sites) else ():
            if len(todo) == 0:
                break
            target = code[todo] + (dx * wide + dy) * wide + dz
            at = np.minimum(np.searchsorted(sites, target), len(sites) - 1)
            ok = sites[at] == target
            found[todo[ok]], hit[todo[ok]] = label[at[ok]], True
            todo = todo[~ok]
        edge = np.zeros(len(pdf), dtype=bool)
        for step in (wide * wide, wide, 1):
            for target in (sites - step, sites + step):
                at = np.minimum(np.searchsorted(sites, target), len(sites) - 1)
                edge[known] |= sites[at] != target
        edge &= inside
        found[known], hit[known] = label, True
        out = pdf.loc[core | edge, ["case_id", *COORDS]]
        value = pd.Series(found, index=pdf.index)[core | edge].where(pd.Series(hit, index=pdf.index)[core | edge])
        return out.assign(value=value, edge=edge[core | edge])

    schema = f"case_id bigint, x bigint, y bigint, z bigint, value {kind}, edge boolean"
    near = materialize(bricks.map_bricks(rows, ["case_id"], side, run, schema, halo=radius), "spread")
    done = near.filter("NOT edge AND value IS NOT NULL").select("case_id", *COORDS, F.col("value").alias(value))
    rest = near.filter("value IS NULL")
    if rest.isEmpty():
        return done
    edges = near.filter("edge").select("case_id", *COORDS, voxel_key().alias("site"), F.col("value").alias(value))
    sites = edges.select("case_id", "site", *[F.col(a).alias(f"s{a}") for a in COORDS])
    at = rest.select("case_id", *COORDS, *[F.col(a).alias(f"p{a}") for a in COORDS])
    found = nearest_site(at, sites, COORDS, radius=2 * radius, label="spread").select("case_id", *COORDS, "site")
    far = found.join(edges.select("case_id", "site", value), ["case_id", "site"])
    return done.unionByName(far.select("case_id", *COORDS, value))
