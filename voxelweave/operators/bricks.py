"""Fixed-size bricks: the unit of work for neighbourhood operators.

A volume is cut into cubes of a fixed side. A task handles whole bricks, so what
it holds at a time is limited by the brick's volume, however large one case is.
A halo copies the rows near a face to the neighbouring bricks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.operators.overlap import COORDS
from voxelweave.session import ship_package

SIDE = 64


def with_bricks(df: DataFrame, side: int, halo: int = 0, from_zero: bool = False) -> DataFrame:
    """Adds brick indices bx, by, bz; with a halo, a row is repeated for every brick it serves.

    ``from_zero`` says that no row lies below 0, so none serves a brick there.
    """
    for a in COORDS:
        if halo:
            low = F.floor((F.col(a) - halo) / side)
            low = F.greatest(low, F.lit(0).cast("long")) if from_zero else low
            reach = F.sequence(low, F.floor((F.col(a) + halo) / side))
            df = df.withColumn(f"b{a}", F.explode(reach))
        else:
            df = df.withColumn(f"b{a}", F.floor(F.col(a) / side))
    return df


def map_bricks(df: DataFrame, keys: list[str], side: int, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
               halo: int = 0, from_zero: bool = False) -> DataFrame:
    """Applies ``fn`` to frames that hold one or more whole bricks.

    One shuffle by (keys, brick); rows reach ``fn`` sorted by keys, brick, x, y, z.
    """
    return map_placed(with_bricks(df, side, halo, from_zero), keys, fn, schema, COORDS)


def map_placed(placed: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame | Iterator[pd.DataFrame]], schema: str,
               order: list[str]) -> DataFrame:
    """The same for rows that already carry their brick in bx, by, bz; ``fn`` may give its result in several frames."""
    ship_package(placed.sparkSession)
    brick = [*keys, *[f"b{a}" for a in COORDS]]
    # A fixed count, because the tasks are bound by their work and not by the bytes that
    # adaptive coalescing looks at.
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(tasks, *brick).sortWithinPartitions(*brick, *order)

    def frames(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        made = fn(pdf)
        yield from [made] if isinstance(made, pd.DataFrame) else made

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            ids = batch[brick].to_numpy()
            # The last brick of a batch may go on in the next one, so it waits.
            cut = int(np.flatnonzero((ids != ids[-1]).any(axis=1)).max(initial=-1)) + 1
            if held and (cut > 0 or (held[-1][brick].to_numpy()[-1] != ids[0]).any()):
                yield from frames(pd.concat([*held, batch.iloc[:cut]], ignore_index=True))
                held = []
            elif cut > 0:
                yield from frames(batch.iloc[:cut].reset_index(drop=True))
            held.append(batch.iloc[cut:])
        if held:
            yield from frames(pd.concat(held, ignore_index=True))

    return placed.mapInPandas(run, schema)


def brick_slices(pdf: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    """Start and stop row of each brick of a frame."""
    brick = pdf[[*keys, *[f"b{a}" for a in COORDS]]].to_numpy()
    cuts = np.flatnonzero((brick[1:] != brick[:-1]).any(axis=1)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(pdf)]))


def brick_codes(pdf: pd.DataFrame, keys: list[str], side: int, halo: int, margin: int) -> tuple[np.ndarray, int]:
    """A rising integer per row such that a neighbour's code differs by a fixed step.

    ``margin`` empty layers around each brick keep steps from crossing into the
    next one. Returns the codes and the padded side.
    """
    brick = pdf[[*keys, *[f"b{a}" for a in COORDS]]].to_numpy()
    new = np.ones(len(pdf), dtype=bool)
    new[1:] = (brick[1:] != brick[:-1]).any(axis=1)
    code = np.cumsum(new, dtype=np.int64)
    wide = side + 2 * (halo + margin)
    for a in COORDS:
        code = code * wide + (pdf[a].to_numpy() - pdf[f"b{a}"].to_numpy() * side + halo + margin)
    return code, wide


def lookup(code: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) with code[j] = code[i] + step; codes are sorted and unique."""
    target = code + step
    pos = np.searchsorted(code, target)
    pos_safe = np.minimum(pos, len(code) - 1)
    hit = code[pos_safe] == target
    return np.flatnonzero(hit), pos_safe[hit]
