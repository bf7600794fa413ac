"""Voxel tables along a space-filling curve, for reading boxes of large cases.

A file sorted by position in scan order spreads a box over nearly all row groups
of its case. Here rows are ordered by the Z-order key of their cell, so a box is a
few ranges of keys, and the row groups' least and largest keys let the scan skip
the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.operators.overlap import COORDS
from voxelweave.schema import AXIS_BITS
from voxelweave.sources.voxels import BUCKETS, bucket

CELL_BITS = 3  # a cell is 8 voxels wide
LEVELS = AXIS_BITS - CELL_BITS
MOST_RANGES = 64


def cell_key() -> Column:
    """The bits of a voxel's cell indices in turn, x first."""
    terms = []
    for place, a in enumerate(COORDS):
        for i in range(LEVELS):
            bit = F.shiftright(F.col(a).cast("long"), CELL_BITS + i).bitwiseAND(1)
            terms.append(F.shiftleft(bit, 3 * i + 2 - place))
    return reduce(lambda p, q: p.bitwiseOR(q), terms)


def write(df: DataFrame, path: str, buckets: int = BUCKETS, tasks: int | None = None, group_bytes: int | None = None) -> None:
    """Voxels by case bucket, in ranges of case and cell key; a large case lies in many files.

    ``group_bytes`` is the size of a row group.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumns({"case_bucket": bucket(buckets), "cell_key": cell_key()})
    order = ["case_bucket", "case_id", "cell_key"]
    writer = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order, *COORDS).write.mode("overwrite")
    if group_bytes:
        writer = writer.option("parquet.block.size", str(group_bytes))
    writer.partitionBy("case_bucket").parquet(path)


def key_ranges(low: tuple[int, int, int], high: tuple[int, int, int], most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of cell keys, both ends inside, that hold all cells of a box (``high`` is inside).

    Cubes of cells are split as long as fewer than ``most`` ranges come out; cubes on
    the rim that are left whole hold some cells more.
    """
    if any(a > b or b < 0 for a, b in zip(low, high)):
        return []
    low, high = ([max(0, v >> CELL_BITS) for v in p] for p in (low, high))
    done: list[tuple[int, int]] = []
    todo = [(LEVELS, (0, 0, 0))]
    while todo:
        size, corner = todo.pop(0)  # largest cubes first
        if any(c > b or c + (1 << size) <= a for c, a, b in zip(corner, low, high)):
            continue
        inside = all(a <= c and c + (1 << size) - 1 <= b for c, a, b in zip(corner, low, high))
        if inside or not size or len(done) + len(todo) >= most:
            key = sum(((c >> i) & 1) << (3 * i + 2 - place) for place, c in enumerate(corner) for i in range(LEVELS))
            done.append((key, key + (1 << 3 * size) - 1))
            continue
        half = 1 << (size - 1)
        todo += [(size - 1, (corner[0] + i * half, corner[1] + j * half, corner[2] + k * half)) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    joined: list[tuple[int, int]] = []
    for a, b in sorted(done):
        if joined and a <= joined[-1][1] + 1:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def scan_box(spark: SparkSession, path: str, case_id: int, low: tuple[int, int, int], high: tuple[int, int, int], buckets: int = BUCKETS) -> DataFrame:
    """The voxels of a case in a box (``high`` is inside); row groups outside its key ranges are skipped."""
    number = spark.range(1).select(F.lit(case_id).cast("long").alias("case_id")).select(bucket(buckets)).first()[0]
    rows = spark.read.parquet(path).filter((F.col("case_bucket") == number) & (F.col("case_id") == case_id))
    near = reduce(lambda p, q: p | q, [F.col("cell_key").between(a, b) for a, b in key_ranges(low, high)], F.lit(False))
    for a, lo, hi in zip(COORDS, low, high):
        rows = rows.filter(F.col(a).between(lo, hi))
    return rows.filter(near).drop("case_bucket", "cell_key")
