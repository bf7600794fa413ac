"""Boxes read from a table along the space-filling curve."""

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from voxelweave.sources import curve


def opened(path, ranges):
    """Row groups whose keys meet the ranges, and all row groups of the case."""
    hit = total = 0
    for file in Path(path).rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.names.index("cell_key")
        for i in range(meta.num_row_groups):
            stats = meta.row_group(i).column(at).statistics
            hit += any(stats.min <= b and a <= stats.max for a, b in ranges)
            total += 1
    return hit, total


def test_a_box_opens_few_row_groups(spark, tmp_path):
    size = 96
    df = spark.range(size**3).selectExpr("7L AS case_id", f"id div {size * size} AS x", f"(id div {size}) % {size} AS y", f"id % {size} AS z", "id AS v")
    curve.write(df, str(tmp_path / "c"), 4, 8, 1 << 14)
    low, high = (30, 41, 50), (44, 60, 61)
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    got = curve.scan_box(spark, str(tmp_path / "c"), 7, low, high, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    want = {(x * size + y) * size + z for x in range(30, 45) for y in range(41, 61) for z in range(50, 62)}
    assert {r["v"] for r in got.collect()} == want and got.columns == ["case_id", "x", "y", "z", "v"]
    hit, total = opened(tmp_path / "c", curve.key_ranges(low, high))
    assert total > 60 and hit < 0.1 * total
    assert "GreaterThanOrEqual(cell_key" in plan.split("PushedFilters: [")[1] and "case_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("most", [1, 8, 64, 10_000])
def test_ranges_hold_every_cell_of_the_box(most):
    rng = np.random.default_rng(most)
    for _ in range(20):
        a = rng.integers(0, 300, 3)
        b = a + rng.integers(0, 120, 3)
        ranges = curve.key_ranges(tuple(map(int, a)), tuple(map(int, b)), most)
        assert all(p[1] < q[0] - 1 for p, q in zip(ranges, ranges[1:])) and len(ranges) <= max(most, 1) + 7
        cells = [np.arange(lo >> 3, (hi >> 3) + 1) for lo, hi in zip(a, b)]
        for cell in [(x, y, z) for x in cells[0][::3] for y in cells[1][::3] for z in cells[2][::3]]:
            key = sum(((int(c) >> i) & 1) << (3 * i + 2 - p) for p, c in enumerate(cell) for i in range(curve.LEVELS))
            assert any(lo <= key <= hi for lo, hi in ranges)
    assert curve.key_ranges((5, 5, 5), (4, 9, 9)) == [] and len(curve.key_ranges((0, 0, 0), (2**20 - 1,) * 3)) == 1
