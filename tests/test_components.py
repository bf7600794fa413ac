import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from voxelweave.operators.components import components, number_components
from voxelweave.operators.confluence import confluent_instances, dilate
from voxelweave.operators.refine import refine

ROWS = "case_id bigint, x bigint, y bigint, z bigint, ref_id bigint"


def case_table(spark, n, shape):
    return spark.createDataFrame(
        [(i, *shape, 1.0, 1.0, 1.0) for i in range(n)],
        "case_id bigint, nx bigint, ny bigint, nz bigint, sx double, sy double, sz double",
    )


@pytest.mark.parametrize("conn", [6, 18, 26])
@pytest.mark.parametrize("side", [3, 64])
def test_components_equal_a_flood_fill(spark, conn, side):
    rng = np.random.default_rng(conn)
    masks = [rng.random((9, 10, 11)) < share for share in (0.08, 0.25, 0.5)]
    df = spark.createDataFrame([r for i, m in enumerate(masks) for r in brute.rows(m.astype(int), i)], ROWS)
    got = number_components(components(df, case_table(spark, 3, (9, 10, 11)), conn, side=side))
    found = {(r["case_id"], r["x"], r["y"], r["z"]): r["label"] for r in got.collect()}
    want = {tuple(r[:4]): r[4] for i, m in enumerate(masks) for r in brute.rows(brute.label(m, conn), i)}
    assert found == want


def test_a_long_snake_over_many_bricks_is_one_component(spark):
    """Needs several rounds of the contraction loop."""
    mask = np.zeros((13, 13, 3), dtype=int)
    for x in range(0, 13, 2):
        mask[x, :, 1] = 1
        if x + 1 < 13:
            mask[x + 1, 12 if (x // 2) % 2 == 0 else 0, 1] = 1
    df = spark.createDataFrame(brute.rows(mask), ROWS)
    got = components(df, None, 6, side=2)
    assert got.select("root").distinct().count() == 1


def test_unknown_connectivity_is_refused(spark):
    with pytest.raises(ValueError):
        components(spark.createDataFrame([(0, 0, 0, 0, 1)], ROWS), None, 8)


@pytest.mark.parametrize("side", [4, 64])
def test_confluence_equals_brute_force(spark, side):
    rng = np.random.default_rng(8)
    volumes = []
    for _ in range(4):
        v = np.zeros((10, 9, 11), dtype=int)
        for i in range(1, 9):
            at = [rng.integers(0, n - 1) for n in v.shape]
            v[tuple(slice(a, a + int(rng.integers(1, 3))) for a in at)] = i
        volumes.append(v)
    df = spark.createDataFrame([r for i, v in enumerate(volumes) for r in brute.rows(v, i)], ROWS)
    variants = [(t, c) for t in (0, 1, 2) for c in (6, 18, 26)]
    got = confluent_instances(df, case_table(spark, 4, (10, 9, 11)), variants, side)
    found = {(r["case_id"], r["tier"], r["conn"], r["ref_id"]) for r in got.collect()}
    want = {(i, t, c, k) for i, v in enumerate(volumes) for t, c in variants for k in brute.confluent(v, t, c)}
    assert found == want
    for i in range(4):
        ids = lambda t, c, i=i: {k for a, b, d, k in found if (a, b, d) == (i, t, c)}
        assert ids(0, 6) <= ids(0, 26) <= ids(1, 26)


@pytest.mark.parametrize("gap,joined", [(1, True), (2, True), (3, False)])
def test_tier_one_bridges_gaps_of_one_and_two(spark, gap, joined):
    df = spark.createDataFrame([(0, 1, 1, 1, 1), (0, 1, 1, 2 + gap, 2)], ROWS)
    got = confluent_instances(df, case_table(spark, 1, (8, 8, 8)), [(1, 6)])
    assert (got.count() == 2) is joined


def test_dilation_stops_at_the_grid(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 1)], ROWS)
    got = {tuple(r)[1:] for r in dilate(df, case_table(spark, 1, (1, 2, 5)), 2).collect()}
    assert got == {(0, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 2), (0, 1, 1)}


def test_refine_splits_drops_and_renumbers(spark):
    """Instance 4: parts of 3, 2 and 1 voxels; instance 9: one part of 2."""
    v = np.zeros((8, 8, 8), dtype=int)
    v[0, 0, 0:3] = 4
    v[4, 0, 0:2] = 4
    v[7, 7, 7] = 4
    v[2, 5, 5:7] = 9
    df = spark.createDataFrame(brute.rows(v), "case_id bigint, x bigint, y bigint, z bigint, inst bigint")
    cases = case_table(spark, 1, (8, 8, 8))
    whole = {(r["x"], r["y"], r["z"]): r["inst"] for r in refine(df, cases).collect()}
    assert whole[(0, 0, 0)] == 1 and whole[(2, 5, 5)] == 2 and whole[(4, 0, 0)] == 3 and whole[(7, 7, 7)] == 4
    some = {(r["x"], r["y"], r["z"]): r["inst"] for r in refine(df, cases, min_volume=1).collect()}
    assert (7, 7, 7) not in some and some[(4, 0, 1)] == 3 and len(some) == 7
    few = {(r["x"], r["y"], r["z"]): r["inst"] for r in refine(df, cases, min_volume=2).collect()}
    assert set(few.values()) == {1} and len(few) == 3


def test_refine_drops_everything_after_the_first_small_part(spark):
    """The largest part is too thin, so the whole instance goes, thick parts included."""
    v = np.zeros((8, 8, 8), dtype=int)
    v[0, 0, 0:8] = 1
    v[0, 1:3, 0:8] = 1
    v[4:6, 4:6, 4:6] = 1
    df = spark.createDataFrame(brute.rows(v), "case_id bigint, x bigint, y bigint, z bigint, inst bigint")
    assert refine(df, case_table(spark, 1, (8, 8, 8)), min_axis=2).count() == 0


def test_labels_do_not_depend_on_bricks_or_cases(spark):
    from voxelweave.operators.components import components

    line = spark.createDataFrame([(1, x, 0, 0) for x in range(60, 70)], "case_id long, x long, y long, z long")
    for nx in (64, 70):
        cases = spark.createDataFrame([(1, nx, 8, 8)], "case_id long, nx long, ny long, nz long")
        for side in (4, 64, 128):
            for given in (None, cases):
                assert components(line, given, 6, side=side).select("root").distinct().count() == 1


def test_positions_that_are_null_or_nan_end(spark):
    from voxelweave.operators.nearest import nearest_site

    points = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, None, 0.0, 0.0), (1, 3, float("nan"), 0.0, 0.0)],
                                   "case_id long, p long, px double, py double, pz double")
    sites = spark.createDataFrame([(1, 7, 9.0, 0.0, 0.0), (1, 8, None, 0.0, 0.0)], "case_id long, site long, sx double, sy double, sz double")
    assert [(r["p"], r["site"]) for r in nearest_site(points, sites, ["p"]).collect()] == [(1, 7)]


def test_names_of_many_lengths_pair(spark):
    from voxelweave.sources.catalog import pair_files

    names = ["c" * n for n in range(1, 301)]
    refs = spark.createDataFrame([(n,) for n in names[200:]], "case string")
    preds = spark.createDataFrame([("x" + names[-1],)], "file string")
    assert {r["status"] for r in pair_files(refs, preds, exact=False).collect()} == {"ok"}


@pytest.mark.parametrize("times, side", [(1, 4), (3, 4), (5, 64)])
def test_dilation_by_distance(spark, times, side):
    """Everything within a city-block distance, over brick faces and at the edge of the grid."""
    rng = np.random.default_rng(times)
    shape, marked = (11, 9, 13), [rng.random((11, 9, 13)) < 0.01 for _ in range(3)]
    rows = [(c, k, *map(int, at)) for c, v in enumerate(marked) for k, at in enumerate(np.argwhere(v))]
    df = spark.createDataFrame(rows, "case_id bigint, part bigint, x bigint, y bigint, z bigint").withColumn("part", F.col("part") % 2)
    got = {tuple(r) for r in dilate(df, case_table(spark, 3, shape), times, ("case_id", "part"), side).collect()}
    cells = np.argwhere(np.ones(shape, dtype=bool))
    want = set()
    for case, part, *at in {(r[0], r[1] % 2, *r[2:]) for r in rows}:
        near = cells[np.abs(cells - np.array(at)).sum(axis=1) <= times]
        want |= {(case, part, *map(int, c)) for c in near}
    assert got == want


def test_voxel_tables_are_not_broadcast_however_small_their_files(spark, tmp_path):
    from voxelweave.operators import targets
    from voxelweave.operators.components import adjacency, face_links

    def broadcasts(df):
        return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")

    spark.range(70_000).selectExpr("0L case_id", "id div 1600 x", "id div 40 % 40 y", "id % 40 z", "6L conn", "id piece").write.parquet(f"{tmp_path}/v")
    v = spark.read.parquet(f"{tmp_path}/v")
    assert broadcasts(adjacency(v, 18)) == 0
    assert broadcasts(face_links(v, ["case_id"], 8)) == 0


def test_the_points_of_a_nearest_search_are_not_broadcast(spark, tmp_path, monkeypatch):
    from voxelweave.operators import nearest

    spark.range(2).selectExpr("id case_id", "id site", "0d sx", "0d sy", "0d sz").write.parquet(f"{tmp_path}/sites")
    spark.range(2).selectExpr("id case_id").write.parquet(f"{tmp_path}/cases")
    # The plan takes a grid made of two rows to be two rows long.
    grid = spark.read.parquet(f"{tmp_path}/cases").selectExpr("case_id", "explode(sequence(1, 5000)) px", "0d py", "0d pz")
    seen, whole = [], nearest._whole
    monkeypatch.setattr(nearest, "_whole", lambda points, *rest: seen.append(points) or whole(points, *rest))
    found = nearest.nearest_site(grid, spark.read.parquet(f"{tmp_path}/sites"), ["px"])
    assert found.count() == 10_000
    plan = seen[0]._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in plan and "LeftSemi" in plan
