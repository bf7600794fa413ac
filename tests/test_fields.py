"""Nearest sites, stencils, resampling and draws against dense NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from voxelweave.functions import draws
from voxelweave.operators import augment, centres, geometry, intensity, resample, stencil, windows
from voxelweave.operators.nearest import nearest_site
from voxelweave.operators.ranking import rank_in_group
from voxelweave.plans import postprocess as pp

AT = "case_id bigint, x bigint, y bigint, z bigint"


def sizes(spark, shape, n=1):
    return spark.createDataFrame([(i, *shape, 1.0, 1.0, 1.0) for i in range(n)],
                                 "case_id bigint, nx bigint, ny bigint, nz bigint, sx double, sy double, sz double")


def dense(spark, volume, name, case=0):
    return spark.createDataFrame([(case, *map(int, at), float(v)) for at, v in np.ndenumerate(volume)], f"{AT}, {name} double")


@pytest.mark.parametrize("crowd", [3, 250_000])
def test_nearest_site_is_exact_near_and_far(spark, crowd):
    rng = np.random.default_rng(3)
    points = rng.integers(0, 200, (300, 3)) / 2.0
    where = np.unique(rng.integers(0, 30, (40, 3)), axis=0)
    p = spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(points)], "case_id bigint, k bigint, px double, py double, pz double")
    p = p.unionByName(p.withColumn("case_id", F.lit(7).cast("long")))
    s = spark.createDataFrame([(0, i + 1, *map(int, v)) for i, v in enumerate(where)], "case_id bigint, site bigint, sx bigint, sy bigint, sz bigint")
    got = {r["k"]: (r["site"], r["d2"]) for r in nearest_site(p, s, ["k"], radius=2, crowd=crowd).collect()}
    d2 = ((points[:, None, :] - where[None, :, :]) ** 2).sum(-1)
    assert got == {i: (int(d.argmin()) + 1, d.min()) for i, d in enumerate(d2)}


def test_spread_labels_takes_the_first_of_equally_near_voxels(spark):
    rng = np.random.default_rng(4)
    v = (rng.random((12, 12, 12)) < 0.01).astype(int) * rng.integers(1, 9, (12, 12, 12))
    v[0, 0, 0] = 3
    known = spark.createDataFrame(brute.rows(v), f"{AT}, inst bigint")
    todo = [(0, *map(int, at)) for at in zip(*np.nonzero(v == 0))]
    got = {tuple(r)[1:4]: r["inst"] for r in centres.spread_labels(spark.createDataFrame(todo, AT), known, "inst", radius=2, side=5).collect()}
    where = np.argwhere(v > 0)
    want = {t[1:]: int(v[tuple(where[((where - np.array(t[1:])) ** 2).sum(1).argmin()])]) for t in todo}
    assert got == want


def test_voxels_far_from_a_large_label_take_its_surface(spark):
    """Points 13 to 17 voxels off a full cube of 48, a second label at the other end, and a case of its own far away."""
    cube = spark.range(48 ** 3).selectExpr("0L AS case_id", "20 + id div 2304 AS x", "20 + id div 48 % 48 AS y", "20 + id % 48 AS z", "5L AS inst")
    known = cube.unionByName(spark.createDataFrame([(0, 300, 40, 40, 6), (3, 5, 5, 5, 7)], f"{AT}, inst bigint"))
    rng = np.random.default_rng(8)
    todo = {(0, int(67 + rng.integers(13, 18)), int(y), int(z)) for y, z in rng.integers(0, 90, (500, 2))} | {(0, 250, 40, 40), (3, 900, 700, 5)}
    got = centres.spread_labels(spark.createDataFrame(sorted(todo), AT), known, "inst").collect()
    assert {tuple(r)[:4]: r["inst"] for r in got} == {t: 7 if t[0] == 3 else 6 if t[1] == 250 else 5 for t in todo}


def test_far_search_at_huge_and_infinite_positions(spark):
    points = [(0, 1, 1e12, 0.0, 0.0), (0, 2, -1e12, 3.0, 0.0), (0, 3, float("inf"), 0.0, 0.0), (0, 4, 500.0, 0.0, 0.0), (1, 5, 0.0, 0.0, 0.0)]
    p = spark.createDataFrame(points, "case_id bigint, k bigint, px double, py double, pz double")
    s = spark.createDataFrame([(0, 2, 90, 0, 0), (0, 1, 90, 1, 0), (0, 9, -70, 0, 0), (0, 4, 910, 0, 0)], "case_id bigint, site bigint, sx bigint, sy bigint, sz bigint")
    got = {r["k"]: r["site"] for r in nearest_site(p, s, ["k"]).collect()}
    assert got == {1: 4, 2: 9, 4: 2}


@pytest.mark.parametrize("side", [4, 64])
def test_smoothing_and_hessian_equal_the_dense_result(spark, side):
    rng = np.random.default_rng(2)
    volume = rng.random((9, 8, 10))
    df = dense(spark, volume, "v")
    taps = [stencil.gaussian_taps(1.0)] * 3
    smooth = stencil.smooth_block(volume, taps)
    got = stencil.gaussian(df, "v", 1.0, side=side).collect()
    assert max(abs(r["smooth"] - smooth[r["x"], r["y"], r["z"]]) for r in got) < 1e-12 and len(got) == volume.size
    first = np.gradient(smooth)
    rows = stencil.hessian(df, "v", sizes(spark, volume.shape), side=side).collect()
    for name, a, b in (("hxx", 0, 0), ("hyz", 1, 2), ("hxz", 0, 2)):
        want = np.gradient(first[a], axis=b)
        assert max(abs(r[name] - want[r["x"], r["y"], r["z"]]) for r in rows) < 1e-12


def test_negative_definite_equals_the_eigenvalue_rule(spark):
    rng = np.random.default_rng(6)
    rows, want = [], []
    for _ in range(200):
        m = rng.normal(size=(3, 3))
        m = m + m.T - 2 * np.eye(3)
        rows.append(tuple(float(m[i, j]) for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))))
        want.append(bool((np.linalg.eigvalsh(m) < 0).all()))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, hxx double, hyy double, hzz double, hxy double, hxz double, hyz double")
    got = [r[0] for r in df.orderBy("i").select(stencil.negative_definite()).collect()]
    assert got == want and any(want) and not all(want)


@pytest.mark.parametrize("kernel", [3, 5])
def test_local_maxima_keep_plateaus_and_obey_the_strict_threshold(spark, kernel):
    rng = np.random.default_rng(kernel)
    v = rng.integers(0, 11, (9, 9, 9)) / 10.0
    got = {tuple(r)[1:4] for r in stencil.local_maxima(dense(spark, v, "heat"), kernel=kernel, side=4).collect()}
    h = kernel // 2
    padded = np.pad(v, h, constant_values=-1)
    want = {at for at, value in np.ndenumerate(v)
            if value > 0.1 and value == padded[tuple(slice(c, c + kernel) for c in at)].max()}
    assert got == want


def test_top_k_keeps_ties_and_short_lists(spark):
    df = spark.createDataFrame([(0, i, 0, 0, h) for i, h in enumerate([0.9, 0.5, 0.5, 0.4])] + [(1, 0, 0, 0, 0.2)], f"{AT}, heat double")
    got = centres.top_k(df, 2).groupBy("case_id").count().orderBy("case_id").collect()
    assert [r["count"] for r in got] == [3, 1] and centres.top_k(df, None) is df


def test_no_centre_gives_no_instance(spark):
    df = spark.createDataFrame([(0, 1, 1, 1, 0.9, 0.05, 0.0, 0.0, 0.0)], f"{AT}, proba double, heat double, ox double, oy double, oz double")
    assert pp.by_offsets(df, sizes(spark, (4, 4, 4))).count() == 0


def test_ridges_fall_back_to_components_without_a_cluster(spark):
    df = spark.createDataFrame([(0, 0, 0, z, 0.9) for z in range(2)], f"{AT}, proba double")
    got = pp.by_ridges(df, sizes(spark, (2, 2, 2))).collect()
    assert len(got) == 2 and {r["inst"] for r in got} == {1}


def test_nearest_and_linear_resampling_equal_the_dense_rule(spark):
    rng = np.random.default_rng(9)
    v = rng.random((7, 5, 6))
    target = (10, 3, 6)
    df = dense(spark, v, "v").join(sizes(spark, v.shape).select("case_id", "nx", "ny", "nz"), "case_id").withColumns(
        {f"t{a}": F.lit(t).cast("long") for a, t in zip("xyz", target)})
    near = {tuple(r[c] for c in "xyz"): r["v"] for r in resample.nearest(df).collect()}
    lin = {tuple(r[c] for c in "xyz"): r["v"] for r in resample.linear(df, ["v"]).collect()}
    assert len(near) == len(lin) == 180
    for at in np.ndindex(*target):
        src = [(t + 0.5) * n / m for t, n, m in zip(at, v.shape, target)]
        assert near[at] == v[tuple(int(s) for s in src)]
        pos = [min(max(s - 0.5, 0), n - 1) for s, n in zip(src, v.shape)]
        low = [min(int(p), n - 2) for p, n in zip(pos, v.shape)]
        want = sum(
            v[tuple(l + c for l, c in zip(low, corner))] * np.prod([1 - abs(p - l - c) for p, l, c in zip(pos, low, corner)])
            for corner in np.ndindex(2, 2, 2))
        assert lin[at] == pytest.approx(want)


def test_holes_are_inside_and_the_outside_is_minus_one(spark):
    v = np.zeros((7, 7, 7))
    v[1:6, 1:6, 1:6] = 1
    v[3, 3, 3] = 0          # enclosed
    v[1, 1, 1] = 0          # a corner, open to the border
    df = dense(spark, v, "img").withColumn("seg", F.lit(0).cast("long"))
    cut, box = geometry.crop_to_nonzero(df, ["img"], sizes(spark, v.shape), side=3)
    seg = {tuple(r[c] for c in "xyz"): r["seg"] for r in cut.collect()}
    assert len(seg) == 125 and seg[(2, 2, 2)] == 0 and seg[(0, 0, 0)] == -1
    assert box.first()["lo_x"] == 1 and box.first()["hi_z"] == 5


def test_exact_percentiles(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([np.full(500, 3.0), rng.normal(size=700)])
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 2.5)], "g string, v double")
    got = {(r["g"], r["at"]): r["percentile"] for r in intensity.exact_percentiles(df, ["g"], "v", [0.005, 0.5, 0.995], 64).collect()}
    for q in (0.005, 0.5, 0.995):
        assert got[("a", q)] == pytest.approx(np.quantile(values, q))
        assert got[("b", q)] == 2.5


def test_ranks_do_not_depend_on_the_buckets(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "(id * 7919) % 1009 AS v")
    fine = rank_in_group(df, ["g"], [F.col("v")], [F.floor(F.col("v") / 10)], "r")
    whole = rank_in_group(df, ["g"], [F.col("v")], [F.lit(0)], "r")
    assert fine.exceptAll(whole).isEmpty() and fine.agg(F.max("r")).first()[0] == 334


def test_draws_are_even_and_independent_of_partitioning(spark):
    df = spark.range(20000).select("id", draws.uniform(1, "id").alias("u"), draws.normal(1, "id").alias("n"))
    row = df.agg(F.avg("u"), F.stddev("u"), F.avg("n"), F.stddev("n"), F.countDistinct("u")).first()
    assert abs(row[0] - 0.5) < 0.01 and abs(row[1] - 12 ** -0.5) < 0.01 and abs(row[2]) < 0.03 and abs(row[3] - 1) < 0.03
    assert row[4] > 19900
    assert df.repartition(13).exceptAll(df).isEmpty()


def test_smoothing_by_case_uses_each_cases_deviations(spark):
    v = np.random.default_rng(1).random((6, 6, 6))
    df = dense(spark, v, "intensity", 0).unionByName(dense(spark, v, "intensity", 1))
    params = spark.createDataFrame([(0, True, 0.5, 0.7, 1.0), (1, False, 1.0, 1.0, 1.0)], "case_id bigint, on boolean, sx double, sy double, sz double")
    got = augment.smooth(df, params).collect()
    want = stencil.smooth_block(v, [stencil.gaussian_taps(s) for s in (0.5, 0.7, 1.0)])
    assert len(got) == 432
    for r in got:
        expected = want if r["case_id"] == 0 else v
        assert r["intensity"] == pytest.approx(expected[r["x"], r["y"], r["z"]])


def test_windows_cover_every_voxel_and_blend_to_the_constant(spark):
    v = np.full((7, 9, 5), 0.25)
    df = dense(spark, v, "p")
    tiled = windows.tile(df, sizes(spark, v.shape), (4, 4, 8))
    assert tiled.select("wx", "wy", "wz").distinct().count() == windows.number_of_windows(7, 4) * windows.number_of_windows(9, 4)
    out = windows.blend(tiled, ["p"], (4, 4, 8)).collect()
    assert len(out) == v.size and all(abs(r["p"] - 0.25) < 1e-12 for r in out)


def test_percentiles_leave_out_null_and_nan(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, float("nan"), None)], "g string, v double")
    assert intensity.exact_percentiles(df, ["g"], "v", [0.5]).first()["percentile"] == 2.0


def test_percentiles_with_outliers_and_ties(spark):
    values = [float(i % 500) for i in range(20_000)] + [1e300, -1e300, 7.0, 7.0]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    at = [0.0, 0.005, 0.5, 0.995, 1.0]
    got = {r["at"]: r["percentile"] for r in intensity.exact_percentiles(df, ["g"], "v", at).collect()}
    assert [got[a] for a in at] == pytest.approx(np.quantile(values, at).tolist())


def test_a_fence_that_holds_no_rank_is_dropped(spark, monkeypatch):
    monkeypatch.setattr(intensity, "FENCE", 0.0)
    monkeypatch.setattr(intensity, "SKETCH", 2)
    values = [float(i) ** 3 for i in range(999)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = {r["at"]: r["percentile"] for r in intensity.exact_percentiles(df, ["g"], "v", [0.1, 0.7003]).collect()}
    assert [got[0.1], got[0.7003]] == pytest.approx(np.quantile(values, [0.1, 0.7003]).tolist())


def test_scheme_needs_every_channel(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "case_id long, a double, b double")
    properties = spark.createDataFrame([("a", 1.0, 2.0, 0.0, 1.5)], "channel string, mean double, std double, percentile_00_5 double, percentile_99_5 double")
    out = intensity.scheme_normalise_columns(df, ["a"], properties).first()
    assert (out["a"], out["b"]) == (0.25, 3.0)
    with pytest.raises(ValueError):
        intensity.scheme_normalise_columns(df, ["a", "b"], properties)


def test_affine_over_bricks_shuffles_only_source_voxels(spark, capsys):
    """A turned, scaled and shifted volume, with bricks of 4 voxels and a map that cannot be turned round."""
    rng = np.random.default_rng(8)
    v = np.where(rng.random((9, 7, 6)) < 0.4, rng.integers(1, 9, (9, 7, 6)), 0)
    rows = [(c, *map(int, at), float(x), int(x)) for c in (0, 1) for at, x in np.ndenumerate(v) if x]
    df = spark.createDataFrame(rows, f"{AT}, v double, seg bigint")
    params = spark.createDataFrame([(0, 0.3, -0.2, 0.5, 0.2, 0.4), (1, 0.0, 0.0, 0.0, -1.0, 0.0)],
                                   "case_id bigint, rx double, ry double, rz double, zx double, tx double")
    matrix = augment.affine_matrix(params, sizes(spark, v.shape, 2))
    out = resample.affine(df, ["v"], ["seg"], matrix, side=4)
    got = {(r["case_id"], *(r[c] for c in "xyz")): (r["v"], r["seg"]) for r in out.collect()}
    assert len(got) == 2 * v.size
    middle = (np.array(v.shape) - 1) / 2
    read = lambda s: int(v[tuple(s)]) if (s >= 0).all() and (s < v.shape).all() else 0
    for m in matrix.collect():
        a = np.array([[m[f"a{i}{j}"] for j in (1, 2, 3)] for i in (1, 2, 3)])
        for at in np.ndindex(*v.shape):
            p = a @ (np.array(at) - middle) + [m["b1"], m["b2"], m["b3"]] + middle
            low = np.floor(p).astype(int)
            want = sum(np.prod(1 - np.abs(p - low - c)) * read(low + c) for c in np.ndindex(2, 2, 2))
            assert got[(m["case_id"], *at)][0] == pytest.approx(want, abs=1e-9)
            if np.abs(p % 1 - 0.5).min() > 1e-6:
                assert got[(m["case_id"], *at)][1] == read(np.floor(p + 0.5).astype(int))
    for shown in (resample.affine_linear(df, ["v"], matrix), resample.affine_nearest(df, ["seg"], matrix)):
        shown.explain()
    joins = [line for line in capsys.readouterr().out.splitlines() if "Join" in line]
    assert joins and all(line.count("#") == 2 and "case_id" in line for line in joins)  # by case, not by voxel


def test_holes_are_sought_among_the_zeros_of_the_box(spark, monkeypatch):
    v = np.zeros((7, 7, 7))
    v[1:6, 1:6, 1:6] = 1
    v[3, 3, 3] = v[1, 1, 1] = 0
    looked = []
    plain = geometry.components
    monkeypatch.setattr(geometry, "components", lambda df, *a, **k: (looked.append(df.count()), plain(df, *a, **k))[1])
    df = dense(spark, v, "img").withColumn("seg", F.lit(0).cast("long"))
    cut, _ = geometry.crop_to_nonzero(df, ["img"], sizes(spark, v.shape))
    assert {tuple(r[c] for c in "xyz") for r in cut.filter("seg = -1").collect()} == {(0, 0, 0)}
    assert looked == [2]


def small_files(spark, tmp_path):
    """Images of 8 x 8 x 8 voxels, made of two rows; the plan takes them to be two rows long."""
    spark.range(2).selectExpr("id case_id").write.parquet(f"{tmp_path}/cases")
    grid = spark.read.parquet(f"{tmp_path}/cases")
    for a in "xyz":
        grid = grid.selectExpr("*", f"explode(sequence(0L, 7L)) {a}")
    return grid.selectExpr("*", "double((x + 2 * y + z) % 5) img", "x % 2 seg")


def test_the_image_is_not_broadcast_to_be_cropped(spark, tmp_path):
    cut, box = geometry.crop_to_nonzero(small_files(spark, tmp_path), ["img"], sizes(spark, (8, 8, 8), 2))
    plan = cut._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in plan and plan.count("BuildRight") >= 3
    assert cut.count() == 1024 and box.count() == 2


def test_patch_centres_do_not_sort_the_voxels(spark, capsys):
    from voxelweave.operators import sampling

    df = spark.createDataFrame([(c, x, y, 3, int(x > 5)) for c in range(3) for x in range(9) for y in range(4)], f"{AT}, seg bigint")
    found = sampling.patch_centres(df, 11, samples=2)
    found.explain()
    rows = found.collect()
    assert len(rows) == 6 and all(r["z"] == 3 and r["fg"] == int(r["x"] > 5) for r in rows)
    assert capsys.readouterr().out.count(" HashAggregate(keys=[case_id") == 2  # the least draw of each class


def test_total_loss_reads_the_voxels_once(spark, capsys):
    from voxelweave.operators import losses

    df = spark.range(64).selectExpr("id % 2 AS case_id", "id / 64 AS l0", "id % 5 / 5 AS l1", "id % 3 % 2 AS g", "id % 7 / 7 AS heat", "0.5D AS heat_ref",
                                    *[f"id % 4 / 2 AS o{a}" for a in "xyz"], *[f"id % 9 / 9 AS o{a}_ref" for a in "xyz"], "id % 3 / 1 AS weight")
    for weighted, kind in ((True, "l1"), (False, "smooth_l1")):
        w = "weight" if weighted else None
        alone = losses.segmentation_loss(df, w).join(losses.heatmap_loss(df, w), "case_id").join(losses.offset_loss(df, kind, w), "case_id")
        both = losses.total_loss(df, weighted, kind=kind)
        want = {r["case_id"]: (*r[1:], r["segmentation"] + r["heatmap"] + r["offsets"]) for r in alone.collect()}
        assert {r["case_id"]: tuple(r[1:]) for r in both.collect()} == {c: pytest.approx(v) for c, v in want.items()}
        capsys.readouterr()
        both.explain()
        assert "Join" not in capsys.readouterr().out


def test_votes_are_counted_before_the_shuffle(spark, capsys):
    rng = np.random.default_rng(5)
    shapes = {0: (19, 9, 11), 1: (3, 30, 8)}
    rows = [(c, *map(int, at), *map(float, rng.integers(-9, 10, 3) / 2)) for c, shape in shapes.items() for at in np.ndindex(*shape)]
    rows += [(0, 18, 8, 10, 1e9, 0.0, -1e9), (7, 0, 0, 0, 0.0, 0.0, 0.0)]  # far outside; a case without a grid
    df = spark.createDataFrame(rows, f"{AT}, ox double, oy double, oz double")
    table = spark.createDataFrame([(c, *s) for c, s in shapes.items()], "case_id bigint, nx bigint, ny bigint, nz bigint")
    want = {}
    for c, *v in rows[:-1]:
        at = (c, *np.clip(np.rint(np.add(v[:3], v[3:])), 0, np.array(shapes[c]) - 1).astype(int).tolist())
        want[at] = want.get(at, 0) + 1
    found = centres.votes(df.repartition(3), table)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and {r[:4]: r[4] for r in got} == want
    found.explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" not in plan and "MapInArrow" in plan


def test_no_row_serves_a_brick_below_the_grid(spark):
    from voxelweave.operators import bricks

    rows = dense(spark, np.ones((7, 7, 7)), "v")
    assert bricks.with_bricks(rows, 4, 2, from_zero=True).filter("bx < 0 OR by < 0 OR bz < 0").count() == 0
    assert bricks.with_bricks(rows, 8, 2, from_zero=True).filter("bx <= 0 AND by <= 0 AND bz <= 0").count() == 7 ** 3
    for found in (stencil.gaussian(rows, "v"), stencil.hessian(rows, "v", sizes(spark, (7, 7, 7))), stencil.local_maxima(rows, "v")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("explode(sequence(greatest(") == 3


def test_centre_ids_find_the_maxima_once(spark, capsys):
    from voxelweave.queries import load_all

    load_all()[0]["centre_ids"](spark, "/root/testdata/sf0.001").explain()
    assert "MapInPandas" not in capsys.readouterr().out
