import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from voxelweave.operators import metrics, overlap, sizes
from voxelweave.plans import evaluate as ev
from voxelweave.plans.evaluate import evaluate

VOX = "case_id bigint, x bigint, y bigint, z bigint, ref_id bigint, pred_id bigint"


def cases(spark, n, size=8, spacing=(1.0, 1.0, 1.0)):
    rows = [(i, size, size, size, *spacing, i % 5) for i in range(n)]
    return spark.createDataFrame(rows, "case_id bigint, nx bigint, ny bigint, nz bigint, sx double, sy double, sz double, fold bigint")


def voxels(spark, volumes):
    """volumes: list of (pred, ref) arrays, one per case."""
    rows = []
    for case, (pred, ref) in enumerate(volumes):
        for at in zip(*np.nonzero((pred > 0) | (ref > 0))):
            rows.append((case, *map(int, at), int(ref[at]), int(pred[at])))
    return spark.createDataFrame(rows, VOX)


def empty():
    return np.zeros((8, 8, 8), dtype=int)


def block(volume, value, *ranges):
    volume[tuple(slice(a, b) for a, b in ranges)] = value
    return volume


def test_empty_sides_have_their_defined_scores(spark):
    full = block(empty(), 1, (0, 4), (0, 4), (0, 4))
    df = voxels(spark, [(full, full), (full, empty()), (empty(), full)])
    got = {r["case_id"]: r for r in evaluate(df, cases(spark, 4)).metrics.collect()}
    assert got[0]["PQ"] == got[0]["DSC"] == got[0]["nDSC"] == 1.0 and got[0]["TP"] == 1
    assert got[1]["PQ"] == 0.0 and got[1]["FP"] == 1 and got[1]["Recall"] == 1.0
    assert got[2]["PQ"] == 0.0 and got[2]["FN"] == 1 and got[2]["Precision"] == 1.0
    both_empty = got[3]
    assert both_empty["PQ"] == both_empty["DSC"] == both_empty["nDSC"] == both_empty["Recall"] == both_empty["Precision"] == 1.0
    assert both_empty["F1"] == 0.0 and both_empty["Dice_Per_TP"] == 0 and both_empty["Dice_Per_TP_CLU"] is None
    assert both_empty["Recall_CLU"] == both_empty["Precision_CLU"] == both_empty["PQ_CLU"] == 1.0


def test_iou_of_exactly_the_threshold_does_not_match(spark):
    ref, pred = empty(), empty()
    block(ref, 1, (0, 1), (0, 1), (0, 8))          # 8 voxels
    block(pred, 1, (0, 1), (0, 1), (7, 8))         # 1 shared
    block(pred, 1, (1, 2), (0, 2), (0, 1))         # 2 more: union 10
    table = overlap.contingency(voxels(spark, [(pred, ref)]))
    assert overlap.overlap_pairs(table).first()["iou"] == pytest.approx(0.1)
    assert overlap.match(table).count() == 0


def test_a_pred_that_loses_its_ref_gets_no_second_choice(spark):
    ref, pred = empty(), empty()
    block(ref, 1, (0, 2), (0, 2), (0, 4))
    block(ref, 2, (0, 2), (0, 2), (4, 6))
    block(pred, 5, (0, 2), (0, 2), (0, 3))         # best on ref 1
    block(pred, 9, (0, 2), (0, 2), (3, 4))         # touches only ref 1, less
    df = overlap.match(overlap.contingency(voxels(spark, [(pred, ref)])))
    got = {r["pred_id"]: (r["ref_id"], r["kept"]) for r in df.collect()}
    assert got == {5: (1, True), 9: (1, False)}


def test_ties_go_to_the_smallest_id(spark):
    ref, pred = empty(), empty()
    block(ref, 3, (0, 1), (0, 1), (0, 2))
    block(ref, 7, (0, 1), (0, 1), (2, 4))
    block(pred, 4, (0, 1), (0, 1), (0, 4))
    assert overlap.match(overlap.contingency(voxels(spark, [(pred, ref)]))).first()["ref_id"] == 3
    got = overlap.match(overlap.contingency(voxels(spark, [(ref, pred)]))).filter("kept").first()
    assert got["pred_id"] == 3


def test_matching_equals_the_loop_rule_on_random_volumes(spark):
    rng = np.random.default_rng(5)
    volumes = []
    for _ in range(30):
        ref = rng.integers(0, 4, (3, 3, 3)).repeat(2, 0).repeat(2, 1).repeat(2, 2)
        pred = np.roll(ref * rng.integers(0, 2, ref.shape), int(rng.integers(0, 2)), int(rng.integers(0, 3)))
        volumes.append((pred, ref))
    df = overlap.match(overlap.contingency(voxels(spark, volumes)))
    got = {(r["case_id"], r["pred_id"]): (r["ref_id"], round(r["iou"], 12), r["kept"]) for r in df.collect()}
    want = {}
    for case, (pred, ref) in enumerate(volumes):
        kept, removed = brute.match(pred, ref)
        want |= {(case, p): (r, round(i, 12), True) for p, (r, i) in kept.items()}
        want |= {(case, p): (r, round(i, 12), False) for p, (r, i) in removed.items()}
    assert got == want


def test_size_limits(spark):
    ref = empty()
    block(ref, 1, (0, 3), (0, 3), (0, 3))           # 27 mm3, extents of exactly 3: kept
    block(ref, 2, (4, 6), (0, 4), (0, 4))           # extent 2: removed
    ref[5, 5:8, 5:8] = 3
    ref[6:8, 5, 5:8] = 3                            # 15 voxels, extents of 3: kept
    df = voxels(spark, [(empty(), ref)])
    left = sizes.remove_small_instances(df, cases(spark, 1)).filter("ref_id > 0").select("ref_id").distinct()
    assert {r[0] for r in left.collect()} == {1, 3}
    limit = sizes.remove_small_instances(df, cases(spark, 1), min_volume=15, min_axis=3).filter("ref_id > 0")
    assert {r[0] for r in limit.select("ref_id").distinct().collect()} == {1}
    assert sizes.remove_small_instances(df, cases(spark, 1), min_volume=0, min_axis=0) is df


def test_absent_id_counts_as_too_small(spark):
    df = voxels(spark, [(empty(), block(empty(), 1, (0, 4), (0, 4), (0, 4)))])
    verdicts = sizes.size_verdicts(overlap.instances(overlap.contingency(df), "ref_id"), cases(spark, 1))
    ids = spark.createDataFrame([(0, 1), (0, 2)], "case_id bigint, ref_id bigint")
    got = {r["ref_id"]: r["too_small"] for r in sizes.verdict_of_ids(ids, verdicts, "ref_id").collect()}
    assert got == {1: False, 2: True}


def test_other_attributes_are_cleared_with_removed_instances(spark):
    ref = block(empty(), 2, (0, 1), (0, 1), (0, 1))
    df = voxels(spark, [(empty(), ref)]).withColumn("seg", F.lit(1).cast("long"))
    assert sizes.remove_small_instances(df, cases(spark, 1), also_clear=("seg",)).first()["seg"] == 0


def test_count_identities_hold_and_scores_stay_in_range(spark):
    rng = np.random.default_rng(1)
    volumes = [(rng.integers(0, 3, (8, 8, 8)), rng.integers(0, 3, (8, 8, 8))) for _ in range(3)]
    df = voxels(spark, volumes)
    table = overlap.contingency(df)
    counts = metrics.case_table(cases(spark, 3), table, overlap.match(table))
    assert metrics.count_violations(counts).count() == 0
    swapped = df.select("case_id", "x", "y", "z", F.col("pred_id").alias("ref_id"), F.col("ref_id").alias("pred_id"))
    other = overlap.contingency(swapped)
    a = metrics.score(counts, ["DSC", "PQ"]).orderBy("case_id").collect()
    b = metrics.score(metrics.case_table(cases(spark, 3), other, overlap.match(other)), ["DSC"]).orderBy("case_id").collect()
    assert [r["DSC"] for r in a] == [r["DSC"] for r in b] and all(0 <= r["PQ"] <= 1 for r in a)


def test_a_user_metric_joins_the_others(spark):
    metrics.register_metric("FN_share", lambda: F.col("FN") / (F.col("n_ref_inst") + 1))
    try:
        df = voxels(spark, [(empty(), block(empty(), 1, (0, 4), (0, 4), (0, 4)))])
        table = overlap.contingency(df)
        row = metrics.score(metrics.case_table(cases(spark, 1), table, overlap.match(table))).first()
        assert row["FN_share"] == 0.5
    finally:
        del metrics.EXPRESSIONS["FN_share"]


def test_a_missing_fold_value_makes_the_model_summary_null(spark):
    folds = spark.createDataFrame([("m", 0, 1.0, 2), ("m", 1, None, 3)], "model string, fold int, PQ double, TP int")
    row = metrics.across_folds(folds, ["model"], ["PQ"], ["TP"]).first()
    assert row["PQ"] is None and row["PQ_std"] is None and row["TP"] == 5


def test_voxels_without_case_or_outside_the_grid_stop_the_evaluation(spark):
    for row, fault in (((2, 0, 0, 0, 1, 1), "no case"), ((1, 0, 8, 0, 1, 1), "outside")):
        with pytest.raises(ValueError, match=fault):
            evaluate(spark.createDataFrame([row], VOX), cases(spark, 2))


def test_variants_share_their_references(spark):
    """Several models at once give what each gives alone, also for large ids and for cases without predictions."""
    rng = np.random.default_rng(8)
    volumes = []
    for i in range(4):
        ref = np.zeros((12, 10, 8), dtype=np.int64)
        for k in range(1, 5):
            x, y, z = (int(rng.integers(0, n - 3)) for n in ref.shape)
            ref[x:x + 4, y:y + 4, z:z + (2 if k == 4 else 4)] = k
        volumes.append(ref)
    far = 2**62
    shift = lambda df: df.withColumn("case_id", F.when(F.col("case_id") == 3, far).otherwise(F.col("case_id")))
    table = shift(cases(spark, 4, 12))
    models = {"a": [np.roll(v, 1, 0) for v in volumes], "b": [np.where(v % 2, v, 0) for v in volumes], "none": [v * 0 for v in volumes]}
    refs = shift(voxels(spark, [(v, v) for v in volumes])).select("case_id", "x", "y", "z", "ref_id")
    parts = [shift(voxels(spark, list(zip(preds, volumes)))).select("case_id", "x", "y", "z", "pred_id").withColumn("model", F.lit(m))
             for m, preds in models.items()]
    together = ev.evaluate_variants(parts[0].unionByName(parts[1]).unionByName(parts[2]), refs, table, by=("model",))
    for m, preds in models.items():
        alone = ev.evaluate(shift(voxels(spark, list(zip(preds, volumes)))), table)
        for name in ("metrics", "pred_matches", "ref_matches", "matches"):
            got = getattr(together, name).filter(F.col("model") == m).drop("model")
            want = getattr(alone, name)
            key = lambda r: repr([round(x, 9) if isinstance(x, float) else x for x in r])
            assert sorted(map(key, got.select(*want.columns).collect())) == sorted(map(key, want.collect())), (m, name)


def test_python_metrics_over_bricks(spark):
    """A median distance keeps its values in a histogram; parts, bricks and absent cases change nothing."""
    from voxelweave.operators import custom

    metric = custom.PythonMetric(
        "middle", tuple([0.0] * 64), lambda at: np.bincount(at["x"][at["ref_id"] > 0], minlength=64).astype(float),
        lambda v, case: None if v.sum() == 0 else float(np.searchsorted(np.cumsum(v), v.sum() / 2)) / case["nx"])
    custom.register(metric)
    rng = np.random.default_rng(3)
    volumes = [(rng.random((40, 6, 5)) < 0.3).astype(int) for _ in range(3)]
    df = voxels(spark, [(v, v) for v in volumes])
    table = cases(spark, 4, 40)
    for side in (4, 64):
        got = {r["case_id"]: r["middle"] for r in custom.score(df, table, ["middle"], side=side).collect()}
        want = {}
        for i, v in enumerate(volumes):
            at = np.bincount(np.nonzero(v)[0], minlength=64)
            want[i] = float(np.searchsorted(np.cumsum(at), at.sum() / 2)) / 40
        assert got == want | {3: None}
    del custom.METRICS["middle"]


def test_python_metrics_call_python_for_batches_and_not_for_groups(spark, capsys):
    from voxelweave.operators import custom

    rows = spark.createDataFrame([(c, x, 0, 0, 1, x % 2) for c in range(40) for x in range(8)], VOX)
    table = spark.createDataFrame([(c, 8, 1, 1) for c in range(41)], "case_id long, nx long, ny long, nz long")
    add = lambda part: np.array([float(part["pred_id"].sum())])
    custom.register(custom.PythonMetric("total", (0.0,), add, lambda v, case: v[0]))
    try:
        got = custom.score(rows, table, ["total"], side=2)
        assert {r["case_id"]: r["total"] for r in got.collect()} == {c: 4.0 if c < 40 else 0.0 for c in range(41)}
        got.explain()
        assert "FlatMapGroupsInPandas" not in capsys.readouterr().out
    finally:
        del custom.METRICS["total"]
