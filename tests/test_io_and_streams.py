import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from test_matching import block, cases, empty, voxels
from voxelweave import session
from voxelweave.operators import augment
from voxelweave.plans import dataset, evaluate as ev
from voxelweave.sources import catalog, descriptor, results, voxels as vx
from voxelweave.streaming import monitor


class _Named:
    """A session whose configuration names a checkpoint folder."""

    class conf:
        @staticmethod
        def get(name, default=None):
            return "hdfs://shared/cut/" if name == "spark.checkpoint.dir" else default


def test_the_sessions_checkpoint_folder_comes_first(spark):
    assert session.shared_dir(_Named) == "hdfs://shared/cut"
    assert session.shared_dir(spark) == session.shared_dir(spark)
    assert session.materialize(spark.range(3), "t").count() == 3


def test_catalog_descriptor_and_splits_from_files(spark, tmp_path):
    images = tmp_path / "imagesTr"
    images.mkdir()
    for name in ("a_b_0001.nii.gz", "a_b_0000.nii.gz", "c_0000.nii.gz", "notes.txt", "odd.nii.gz"):
        (images / name).write_bytes(b"x")
    files = catalog.list_files(spark, str(images), "*.nii.gz")
    got = {r["case"]: [p.rsplit("/", 1)[1] for p in r["files"]] for r in catalog.case_catalog(files).collect()}
    assert got == {"a_b": ["a_b_0000.nii.gz", "a_b_0001.nii.gz"], "c": ["c_0000.nii.gz"]}
    doc = tmp_path / "dataset.json"
    doc.write_text(json.dumps({"channel_names": {"0": "FLAIR"}, "numTraining": 2, "extra": 1,
                               "dataset": {"c": {"images": ["i0", "i1"], "label": "l"}}}, indent=1))
    read = descriptor.read_text_documents(spark, str(doc))
    row = descriptor.check_keys(read).first()
    assert row["missing"] == ["file_ending"] and row["unused"] == ["dataset", "extra"]
    assert descriptor.parse(read).first()["n_channels"] == 1
    assert {tuple(r) for r in descriptor.listed_files(read).collect()} == {("c", "image", "i0"), ("c", "image", "i1"), ("c", "label", "l")}
    splits = tmp_path / "splits.json"
    splits.write_text(json.dumps([{"train": ["a_b"], "val": ["c"]}, {"train": ["c"], "val": ["a_b"]}], indent=1))
    table = descriptor.read_splits(spark, str(splits))
    every = spark.createDataFrame([("a_b",), ("c",)], "case string")
    assert [r[0] for r in descriptor.select_cases(every, table, 1, "val", "case").collect()] == ["a_b"]
    assert descriptor.select_cases(every, table, "all", "val", "case").count() == 2


def test_substring_pairing_reports_several_files(spark):
    refs = spark.createDataFrame([("case_1",), ("case_10",), ("case_3",)], "case string")
    preds = spark.createDataFrame([("case_1_pred.nii.gz",), ("case_10_pred.nii.gz",)], "file string")
    pairs = catalog.pair_files(refs, preds, exact=False)
    assert {r["case"]: r["status"] for r in pairs.collect()} == {"case_1": "several", "case_10": "ok", "case_3": "missing"}
    with pytest.raises(ValueError, match="case_"):
        catalog.require_pairs(pairs)


def test_evaluation_sinks_read_back(spark, tmp_path):
    full = block(empty(), 1, (0, 4), (0, 4), (0, 4))
    result = ev.evaluate(voxels(spark, [(full, full), (empty(), full)]), cases(spark, 2))
    keys = cases(spark, 2).select("case_id", "fold").withColumn("model", F.lit("m"))
    results.save_evaluation(result, str(tmp_path), keys, ["model", "fold"])
    details = results.read(spark, str(tmp_path / "metrics_details"), fmt="json")
    assert details.count() == 2 and {"model", "fold", "PQ", "CLU_Count_tier_1_conn_26"} <= set(details.columns)
    csv = results.read(spark, str(tmp_path / "ref_matches_csv"), fmt="csv")
    assert csv.filter("FN = 'true'").count() == 1
    assert results.read(spark, str(tmp_path / "metrics_summary"), fmt="json").count() == 2


def test_narrow_types(spark):
    df = spark.createDataFrame([(1,), (127,)], "v bigint")
    assert dict(vx.narrow(df, "v").dtypes)["v"] == "tinyint"
    assert dict(vx.narrow(df.union(spark.createDataFrame([(128,)], "v bigint")), "v").dtypes)["v"] == "smallint"


def test_late_rows_are_dropped_and_windows_close(spark, tmp_path):
    start = datetime(2024, 1, 1)
    log = tmp_path / "log"
    schema = "ts timestamp, metric string, value double"

    def land(name, *minutes):
        rows = [(start + timedelta(minutes=m), "a", 1.0) for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(log))

    out, offsets = str(tmp_path / "out"), str(tmp_path / "offsets")

    def run():
        monitor.finish(monitor.windowed_summary, spark.readStream.schema(schema).parquet(str(log)), out, offsets, "1 hour")

    land("one", 5, 10, 130)
    run()
    land("two", 20, 200)            # 20 is behind the watermark of 120
    run()
    got = spark.read.parquet(out).groupBy("start_us").agg(F.sum("n")).orderBy("start_us").collect()
    assert [r[1] for r in got] == [2, 1]


def test_running_best_goes_on_after_a_restart(spark, tmp_path):
    log, out, offsets = (str(tmp_path / n) for n in ("log", "out", "offsets"))
    schema = "epoch bigint, postprocessor string, metric string, value double"
    for rows in ([(0, "CC", "PQ", 0.5), (1, "CC", "PQ", 0.7)], [(2, "CC", "PQ", 0.7), (3, "CC", "DSC", 0.1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
        monitor.finish(monitor.running_best, spark.readStream.schema(schema).parquet(log), out, offsets)
    got = {r["metric"]: (r["value"], r["epoch"]) for r in monitor.latest(spark, out, ["postprocessor", "metric"]).collect()}
    assert got == {"PQ": (0.7, 1), "DSC": (0.1, 3)}


def test_the_training_chain_repeats_itself(spark):
    full = block(empty(), 1, (1, 5), (1, 5), (1, 5))
    table = cases(spark, 2)
    grid = table
    for a in "xyz":
        grid = grid.withColumn(a, F.explode(F.expr(f"sequence(0L, n{a} - 1)")))
    ref = voxels(spark, [(empty(), full), (empty(), full)]).select("case_id", "x", "y", "z", "ref_id")
    df = grid.select("case_id", "x", "y", "z").join(ref, ["case_id", "x", "y", "z"], "left").fillna(0)
    df = df.withColumns({"seg": F.col("ref_id"), "intensity": (F.col("x") + F.col("y") * 0.1 + F.col("z") * 0.01).cast("double")})
    steps = dataset.train_steps(table, (6, 6, 6), 5)
    a = dataset.fold_dataset(df, table, None, "all", "train", steps, 1, seed=2)
    b = dataset.fold_dataset(df.repartition(7, "z"), table, None, "all", "train", steps, 1, seed=2)
    pick = ["case_id", "x", "y", "z", F.round("intensity", 9).alias("i"), F.round("ox", 9).alias("o"), "seg", "batch"]
    assert a.count() == 2 * 216 and a.select(*pick).exceptAll(b.select(*pick)).isEmpty()


def test_a_scan_of_some_cases_opens_their_buckets_only(spark, tmp_path):
    rows = spark.range(200).selectExpr("id AS case_id", "0L AS x", "0L AS y", "id AS z", "CAST(id AS DOUBLE) AS intensity")
    vx.write(rows, str(tmp_path / "b"), 16)
    some = spark.createDataFrame([(3,), (3,), (999,)], "case_id long")
    got = vx.scan(spark, str(tmp_path / "b"), some, 16)
    assert [r["intensity"] for r in got.collect()] == [3.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "case_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert vx.scan(spark, str(tmp_path / "b"), some.limit(0), 16).count() == 0


def test_each_case_gets_its_narrowest_type(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 127), (1, 1, 3), (2, 0, 128), (2, 1, 1), (3, 0, None)], "case_id long, x long, v long")
    vx.write_narrow(rows, str(tmp_path), "v")
    back = {(r["case_id"], r["x"]): (r["kind"], r["v"]) for r in vx.scan_narrow(spark, str(tmp_path), "v").collect()}
    assert back == {(1, 0): ("tinyint", 127), (1, 1): ("tinyint", 3), (2, 0): ("smallint", 128), (2, 1): ("smallint", 1), (3, 0): ("tinyint", None)}
    assert dict(spark.read.parquet(str(tmp_path / "kind=tinyint")).dtypes)["v"] == "tinyint"


def test_split_cases_are_listed(spark, tmp_path):
    for batch, cases in ((0, [1, 2]), (1, [2, 3])):
        spark.createDataFrame([(c,) for c in cases], "case_id long").write.parquet(str(tmp_path / f"batch={batch}"))
    assert [tuple(r) for r in monitor.split_cases(spark, str(tmp_path)).collect()] == [(2, 2)]


def test_chain_of_the_test_set(spark):
    cases = spark.createDataFrame([(1, 9, 9, 9, 1.0, 1.0, 1.0)], "case_id long, nx long, ny long, nz long, sx double, sy double, sz double")
    rows = spark.createDataFrame([(1, x, 0, 0, 5, 1) for x in range(2)], "case_id long, x long, y long, z long, ref_id long, seg long")
    assert dataset.test_steps(cases) == []
    left = dataset.chain(rows, dataset.test_steps(cases, with_reference=True))
    assert left.filter("ref_id > 0 OR seg > 0").count() == 0


def test_affine_leaves_cases_alone_that_draw_off(spark):
    params = spark.createDataFrame([(1, True, 1.0), (2, False, 1.0)], "case_id long, on boolean, tx double")
    cases = spark.createDataFrame([(c, 3, 1, 1) for c in (1, 2)], "case_id long, nx long, ny long, nz long")
    rows = spark.createDataFrame([(c, x, 0, 0, float(x), x) for c in (1, 2) for x in range(3)],
                                 "case_id long, x long, y long, z long, v double, seg long")
    out = augment.affine(rows, augment.affine_matrix(params, cases), ["v"], ["seg"])
    got = {(r["case_id"], r["x"]): (r["v"], r["seg"]) for r in out.collect()}
    assert got == {(1, 0): (1.0, 1), (1, 1): (2.0, 2), (1, 2): (0.0, 0), (2, 0): (0.0, 0), (2, 1): (1.0, 1), (2, 2): (2.0, 2)}


def test_a_case_in_pieces_is_scored_once(spark, tmp_path):
    """Pieces over batches and restarts; repeated counts and late rows change nothing; a timer ends the wait."""
    from voxelweave.streaming import pieces

    table = cases(spark, 3)
    full = [voxel for x in range(4, 9) for voxel in [(x, y, z) for y in range(4, 9) for z in range(4, 9)]]
    refs = spark.createDataFrame([(c, *v, 1) for c in range(3) for v in full], "case_id long, x long, y long, z long, ref_id long")
    landing, parts, out, one, two = (str(tmp_path / n) for n in ("landing", "parts", "out", "one", "two"))
    schema = "case_id long, x long, y long, z long, pred_id long, declared long, ts timestamp"

    def land(minute, rows):
        at = datetime(2024, 1, 1, minute // 60, minute % 60)
        spark.createDataFrame([(*r, at) for r in rows], schema).coalesce(1).write.mode("append").parquet(landing)

    def run():
        monitor.finish(pieces.count_arrivals, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing), refs, parts, one)
        monitor.finish(pieces.score_closed, pieces.arrived_pieces(spark, parts), refs, table, out, two, patience_ms=1_800_000, delay="1 minute")
        return {r["case_id"]: r for r in spark.read.parquet(out).collect()}

    land(0, [(0, *v, 7, 125) for v in full[:40]] + [(1, *v, 7, 25) for v in full[:25]])
    land(5, [(0, *v, 7, 125) for v in full[40:60]])
    got = run()
    assert set(got) == {1} and got[1]["complete"] and got[1]["TP"] == 1 and got[1]["pieces"] == 1
    # The second batch's counts again, as after a failure between the write and the commit.
    spark.read.schema(pieces.PIECES).parquet(f"{parts}/part=1").write.mode("append").parquet(f"{parts}/part=1")
    land(10, [(0, *v, 7, 125) for v in full[60:]] + [(2, *v, 7, 999) for v in full[:50]])
    got = run()
    assert set(got) == {0, 1} and got[0]["complete"] and got[0]["pieces"] == 3 and got[0]["DSC"] == 1.0 and got[0]["FP"] == got[0]["FN"] == 0
    land(15, [(0, 1, 1, 1, 9, 125)])  # late: the case is closed
    land(20, [(2, *v, 7, 999) for v in full[50:60]])
    assert set(run()) == {0, 1}
    land(90, [(1, 1, 1, 2, 9, 25)])  # the time goes on, and with it the wait for case 2 ends
    got = run()
    assert spark.read.parquet(out).count() == 3 and not got[2]["complete"] and got[2]["TP"] == 1 and 0 < got[2]["DSC"] < 1


def test_volumes_are_painted_without_shuffling_voxels(spark, monkeypatch):
    from voxelweave import fixtures as fx

    plans = {}
    monkeypatch.setattr(fx, "_written", {})
    monkeypatch.setattr(fx, "materialize", lambda df, label: plans.setdefault(label, df))
    for build in (fx.voxels, fx.dense):
        build(spark, "/root/testdata/sf0.001")
    for df in plans.values():
        # Only the customers travel, in a set number of partitions.
        exchanges = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
        assert len(exchanges) == 1 and "REPARTITION_BY_NUM" in exchanges[0]
    assert plans["fixture-dense"].count() == 25 * 4096


def test_model_outputs_are_derived_and_only_ids_are_stored(spark, monkeypatch):
    from voxelweave import fixtures as fx

    stored = {}
    monkeypatch.setattr(fx, "_written", {})
    monkeypatch.setattr(fx, "materialize", lambda df, label: stored.setdefault(label, df))
    for build in (fx.maps, fx.dense):
        assert build(spark, "/root/testdata/sf0.001").columns[6:] == ["proba", "heat", "ox", "oy", "oz", "intensity"]
    assert set(stored) == {"fixture-voxels", "fixture-dense"}
    assert all(df.columns == ["case_id", "x", "y", "z", "ref_id", "pred_id"] for df in stored.values())


def test_a_call_merges_a_group_of_cases(spark, tmp_path):
    from voxelweave.streaming import pieces

    def land(batch, cases, told):
        rows = [(c, datetime(2024, 1, 1), told, 3, [(1, 1, 2), (1, 0, 1)], batch) for c in cases]
        spark.createDataFrame(rows, pieces.PIECES).coalesce(1).write.parquet(str(tmp_path / "parts" / f"part={batch}"))

    def run():
        closed = pieces.close_cases(pieces.arrived_pieces(spark, str(tmp_path / "parts")), 1000, 1000, "1 minute", groups=4)
        closed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "offsets")).trigger(
            availableNow=True).start().awaitTermination()
        return {r["case_id"]: tuple(r[1:]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    land(0, range(40), 6)
    assert run() == {}
    land(1, range(20, 60), 6)
    assert run() == {c: (True, 2, [1, 1], [1, 0], [4, 2]) for c in range(20, 40)}
    assert 0 < spark.read.format("statestore").load(str(tmp_path / "offsets")).count() <= 4


def test_arrivals_are_not_broadcast(spark, tmp_path, monkeypatch, capsys):
    from voxelweave.operators import overlap

    for name, ids in (("pred", "pred_id"), ("ref", "ref_id")):
        spark.createDataFrame([(0, x, 0, 0, 1) for x in range(9)], f"case_id long, x long, y long, z long, {ids} long").write.parquet(str(tmp_path / name))
    both = overlap.align(*[spark.read.parquet(str(tmp_path / n)) for n in ("pred", "ref")])
    both.filter("ref_id > 0").explain()
    both.filter("pred_id > 0").explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_the_large_case_is_laid_out_without_shuffling_voxels(spark, monkeypatch):
    from voxelweave import fixtures as fx

    plans = {}
    monkeypatch.setattr(fx, "_written", {})
    monkeypatch.setattr(fx, "materialize", lambda df, label: plans.setdefault(label, df) if label == "fixture-large" else session.materialize(df, label))
    large = fx.large(spark, "/root/testdata/sf0.001")
    rod = large.filter("y = 8 AND z = 8")
    assert large.select("x", "y", "z").distinct().count() == large.count()
    assert {r["ref_id"] for r in rod.collect()} == {1} and rod.count() == large.agg({"x": "max"}).first()[0] + 1
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SinglePartition" in plan  # the length of the rod only


def test_a_task_paints_a_bounded_number_of_customers(spark, monkeypatch):
    from voxelweave import fixtures as fx

    monkeypatch.setattr(fx, "PAINTED", 10)
    sf = "/root/testdata/sf0.001"
    assert fx._build_voxels(spark, sf).rdd.getNumPartitions() >= fx.table(spark, sf, "customer").count() / 10 > 4
