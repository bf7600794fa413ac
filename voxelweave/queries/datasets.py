"""Queries on catalogs, descriptors, splits, sinks and integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelweave import fixtures as fx
from voxelweave.functions import draws
from voxelweave.operators import integrity
from voxelweave.queries.common import rounded
from voxelweave.queries.registry import query
from voxelweave.session import materialize, new_path
from voxelweave.sources import catalog, descriptor, voxels as vx


def _files(spark, sf):
    """Image files of two channels per customer; some second channels are absent."""
    k = F.col("c_custkey")
    both = fx.table(spark, sf, "customer").select(k, F.explode(F.array(F.lit(0), F.lit(1))).alias("ch"))
    kept = both.filter(~((F.col("ch") == 1) & (k % 13 == 0)))
    name = F.concat(F.lit("imagesTr/case_"), F.lpad(k.cast("string"), 8, "0"), F.lit("_000"), F.col("ch").cast("string"), F.lit(".nii.gz"))
    return kept.select(name.alias("path"))


_FILES = """WITH files AS (SELECT c_custkey k, 'case_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS "case",
  'imagesTr/case_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '_000' || ch || '.nii.gz' path
  FROM customer, unnest([0, 1]) t(ch) WHERE NOT (ch = 1 AND c_custkey % 13 = 0))"""


@query("case_catalog", _FILES + """ SELECT "case", string_agg(path, ',' ORDER BY path) files, count(*) n FROM files GROUP BY 1""")
def case_catalog(spark, sf):
    found = catalog.case_catalog(_files(spark, sf))
    return found.select("case", F.array_join("files", ",").alias("files"), F.size("files").cast("long").alias("n")).orderBy("case")


def _labels(spark, sf):
    k = F.col("c_custkey")
    return fx.table(spark, sf, "customer").filter(k % 17 != 0).select(
        F.concat(F.lit("case_"), F.lpad(k.cast("string"), 8, "0")).alias("case")
    )


@query("cases_without_label", _FILES + """ SELECT DISTINCT "case" FROM files WHERE k % 17 = 0""")
def cases_without_label(spark, sf):
    return integrity.without_label(catalog.case_catalog(_files(spark, sf)), _labels(spark, sf))


@query("absent_files", """SELECT 'imagesTr/case_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '_0001.nii.gz' path
  FROM customer WHERE c_custkey % 13 = 0""")
def absent_files(spark, sf):
    k = F.col("c_custkey")
    wanted = fx.table(spark, sf, "customer").select(F.explode(F.array(*[
        F.concat(F.lit("imagesTr/case_"), F.lpad(k.cast("string"), 8, "0"), F.lit(f"_000{c}.nii.gz")) for c in (0, 1)
    ])).alias("path"))
    return integrity.absent_files(wanted, _files(spark, sf))


@query("voxels_outside_grid", fx.duck("""SELECT v.case_id, CASE WHEN c.case_id IS NULL THEN 'no case' ELSE 'outside' END fault, count(*) n
  FROM vox v LEFT JOIN (SELECT case_id, nx - 4 nx, ny, nz FROM cases WHERE case_id % 9 <> 4) c ON c.case_id = v.case_id
  WHERE c.case_id IS NULL OR x < 0 OR y < 0 OR z < 0 OR x >= nx OR y >= ny OR z >= nz GROUP BY ALL""", "vox", "cases"))
def voxels_outside_grid(spark, sf):
    """Against a case table that lacks every ninth case and has grids four voxels too short."""
    cases = fx.cases(spark, sf).filter("case_id % 9 <> 4").withColumn("nx", F.col("nx") - 4)
    return integrity.outside_grid(fx.voxels(spark, sf), cases)


def _descriptors(spark, sf):
    """One JSON descriptor per nation, some of them incomplete or with a wrong count."""
    counted = fx.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    k = F.col("c_nationkey")
    return counted.select(k.cast("long").alias("nation"), F.to_json(F.struct(
        F.when(k % 3 != 0, F.struct(F.lit("FLAIR").alias("0"), F.lit("T1").alias("1"))).alias("channel_names"),
        (F.col("n") + F.when(k % 4 == 0, 1).otherwise(0)).alias("numTraining"),
        F.when(k % 5 != 0, F.lit(".nii.gz")).alias("file_ending"),
        F.when(k % 2 == 0, F.lit("x")).alias("licence"),
    )).alias("doc"))


@query("descriptor_keys", """SELECT DISTINCT CAST(c_nationkey AS BIGINT) nation,
  concat_ws(',', CASE WHEN c_nationkey % 3 = 0 THEN 'channel_names' END, CASE WHEN c_nationkey % 5 = 0 THEN 'file_ending' END) missing,
  CASE WHEN c_nationkey % 2 = 0 THEN 'licence' ELSE '' END unused FROM customer""")
def descriptor_keys(spark, sf):
    checked = descriptor.check_keys(_descriptors(spark, sf))
    return checked.select("nation", F.array_join("missing", ",").alias("missing"), F.array_join("unused", ",").alias("unused"))


@query("wrong_case_counts", """SELECT CAST(c_nationkey AS BIGINT) nation, count(*) + 1 num_training, count(*) AS found FROM customer
  WHERE c_nationkey % 4 = 0 GROUP BY 1""")
def wrong_case_counts(spark, sf):
    cases = fx.table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("nation"))
    return integrity.wrong_case_counts(descriptor.parse(_descriptors(spark, sf)), cases, "nation")


def _facts(spark, sf, label: bool):
    c = F.col("case_id")
    nz, sy, sx = F.col("nz"), F.col("sy"), F.col("sx")
    if label:
        nz = nz + F.when(c % 9 == 4, 1).otherwise(0)
        sy = sy * (1 + F.when(c % 7 == 2, 1e-4).when(c % 7 == 3, 9e-6).otherwise(0.0))
    return fx.cases(spark, sf).select(
        "case_id", F.array("nx", "ny", nz).alias("shape"), F.array(sx, sy, "sz").alias("spacing"),
        F.when(c % 11 == 5, 1).otherwise(2).alias("n_channels"),
    )


@query("grid_disagreements", fx.duck("""SELECT case_id, case_id % 9 = 4 shape_differs, case_id % 7 = 2 spacing_differs,
  case_id % 11 = 5 channels_differ FROM cases WHERE case_id % 9 = 4 OR case_id % 7 = 2 OR case_id % 11 = 5""", "cases"))
def grid_disagreements(spark, sf):
    return integrity.grid_disagreements(_facts(spark, sf, False), _facts(spark, sf, True), 2)


@query("spacing_warnings", fx.duck("SELECT case_id FROM cases WHERE case_id % 7 = 2", "cases"))
def spacing_warnings(spark, sf):
    return integrity.spacing_warnings(_facts(spark, sf, True), _facts(spark, sf, False))


@query("instance_map_faults", fx.duck("""SELECT case_id, min(CASE WHEN case_id % 6 = 1 AND ref_id = 2 THEN -2 ELSE ref_id END) < 0 negative_id,
  count(*) FILTER (WHERE case_id % 8 = 3 OR ref_id <> 0) >= 4096 no_background FROM dense GROUP BY 1
  HAVING negative_id OR no_background""", "dense"))
def instance_map_faults(spark, sf):
    c = F.col("case_id")
    ids = F.when((c % 6 == 1) & (F.col("ref_id") == 2), -2).when((c % 8 == 3) & (F.col("ref_id") == 0), 9).otherwise(F.col("ref_id"))
    return integrity.instance_map_faults(fx.dense(spark, sf).withColumn("ref_id", ids), fx.cases(spark, sf))


@query("not_binary", fx.duck("SELECT case_id, count(*) n FROM vox WHERE ref_id NOT IN (0, 1) GROUP BY 1", "vox"))
def not_binary(spark, sf):
    return integrity.not_binary(fx.voxels(spark, sf), "ref_id")


_NAMES = """WITH refs AS (SELECT DISTINCT 'case_' || (c_custkey % 997) AS "case" FROM customer),
preds AS (SELECT DISTINCT 'out_case_' || (c_custkey % 997) || '_instance_seg_pred_CC.nii.gz' AS file FROM customer WHERE c_custkey % 5 <> 0)"""


def _names(spark, sf):
    tail = (F.col("c_custkey") % 997).cast("string")
    t = fx.table(spark, sf, "customer")
    refs = t.select(F.concat(F.lit("case_"), tail).alias("case")).distinct()
    preds = t.filter("c_custkey % 5 <> 0").select(F.concat(F.lit("out_case_"), tail, F.lit("_instance_seg_pred_CC.nii.gz")).alias("file")).distinct()
    return refs, preds


_STATUS = """, n, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'ok' ELSE 'several' END status FROM
  (SELECT "case", count(file) n, min(file) f FROM refs LEFT JOIN preds ON {on} GROUP BY 1)"""


@query("files_by_substring", _NAMES + ' SELECT "case", CASE WHEN n = 1 THEN f END file' + _STATUS.format(on='contains(file, "case")'))
def files_by_substring(spark, sf):
    refs, preds = _names(spark, sf)
    return catalog.pair_files(refs, preds, exact=False)


@query("files_by_case", _NAMES + ' SELECT "case", CASE WHEN n = 1 THEN f END file'
       + _STATUS.format(on="""file = 'out_' || "case" || '_instance_seg_pred_CC.nii.gz'"""))
def files_by_case(spark, sf):
    refs, preds = _names(spark, sf)
    named = preds.withColumn("case", F.regexp_replace(catalog.case_of_prediction(F.col("file"), "CC"), "^out_", ""))
    return catalog.pair_files(refs, named)


def _splits(spark, sf):
    c = fx.cases(spark, sf).select("case_id", "fold")
    every = c.withColumn("k", F.explode(F.expr("sequence(0L, 4L)")))
    return every.select(F.col("k").alias("fold"), F.when(F.col("fold") == F.col("k"), "val").otherwise("train").alias("role"), "case_id")


@query("fold_selection", fx.duck("""SELECT 'train' role, case_id FROM cases WHERE fold <> 2 UNION ALL SELECT 'val', case_id FROM cases
  WHERE fold = 2 UNION ALL SELECT 'all', case_id FROM cases""", "cases"))
def fold_selection(spark, sf):
    cases, splits = fx.cases(spark, sf), _splits(spark, sf)
    parts = [
        descriptor.select_cases(cases, splits, 2, r).select(F.lit(r).alias("role"), "case_id") for r in ("train", "val")
    ] + [descriptor.select_cases(cases, splits, "all", "train").select(F.lit("all").alias("role"), "case_id")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("paired_by_case", fx.duck("""SELECT case_id, n_pred, n_ref FROM (SELECT case_id, count(*) n_pred FROM vox WHERE pred_id > 0 GROUP BY 1)
  JOIN (SELECT case_id, count(*) n_ref FROM vox WHERE ref_id > 0 GROUP BY 1) USING (case_id)""", "vox"))
def paired_by_case(spark, sf):
    v = fx.voxels(spark, sf)
    pred = v.filter("pred_id > 0").groupBy("case_id").agg(F.count("*").alias("n_pred"))
    ref = v.filter("ref_id > 0").groupBy("case_id").agg(F.count("*").alias("n_ref"))
    return pred.join(ref, "case_id").orderBy("case_id")


@query("bundle_scan", fx.duck("""SELECT case_id, count(*) n, CAST(sum(CASE WHEN ref_id > 0 THEN 1 ELSE 0 END) AS BIGINT) fg, count(*) brain,
  CAST(0 AS BIGINT) heat_known FROM vox GROUP BY 1""", "vox"))
def bundle_scan(spark, sf):
    """Writes a bundle without its optional attributes and scans it with the full schema."""
    path = new_path(spark, "bundle")
    stored = fx.maps(spark, sf).select("case_id", "x", "y", "z", "intensity", (F.col("ref_id") > 0).cast("long").alias("seg"),
                                       F.col("ref_id").alias("instance_seg"))
    vx.write(stored, path, 16)
    back = vx.masks(vx.scan(spark, path))
    return back.groupBy("case_id").agg(
        F.count("*").alias("n"), F.sum(F.col("fg").cast("long")).alias("fg"), F.sum(F.col("brainmask").cast("long")).alias("brain"),
        F.count("center_heatmap").alias("heat_known"),
    )


@query("storage_types", fx.duck("""SELECT case_id, CASE WHEN max(pred_id * 12) <= 127 THEN 'tinyint' ELSE 'smallint' END kind FROM vox GROUP BY 1""", "vox"))
def storage_types(spark, sf):
    """Written case by case in the narrowest type, and read back."""
    path = new_path(spark, "narrow")
    vx.write_narrow(fx.voxels(spark, sf).withColumn("pred_id", F.col("pred_id") * 12), path, "pred_id")
    return vx.scan_narrow(spark, path, "pred_id").select("case_id", "kind").distinct()


@query("scan_of_some_cases", fx.duck("SELECT case_id, count(*) n, round(sum(intensity), 3) total FROM maps JOIN cases USING (case_id) WHERE fold = 3 GROUP BY 1", "maps", "cases"))
def scan_of_some_cases(spark, sf):
    """A fold's cases out of a stored bundle; only their buckets are opened."""
    path = new_path(spark, "bundle")
    vx.write(fx.maps(spark, sf).select("case_id", "x", "y", "z", "intensity"), path, 64)
    back = vx.scan(spark, path, fx.cases(spark, sf).filter("fold = 3"), 64)
    return rounded(back.groupBy("case_id").agg(F.count("*").alias("n"), F.sum("intensity").alias("total")), 3)


@query("attributes_dropped", fx.duck("SELECT case_id, x, y, z, round(proba, 6) proba FROM maps", "maps"))
def attributes_dropped(spark, sf):
    return rounded(vx.drop_attributes(fx.maps(spark, sf), "ref_id", "pred_id", "heat", "ox", "oy", "oz", "intensity"))


@query("prediction_sink", fx.duck("""SELECT case_id, CASE WHEN case_id % 2 = 0 THEN 'CC' ELSE 'ACLS' END postprocessor, count(*) n,
  CAST(sum(pred_id) AS BIGINT) ids FROM vox WHERE pred_id > 0 GROUP BY 1, 2""", "vox"))
def prediction_sink(spark, sf):
    path = new_path(spark, "predictions")
    tagged = fx.maps(spark, sf).filter("pred_id > 0").withColumnRenamed("pred_id", "instance_seg_pred").withColumn(
        "postprocessor", F.when(F.col("case_id") % 2 == 0, "CC").otherwise("ACLS"))
    vx.save_predictions(tagged, path)
    return spark.read.parquet(path).groupBy("case_id", "postprocessor").agg(
        F.count("*").alias("n"), F.sum("instance_seg_pred").alias("ids"))


@query("attribute_export", fx.duck("""SELECT key, channel, count(*) n, round(sum(value), 3) total FROM (
  SELECT 'heat' AS key, CAST(NULL AS BIGINT) channel, heat AS value FROM maps UNION ALL SELECT 'proba', NULL, proba FROM maps
  UNION ALL SELECT 'offsets', 0, ox FROM maps UNION ALL SELECT 'offsets', 1, oy FROM maps UNION ALL SELECT 'offsets', 2, oz FROM maps
  UNION ALL SELECT 'data', NULL, intensity FROM maps) GROUP BY 1, 2""", "maps"))
def attribute_export(spark, sf):
    maps = fx.maps(spark, sf).select("case_id", "x", "y", "z", "heat", "proba", F.array("ox", "oy", "oz").alias("offsets"),
                                     F.array("intensity").alias("data"))
    path = new_path(spark, "attributes")
    vx.export(maps, path, ["heat", "proba"], ["offsets", "data"])
    back = spark.read.parquet(path)
    return rounded(back.groupBy("key", F.col("channel").cast("long").alias("channel")).agg(
        F.count("*").alias("n"), F.sum("value").alias("total")), 3)


@query("case_batches", fx.duck(f"""SELECT case_id, CAST(floor((row_number() OVER (ORDER BY case_id) - 1) / 4) AS BIGINT) batch,
  CAST(floor((row_number() OVER (ORDER BY {draws.mix_sql(7, 'case_id')}, case_id) - 1) / 4) AS BIGINT) shuffled FROM cases""", "cases"))
def case_batches(spark, sf):
    cases = fx.cases(spark, sf).select("case_id")
    plain = vx.batches(cases, 4)
    return plain.join(vx.batches(cases, 4, seed=7).withColumnRenamed("batch", "shuffled"), "case_id")


@query("lesion_tables_of_all_folds", fx.duck("""SELECT fold, ref_id, count(*) n FROM (SELECT DISTINCT case_id, ref_id FROM vox WHERE ref_id > 0)
  JOIN cases USING (case_id) GROUP BY ALL""", "vox", "cases"))
def lesion_tables_of_all_folds(spark, sf):
    """Per-fold lesion tables put together by name."""
    lesions = fx.voxels(spark, sf).filter("ref_id > 0").select("case_id", "ref_id").distinct().join(
        fx.cases(spark, sf).select("case_id", "fold"), "case_id")
    return lesions.groupBy("fold", "ref_id").agg(F.count("*").alias("n"))
