"""Queries on matching and scoring predicted against reference instances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxelweave import fixtures as fx
from voxelweave.operators import custom, metrics, overlap, refine, sizes
from voxelweave.operators.components import components
from voxelweave.operators.confluence import confluence_classes, confluent_instances, dilate
from voxelweave.plans import evaluate as ev
from voxelweave.queries.common import (
    CLEAN, CLU, CONFLUENT, COUNTS, KEY_SQL, MATCH, RAW, STEPS, cc_sql, rounded, scores_sql,
)
from voxelweave.queries.registry import query
from voxelweave.session import materialize, new_path
from voxelweave.sources import curve, results

BASE = ("vox", "gappy", "cases")


def _table(spark, sf):
    return overlap.contingency(fx.gappy(spark, sf))


def _counts(spark, sf):
    table = _table(spark, sf)
    return metrics.case_table(fx.cases(spark, sf), table, overlap.match(table))


def _scored(spark, sf, *names):
    return rounded(metrics.score(_counts(spark, sf), list(names)).select("case_id", *names))


@query("align_volumes", fx.duck("SELECT * FROM gappy", "gappy"))
def align_volumes(spark, sf):
    v = fx.gappy(spark, sf)
    return overlap.align(v.filter("pred_id > 0").drop("ref_id"), v.filter("ref_id > 0").drop("pred_id"))


@query("overlap_pairs", fx.duck(RAW + MATCH + """ SELECT case_id, pred_id, ref_id, inter, n_pred, n_ref, round(iou, 6) iou,
  round(dice, 6) dice FROM pairs""", *BASE))
def overlap_pairs(spark, sf):
    return rounded(overlap.overlap_pairs(_table(spark, sf)))


@query("best_reference_per_prediction", fx.duck(RAW + MATCH + " SELECT case_id, pred_id, ref_id, round(iou, 6) iou FROM best", *BASE))
def best_reference_per_prediction(spark, sf):
    best = overlap.best_ref_per_pred(overlap.overlap_pairs(_table(spark, sf)))
    return rounded(best.select("case_id", "pred_id", "ref_id", "iou"))


@query("matched_pairs", fx.duck(RAW + MATCH + " SELECT case_id, pred_id, ref_id, inter, kept, round(iou, 6) iou FROM matches", *BASE))
def matched_pairs(spark, sf):
    return rounded(overlap.match(_table(spark, sf)).select("case_id", "pred_id", "ref_id", "inter", "kept", "iou"))


@query("unmatched_instances", fx.duck(RAW + MATCH + """ SELECT 'pred' side, case_id, pred_id id FROM np
  WHERE (case_id, pred_id) NOT IN (SELECT (case_id, pred_id) FROM matches WHERE kept)
  UNION ALL SELECT 'ref', case_id, ref_id FROM nr WHERE (case_id, ref_id) NOT IN (SELECT (case_id, ref_id) FROM matches WHERE kept)""", *BASE))
def unmatched_instances(spark, sf):
    table = _table(spark, sf)
    matches = overlap.match(table)
    parts = [
        overlap.unmatched(table, matches, f"{s}_id").select(F.lit(s).alias("side"), "case_id", F.col(f"{s}_id").alias("id"))
        for s in ("pred", "ref")
    ]
    return parts[0].unionByName(parts[1])


@query("ids_not_in_volume", fx.duck("""SELECT DISTINCT case_id, pred_id + 1 pred_id FROM gappy g WHERE pred_id > 0
  AND (case_id, pred_id + 1) NOT IN (SELECT (case_id, pred_id) FROM gappy)""", "gappy"))
def ids_not_in_volume(spark, sf):
    table = _table(spark, sf)
    asked = table.filter("pred_id > 0").select("case_id", (F.col("pred_id") + 1).alias("pred_id")).distinct()
    return overlap.ids_missing_from(asked, table, "pred_id")


@query("instance_sizes", fx.duck("""SELECT 'pred' side, case_id, pred_id id, count(*) n FROM gappy WHERE pred_id > 0 GROUP BY ALL
  UNION ALL SELECT 'ref', case_id, ref_id, count(*) FROM gappy WHERE ref_id > 0 GROUP BY ALL""", "gappy"))
def instance_sizes(spark, sf):
    table = _table(spark, sf)
    parts = [
        overlap.instances(table, f"{s}_id").select(F.lit(s).alias("side"), "case_id", F.col(f"{s}_id").alias("id"), "n")
        for s in ("pred", "ref")
    ]
    return parts[0].unionByName(parts[1])


@query("instance_counts", fx.duck(RAW + MATCH + COUNTS + " SELECT case_id, n_pred_inst, n_ref_inst FROM counts", *BASE))
def instance_counts(spark, sf):
    cases = fx.cases(spark, sf).select("case_id")
    counts = metrics.case_counts(_table(spark, sf)).select("case_id", "n_pred_inst", "n_ref_inst")
    return cases.join(counts, "case_id", "left").fillna(0)


for _name, _cols in {
    "dice_score": ["DSC"], "normalised_dice": ["nDSC"], "dice_per_match": ["Dice_Per_TP"], "panoptic_quality": ["PQ"],
    "detection_scores": ["F1", "Recall", "Precision", "FPR", "DiC"],
}.items():
    query(_name, fx.duck(RAW + MATCH + COUNTS + f" SELECT case_id, {scores_sql(*_cols)} FROM counts", *BASE))(
        lambda spark, sf, cols=tuple(_cols): _scored(spark, sf, *cols)
    )


@query("count_identities", fx.duck(RAW + MATCH + COUNTS + """ SELECT case_id, tp "TP", fp "FP", fn "FN",
  tp + fn = n_ref_inst AND tp + fp = n_pred_inst AS holds FROM counts""", *BASE))
def count_identities(spark, sf):
    counts = _counts(spark, sf)
    bad = metrics.count_violations(counts).select("case_id", F.lit(False).alias("holds"))
    return counts.join(bad, "case_id", "left").select("case_id", "TP", "FP", "FN", F.coalesce("holds", F.lit(True)).alias("holds"))


_INST = """SELECT case_id, ref_id, count(*) n, min(x) lo_x, max(x) hi_x, min(y) lo_y, max(y) hi_y, min(z) lo_z, max(z) hi_z
  FROM gappy WHERE ref_id > 0 GROUP BY 1, 2"""


@query("bounding_boxes", fx.duck(_INST, "gappy"))
def bounding_boxes(spark, sf):
    return overlap.instances(_table(spark, sf), "ref_id")


@query("size_verdicts", fx.duck(f""", i AS ({_INST}) SELECT case_id, ref_id, n*sx*sy*sz volume, (hi_x-lo_x+1)*sx mm_x,
  (hi_y-lo_y+1)*sy mm_y, (hi_z-lo_z+1)*sz mm_z, (hi_x-lo_x+1)*sx < 3 OR (hi_y-lo_y+1)*sy < 3 OR (hi_z-lo_z+1)*sz < 3
  OR n*sx*sy*sz <= 14 too_small FROM i JOIN cases USING (case_id)""", *BASE))
def size_verdicts(spark, sf):
    inst = overlap.instances(_table(spark, sf), "ref_id")
    return sizes.size_verdicts(inst, fx.cases(spark, sf)).select(
        "case_id", "ref_id", "volume", "mm_x", "mm_y", "mm_z", "too_small"
    )


@query("slice_size_verdicts", fx.duck(f""", i AS (SELECT case_id, z, ref_id, count(*) n, max(x)-min(x)+1 ex, max(y)-min(y)+1 ey
  FROM gappy WHERE ref_id > 0 GROUP BY ALL) SELECT case_id, z, ref_id, ex*sx < 3 OR ey*sy < 3 OR n*sx*sy <= 4 too_small
  FROM i JOIN cases USING (case_id)""", *BASE))
def slice_size_verdicts(spark, sf):
    inst = fx.gappy(spark, sf).filter("ref_id > 0").groupBy("case_id", "z", "ref_id").agg(
        F.count("*").alias("n"), *[c for c in overlap.bounds()]
    )
    return sizes.size_verdicts_2d(inst, fx.cases(spark, sf), 4, 3).select("case_id", "z", "ref_id", "too_small")


@query("remove_small_instances", fx.duck(CLEAN + " SELECT * FROM v", *BASE))
def remove_small_instances(spark, sf):
    return sizes.remove_small_instances(fx.gappy(spark, sf), fx.cases(spark, sf))


@query("remove_small_components", fx.duck(f""", src AS (SELECT case_id, x, y, z FROM gappy WHERE pred_id > 0), {STEPS},
{cc_sql('cc', 'src', 'case_id', '6')},
t AS (SELECT case_id, root, count(*) n, max(x)-min(x)+1 ex, max(y)-min(y)+1 ey, max(z)-min(z)+1 ez FROM cc GROUP BY 1, 2)
SELECT case_id, x, y, z FROM cc JOIN t USING (case_id, root) JOIN cases USING (case_id)
  WHERE NOT (ex*sx < 3 OR ey*sy < 3 OR ez*sz < 3 OR n*sx*sy*sz <= 14)""", *BASE, recursive=True))
def remove_small_components(spark, sf):
    return refine.remove_small_components(fx.gappy(spark, sf).filter("pred_id > 0"), fx.cases(spark, sf))


@query("dilated_mask", fx.duck(f""", {STEPS} SELECT DISTINCT g.case_id, g.x + dx x, g.y + dy y, g.z + dz z FROM gappy g
  JOIN (SELECT dx, dy, dz FROM steps WHERE r = 1 UNION ALL SELECT 0, 0, 0) s ON ref_id > 0 JOIN cases c USING (case_id)
  WHERE g.x + dx BETWEEN 0 AND nx-1 AND g.y + dy BETWEEN 0 AND ny-1 AND g.z + dz BETWEEN 0 AND nz-1""", *BASE))
def dilated_mask(spark, sf):
    return dilate(fx.gappy(spark, sf).filter("ref_id > 0"), fx.cases(spark, sf), 1)


@query("confluent_instances", fx.duck(CLEAN + CONFLUENT + " SELECT case_id, tier, conn, ref_id FROM confluent", *BASE, recursive=True))
def confluent(spark, sf):
    cases = fx.cases(spark, sf)
    refs = sizes.remove_small_instances(fx.gappy(spark, sf), cases)
    # Bricks of side 8, so that components cross brick faces here.
    return confluent_instances(refs, cases, tuple(metrics.VARIANTS), side=8)


_LARGE = f""", {STEPS}, src AS (SELECT case_id, x, y, z FROM large), {cc_sql('cc', 'src', 'case_id', '6')}"""


@query("components_of_a_large_case", fx.duck(_LARGE + " SELECT case_id, root, count(*) n FROM cc GROUP BY ALL", "vox", "large", recursive=True))
def components_of_a_large_case(spark, sf):
    """One case over many bricks, with an instance that runs through a row of them."""
    return components(fx.large(spark, sf), None, 6).groupBy("case_id", "root").agg(F.count("*").alias("n"))


@query("box_of_a_large_case", fx.duck("SELECT x, y, z, ref_id FROM large WHERE x BETWEEN 37 AND 101 AND y BETWEEN 5 AND 90 AND z BETWEEN 3 AND 12", "vox", "large"))
def box_of_a_large_case(spark, sf):
    """A large case is stored along the curve; the scan of a box opens the row groups of its key ranges."""
    path = new_path(spark, "curve")
    curve.write(fx.large(spark, sf), path, 16)
    return curve.scan_box(spark, path, 0, (37, 5, 3), (101, 90, 12), 16).select("x", "y", "z", "ref_id")


@query("confluence_of_a_large_case", fx.duck(_LARGE + """, held AS (SELECT DISTINCT root, ref_id FROM cc JOIN large USING (case_id, x, y, z))
SELECT DISTINCT CAST(0 AS BIGINT) case_id, CAST(0 AS BIGINT) tier, CAST(6 AS BIGINT) conn, ref_id FROM held
  WHERE root IN (SELECT root FROM held GROUP BY 1 HAVING count(*) > 1)""", "vox", "large", recursive=True))
def confluence_of_a_large_case(spark, sf):
    rows = fx.large(spark, sf)
    grid = rows.groupBy("case_id").agg(*[(F.max(a) + 1).alias(f"n{a}") for a in "xyz"])
    return confluent_instances(rows, materialize(grid, "grid"), ((0, 6),))


@query("confluent_classes", fx.duck(f""", {STEPS}, src AS (SELECT case_id, x, y, z FROM gappy WHERE ref_id > 0),
{cc_sql('cc', 'src', 'case_id', '6')},
held AS (SELECT DISTINCT cc.case_id, root, ref_id FROM cc JOIN gappy USING (case_id, x, y, z)),
c AS (SELECT DISTINCT case_id, ref_id FROM (SELECT *, count(*) OVER (PARTITION BY case_id, root) k FROM held) WHERE k > 1)
SELECT DISTINCT g.case_id, g.ref_id, CAST(CASE WHEN c.ref_id IS NULL THEN 1 ELSE 2 END AS BIGINT) confluent_class
FROM gappy g LEFT JOIN c ON g.case_id = c.case_id AND g.ref_id = c.ref_id WHERE g.ref_id > 0""", *BASE, recursive=True))
def confluent_classes(spark, sf):
    return confluence_classes(fx.gappy(spark, sf), fx.cases(spark, sf))


_CLU_COLS = ", ".join(
    f'"{m}"' if m in metrics.CLU_SUMMED else f'round("{m}", 6) + 0.0e0 AS "{m}"'
    for m in metrics.CLU_SUMMED + metrics.CLU_AVERAGED
)


@query("confluent_unit_metrics", fx.duck(CLEAN + MATCH + COUNTS + CONFLUENT + CLU + f" SELECT case_id, tier, conn, {_CLU_COLS} FROM clu",
                                         *BASE, recursive=True))
def confluent_unit_metrics(spark, sf):
    cases, v = fx.cases(spark, sf), fx.gappy(spark, sf)
    table = sizes.drop_small(overlap.contingency(v), cases, "ref_id")
    refs = sizes.remove_small_instances(v, cases)
    marked = confluent_instances(refs, cases, tuple(metrics.VARIANTS))
    counts = metrics.case_table(cases, table, overlap.match(table))
    return rounded(metrics.clu_metrics(counts, overlap.overlap_pairs(table), marked))


_WIDE = [scores_sql("PQ", "DSC", "nDSC", "F1", "Recall", "Precision", "FPR", "Dice_Per_TP", "DiC"),
         'tp "TP"', 'fp "FP"', 'fn "FN"', 'n_pred_inst "Pred_Lesion_Count"', 'n_ref_inst "Ref_Lesion_Count"', 'fp_clu "FP_CLU"']
_SUFFIXED = [
    (f'max("{m}") FILTER (WHERE tier = {t} AND conn = {c})', f"{m}{s}")
    for (t, c), s in metrics.VARIANTS.items() for m in metrics.CLU_SUMMED + metrics.CLU_AVERAGED
]
_CLUW = ", cluw AS (SELECT case_id, " + ", ".join(f'{e} "{n}"' for e, n in _SUFFIXED) + " FROM clu GROUP BY 1)"
_CLUW_COLS = ", ".join(
    f'"{n}"' if any(n.startswith(m) for m in metrics.CLU_SUMMED) else f'round("{n}", 6) + 0.0e0 AS "{n}"' for _, n in _SUFFIXED
)
_EVAL = CLEAN + MATCH + COUNTS + CONFLUENT + CLU + _CLUW
# Unrounded wide row, for the summaries.
_FULL = _EVAL + ", wide AS MATERIALIZED (SELECT " + ", ".join(
    ["counts.case_id"]
    + [c.replace("round(", "(").replace(", 6) + 0.0e0", ")") for c in _WIDE[:1]]
    + _WIDE[1:]
    + [f'"{n}"' for _, n in _SUFFIXED]
) + " FROM counts JOIN cluw USING (case_id))"


@query("evaluate_cases", fx.duck(_EVAL + f" SELECT case_id, {', '.join(_WIDE)}, {_CLUW_COLS} FROM counts JOIN cluw USING (case_id)",
                                 *BASE, recursive=True))
def evaluate_cases(spark, sf):
    return rounded(ev.evaluate(fx.gappy(spark, sf), fx.cases(spark, sf)).metrics)


@query("saved_evaluation", fx.duck(CLEAN + MATCH + COUNTS + f""", lesions AS (SELECT np.case_id, count(*) n FROM np GROUP BY 1)
SELECT case_id, fold, tp "TP", fp "FP", fn "FN", {scores_sql('DSC', 'PQ')}, coalesce(n, 0) lesions FROM counts
  JOIN (SELECT case_id, fold FROM cases) USING (case_id) LEFT JOIN lesions USING (case_id)""", *BASE))
def saved_evaluation(spark, sf):
    """The evaluation of all folds written as a tree of JSON and CSV tables, and read back."""
    cases, path = fx.cases(spark, sf), new_path(spark, "evaluation")
    results.save_evaluation(ev.evaluate(fx.gappy(spark, sf), cases), path, cases.select("case_id", "fold"), ["fold"])
    details = results.read(spark, f"{path}/metrics_details", "case_id long, TP long, FP long, FN long, DSC double, PQ double, fold long", "json")
    lesions = results.read(spark, f"{path}/pred_matches_csv", fmt="csv").groupBy(F.col("patient_id").cast("long").alias("case_id")).agg(
        F.count("*").alias("lesions"))
    return rounded(details.join(lesions, "case_id", "left").withColumn("lesions", F.coalesce("lesions", F.lit(0).cast("long"))))


@query("predicted_lesion_table", fx.duck(CLEAN + MATCH + """ SELECT np.case_id patient_id, np.pred_id pred_lesion_id,
  m.ref_id "Ref_Lesion_ID_Match", np.n_pred*sx*sy*sz "Volume_Pred", m.n_ref*sx*sy*sz "Volume_Ref", round(dice, 6) "DSC",
  round(iou, 6) "IoU", m.ref_id IS NOT NULL "TP", m.ref_id IS NULL "FP"
  FROM np JOIN cases USING (case_id) LEFT JOIN matches m ON kept AND m.case_id = np.case_id AND m.pred_id = np.pred_id""", *BASE))
def predicted_lesion_table(spark, sf):
    return rounded(ev.evaluate(fx.gappy(spark, sf), fx.cases(spark, sf)).pred_matches)


_FLAGS = ", ".join(
    f'EXISTS (SELECT 1 FROM confluent f WHERE f.case_id = nr.case_id AND f.ref_id = nr.ref_id AND tier = {t} AND conn = {c}) "is_confluent{s}"'
    for (t, c), s in metrics.VARIANTS.items()
)


@query("reference_lesion_table", fx.duck(CLEAN + MATCH + CONFLUENT + f""" SELECT nr.case_id patient_id, nr.ref_id ref_lesion_id,
  m.pred_id "Pred_Lesion_ID_Match", nr.n_ref*sx*sy*sz "Volume_Ref", m.n_pred*sx*sy*sz "Volume_Pred", round(dice, 6) "DSC",
  round(iou, 6) "IoU", {_FLAGS}, m.pred_id IS NULL "FN"
  FROM nr JOIN cases USING (case_id) LEFT JOIN matches m ON kept AND m.case_id = nr.case_id AND m.ref_id = nr.ref_id""",
                                         *BASE, recursive=True))
def reference_lesion_table(spark, sf):
    return rounded(ev.evaluate(fx.gappy(spark, sf), fx.cases(spark, sf)).ref_matches)


def _sum_sql(names, tail=""):
    return ", ".join(f'round(avg("{m}"), 6) + 0.0e0 "{m}"' for m in metrics.AVERAGED) + ", " + ", ".join(
        f'CAST(sum("{m}") AS BIGINT) "{m}"' for m in metrics.SUMMED
    )


@query("dataset_summary", fx.duck(_FULL + f" SELECT {_sum_sql(None)} FROM wide", *BASE, recursive=True))
def dataset_summary(spark, sf):
    return rounded(metrics.summarise(ev.evaluate(fx.gappy(spark, sf), fx.cases(spark, sf)).metrics, []))


@query("fold_summaries", fx.duck(_FULL + f" SELECT fold, {_sum_sql(None)} FROM wide JOIN cases USING (case_id) GROUP BY fold",
                                 *BASE, recursive=True))
def fold_summaries(spark, sf):
    return rounded(ev.evaluate_model(fx.gappy(spark, sf), fx.cases(spark, sf))[0])


_FOLDS = _FULL + ", folds AS (SELECT fold, " + ", ".join(
    [f'avg("{m}") "{m}"' for m in metrics.AVERAGED] + [f'sum("{m}") "{m}"' for m in metrics.SUMMED]
) + " FROM wide JOIN cases USING (case_id) GROUP BY fold)"


@query("summary_across_folds", fx.duck(_FOLDS + " SELECT " + ", ".join(
    [f'CASE WHEN count("{m}") = count(*) THEN round(avg("{m}"), 6) + 0.0e0 END "{m}"' for m in metrics.AVERAGED]
    + [f'CAST(sum("{m}") AS BIGINT) "{m}"' for m in metrics.SUMMED]
    + [f'CASE WHEN count("{m}") = count(*) THEN round(stddev_pop("{m}"), 6) + 0.0e0 END "{m}_std"' for m in metrics.AVERAGED]
) + " FROM folds", *BASE, recursive=True))
def summary_across_folds(spark, sf):
    return rounded(ev.evaluate_model(fx.gappy(spark, sf), fx.cases(spark, sf))[1])


@query("summary_cube", fx.duck(RAW + MATCH + COUNTS + """ SELECT fold, case_id % 2 grp, round(avg(dsc), 6) "DSC", CAST(sum(tp) AS BIGINT) "TP"
  FROM (SELECT c.*, fold, CASE WHEN n_pred + n_ref = 0 THEN 1.0e0 ELSE 2.0e0*inter/(n_pred + n_ref) END dsc
    FROM counts c JOIN cases USING (case_id)) GROUP BY CUBE (fold, case_id % 2)""", *BASE))
def summary_cube(spark, sf):
    cases = fx.cases(spark, sf).select("case_id", "fold", (F.col("case_id") % 2).alias("grp"))
    scored = metrics.score(_counts(spark, sf), ["DSC"]).join(cases, "case_id")
    return rounded(metrics.summarise(scored, ["fold", "grp"], ["DSC"], ["TP"], cube=True))


@query("fold_tree", fx.duck(CLEAN + MATCH + COUNTS + f""" SELECT fold, CASE WHEN case_id % 2 = 0 THEN 'CC' ELSE 'ACLS' END postprocessor,
  count(*) n, CAST(sum(tp) AS BIGINT) "TP", CAST(sum(fp) AS BIGINT) "FP" FROM counts JOIN cases USING (case_id) GROUP BY ALL""", *BASE))
def fold_tree(spark, sf):
    """Writes case metrics as a model / fold / post-processor tree and reads it back with its partition columns."""
    cases = fx.cases(spark, sf)
    table = sizes.drop_small(_table(spark, sf), cases, "ref_id")
    scored = metrics.case_table(cases, table, overlap.match(table)).select("case_id", "TP", "FP").join(
        cases.select("case_id", "fold"), "case_id"
    ).withColumns({"model": F.lit("m1"), "postprocessor": F.when(F.col("case_id") % 2 == 0, "CC").otherwise("ACLS")})
    back = results.round_trip(scored, ["model", "fold", "postprocessor"], "fold-tree")
    return back.groupBy(F.col("fold").cast("long").alias("fold"), "postprocessor").agg(
        F.count("*").alias("n"), F.sum("TP").alias("TP"), F.sum("FP").alias("FP")
    )


@query("postprocessor_choice", """SELECT DISTINCT c_mktsegment || CASE WHEN c_nationkey % 2 = 0 THEN '_SEMANTIC' ELSE '' END model,
  unnest(CASE WHEN c_nationkey % 2 = 0 THEN ['ACLS', 'CC'] ELSE ['OFFSETS'] END) postprocessor FROM customer""")
def postprocessor_choice(spark, sf):
    tail = F.when(F.col("c_nationkey") % 2 == 0, "_SEMANTIC").otherwise("")
    models = fx.table(spark, sf, "customer").select(F.concat("c_mktsegment", tail).alias("model")).distinct()
    return ev.postprocessors_for(models)


def _kappa(v, case):
    """Cohen's kappa of both masks over the whole grid; none where both are empty or full."""
    n = case["nx"] * case["ny"] * case["nz"]
    both, pred, ref = v
    chance = (pred * ref + (n - pred) * (n - ref)) / n**2
    return None if chance == 1 else ((n - pred - ref + 2 * both) / n - chance) / (1 - chance)


def _masks(at):
    pred, ref = at["pred_id"] > 0, at["ref_id"] > 0
    return np.array([(pred & ref).sum(), pred.sum(), ref.sum()])


def _slices(at):
    """First and last (negated) slice in which the masks meet."""
    z = at["z"][(at["pred_id"] > 0) & (at["ref_id"] > 0)]
    return np.array([z.min(), -z.max()]) if len(z) else np.full(2, np.inf)


custom.register(custom.PythonMetric("kappa", (0.0, 0.0, 0.0), _masks, _kappa))
custom.register(custom.PythonMetric(
    "slices_met", (float("inf"), float("inf")), _slices, lambda v, case: None if np.isinf(v[0]) else -v[1] - v[0] + 1, np.minimum))


@query("python_metrics", fx.duck(""", c AS (SELECT case_id, nx * ny * nz::DOUBLE n, count(*) FILTER (WHERE pred_id > 0 AND ref_id > 0)::DOUBLE b,
  count(*) FILTER (WHERE pred_id > 0)::DOUBLE p, count(*) FILTER (WHERE ref_id > 0)::DOUBLE r,
  max(z) FILTER (WHERE pred_id > 0 AND ref_id > 0) - min(z) FILTER (WHERE pred_id > 0 AND ref_id > 0) + 1 met
  FROM cases LEFT JOIN gappy USING (case_id) GROUP BY case_id, nx, ny, nz),
k AS (SELECT *, (p * r + (n - p) * (n - r)) / (n * n) e FROM c)
SELECT case_id, round(CASE WHEN e <> 1 THEN ((n - p - r + 2 * b) / n - e) / (1 - e) END, 6) + 0.0e0 kappa, met::DOUBLE slices_met FROM k""", "vox", "gappy", "cases"))
def python_metrics(spark, sf):
    """Two metrics that a user wrote in Python, one merged by sums and one by minima."""
    return rounded(custom.score(fx.gappy(spark, sf), fx.cases(spark, sf), ["kappa", "slices_met"], side=8))
