"""Queries on turning model output maps into instances."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelweave import fixtures as fx
from voxelweave.operators import centres, components as cc, overlap, refine as rf, stencil
from voxelweave.plans import evaluate as ev
from voxelweave.plans import postprocess as pp
from voxelweave.queries.common import KEY_SQL, MATCH, STEPS, cc_sql, rounded
from voxelweave.queries.registry import query
from voxelweave.schema import voxel_key
from voxelweave.session import materialize

BASE = ("vox", "maps", "cases")


for _conn in (6, 18, 26):
    def _components(spark, sf, conn=_conn):
        refs = fx.voxels(spark, sf).filter("ref_id > 0")
        # Bricks of side 8 on grids of 16, so that pieces are joined across faces.
        rooted = cc.components(refs, fx.cases(spark, sf), conn, side=8)
        return cc.number_components(rooted).select("case_id", "x", "y", "z", "label")

    query(f"components_{_conn}", fx.duck(f""", {STEPS}, src AS (SELECT case_id, x, y, z FROM vox WHERE ref_id > 0),
{cc_sql('cc', 'src', 'case_id', str(_conn))}
SELECT case_id, x, y, z, dense_rank() OVER (PARTITION BY case_id ORDER BY root) AS label FROM cc""", "vox", recursive=True))(_components)


@query("neighbour_pairs_18", fx.duck(f""", {STEPS}, n AS (SELECT case_id, x, y, z, {KEY_SQL} k FROM vox WHERE ref_id > 0)
SELECT a.case_id, a.k u, b.k v FROM n a JOIN steps s ON s.r <= 2 JOIN n b ON a.case_id = b.case_id AND b.x = a.x + dx
  AND b.y = a.y + dy AND b.z = a.z + dz WHERE a.k < b.k""", "vox"))
def neighbour_pairs_18(spark, sf):
    return cc.adjacency(fx.voxels(spark, sf).filter("ref_id > 0"), 18)


@query("z_runs", fx.duck("""SELECT case_id, x, y, min(z) z0, max(z) z1, x * 1099511627776 + y * 1048576 + min(z) run FROM
  (SELECT *, z - row_number() OVER (PARTITION BY case_id, x, y ORDER BY z) g FROM vox WHERE ref_id > 0)
  GROUP BY case_id, x, y, g""", "vox"))
def z_runs(spark, sf):
    return cc.encode_runs(fx.voxels(spark, sf).filter("ref_id > 0"))


@query("threshold_mask", fx.duck("""SELECT case_id, x, y, z, CAST(proba > 0.5 AS BIGINT) mask, CAST(ref_id > 0 AS BIGINT) ref_mask
  FROM maps""", *BASE))
def threshold_mask(spark, sf):
    return rounded(fx.maps(spark, sf).select(
        "case_id", "x", "y", "z", (F.col("proba") > 0.5).cast("tinyint").alias("mask"),
        (F.col("ref_id") > 0).cast("tinyint").alias("ref_mask"),
    ))


_NMS = """, cand AS (SELECT case_id, x, y, z, {heat} heat FROM maps WHERE {heat} > {t}),
mx AS (SELECT a.* FROM cand a WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.case_id = a.case_id AND b.x BETWEEN a.x-1 AND a.x+1
  AND b.y BETWEEN a.y-1 AND a.y+1 AND b.z BETWEEN a.z-1 AND a.z+1 AND b.heat > a.heat))"""
_COARSE = "floor(heat * 6) / 6"


def _coarse(spark, sf):
    return fx.maps(spark, sf).withColumn("heat", F.floor(F.col("heat") * 6).cast("double") / 6)


@query("local_maxima", fx.duck(_NMS.format(heat="heat", t=0.1) + " SELECT case_id, x, y, z, round(heat, 6) heat FROM mx", *BASE))
def local_maxima(spark, sf):
    return rounded(stencil.local_maxima(fx.maps(spark, sf)))


@query("peak_view", fx.duck(_NMS.format(heat="heat", t=0) + " SELECT case_id, x, y, z, round(heat, 6) heat FROM mx", *BASE))
def peak_view(spark, sf):
    return rounded(stencil.local_maxima(fx.maps(spark, sf), threshold=0.0))


_PLATEAU = _NMS.format(heat=_COARSE, t=0.1) + f""", {STEPS}, {cc_sql('cc', 'mx', 'case_id', '6')},
ctr AS (SELECT m.* FROM mx m JOIN cc USING (case_id, x, y, z) WHERE cc.k = cc.root)"""


@query("plateau_centres", fx.duck(_PLATEAU + " SELECT case_id, x, y, z, round(heat, 6) heat FROM ctr", *BASE, recursive=True))
def plateau_centres(spark, sf):
    maxima = materialize(stencil.local_maxima(_coarse(spark, sf)), "maxima")
    return rounded(centres.one_per_plateau(maxima, fx.cases(spark, sf)))


@query("top_k_centres", fx.duck(_NMS.format(heat="heat", t=0.1) + """ SELECT case_id, x, y, z, round(heat, 6) heat FROM
  (SELECT *, rank() OVER (PARTITION BY case_id ORDER BY heat DESC) r FROM mx) WHERE r <= 5""", *BASE))
def top_k_centres(spark, sf):
    return rounded(centres.top_k(stencil.local_maxima(fx.maps(spark, sf)), 5))


@query("centre_ids", fx.duck(_NMS.format(heat="heat", t=0.1) + f""" SELECT case_id, x, y, z,
  row_number() OVER (PARTITION BY case_id ORDER BY {KEY_SQL}) centre_id FROM mx""", *BASE))
def centre_ids(spark, sf):
    # Ranks and their totals both read the maxima.
    return centres.number_centres(materialize(stencil.local_maxima(fx.maps(spark, sf)).drop("heat"), "maxima"))


@query("calibrated_offsets", fx.duck(_NMS.format(heat="heat", t=0.1) + """, b AS (SELECT case_id, avg(ox) bx, avg(oy) by_, avg(oz) bz
  FROM maps JOIN mx USING (case_id, x, y, z) GROUP BY 1)
SELECT case_id, x, y, z, round(ox - coalesce(bx, 0), 6) + 0.0e0 ox, round(oy - coalesce(by_, 0), 6) + 0.0e0 oy,
  round(oz - coalesce(bz, 0), 6) + 0.0e0 oz FROM maps LEFT JOIN b USING (case_id)""", *BASE))
def calibrated_offsets(spark, sf):
    maps = fx.maps(spark, sf)
    found = stencil.local_maxima(maps)
    return rounded(centres.calibrate_offsets(maps.select("case_id", "x", "y", "z", "ox", "oy", "oz"), found))


@query("vote_image", fx.duck("""SELECT case_id, least(greatest(CAST(round_even(x + ox, 0) AS BIGINT), 0), nx-1) x,
  least(greatest(CAST(round_even(y + oy, 0) AS BIGINT), 0), ny-1) y, least(greatest(CAST(round_even(z + oz, 0) AS BIGINT), 0), nz-1) z,
  count(*) votes FROM dense JOIN cases USING (case_id) GROUP BY ALL""", "dense", "cases"))
def vote_image(spark, sf):
    return centres.votes(fx.dense(spark, sf), fx.cases(spark, sf))


_ASSIGN = f""", num AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {KEY_SQL}) cid FROM ctr),
asg AS MATERIALIZED (SELECT f.case_id, f.x, f.y, f.z, arg_min(cid, (d2, cid)) inst FROM
  (SELECT f.case_id, f.x, f.y, f.z, c.cid, (f.x+f.ox-c.x)*(f.x+f.ox-c.x) + (f.y+f.oy-c.y)*(f.y+f.oy-c.y)
     + (f.z+f.oz-c.z)*(f.z+f.oz-c.z) d2 FROM maps f JOIN num c USING (case_id) WHERE f.proba > 0.5) f GROUP BY ALL)"""


@query("nearest_centre", fx.duck(_NMS.format(heat="heat", t=0.1).replace("mx AS", "ctr AS") + _ASSIGN + " SELECT * FROM asg", *BASE))
def nearest_centre(spark, sf):
    maps = fx.maps(spark, sf)
    found = materialize(stencil.local_maxima(maps), "maxima")
    return centres.assign_to_centres(maps.filter("proba > 0.5"), found).drop("d2")


@query("nearest_labelled_voxel", fx.duck(f"""SELECT a.case_id, a.x, a.y, a.z, arg_min(b.ref_id, ((a.x-b.x)*(a.x-b.x)
  + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), {KEY_SQL.replace('x ', 'b.x ').replace('y ', 'b.y ').replace('+ z', '+ b.z')})) ref_id
  FROM vox a JOIN vox b ON a.case_id = b.case_id AND a.ref_id = 0 AND b.ref_id > 0 GROUP BY ALL""", "vox"))
def nearest_labelled_voxel(spark, sf):
    v = fx.voxels(spark, sf)
    return centres.spread_labels(v.filter("ref_id = 0"), v.filter("ref_id > 0"), "ref_id")


@query("contiguous_ids", fx.duck("""SELECT case_id, x, y, z, CASE WHEN pred_id = 0 THEN 0 ELSE dense_rank() OVER
  (PARTITION BY case_id, pred_id > 0 ORDER BY pred_id) END pred_id FROM vox""", "vox"))
def contiguous_ids(spark, sf):
    return rf.relabel(fx.voxels(spark, sf).select("case_id", "x", "y", "z", "pred_id"), "pred_id")


def _refine_sql(src: str, volume: float, axis: float) -> str:
    """CTEs from ``src(case_id, inst, x, y, z)`` to ``refined``."""
    return f""", {cc_sql('rc', src, 'case_id, inst', '6')},
rt AS (SELECT case_id, inst, root, count(*) n, (max(x)-min(x)+1) ex, (max(y)-min(y)+1) ey, (max(z)-min(z)+1) ez FROM rc GROUP BY 1, 2, 3),
rs AS (SELECT r.case_id, inst, root, n, ex*sx < {axis} OR ey*sy < {axis} OR ez*sz < {axis} OR n*sx*sy*sz <= {volume} bad
  FROM rt r JOIN cases USING (case_id)),
ro AS (SELECT *, bool_or(bad) OVER (PARTITION BY case_id, inst ORDER BY n DESC, root ROWS UNBOUNDED PRECEDING) gone,
  row_number() OVER (PARTITION BY case_id, inst ORDER BY n DESC, root) rk FROM rs),
rn AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CAST(rk > 1 AS INT), inst, n DESC, root) new_id FROM ro WHERE NOT gone),
refined AS (SELECT rc.case_id, rc.x, rc.y, rc.z, new_id inst FROM rc JOIN rn USING (case_id, inst, root))"""


@query("component_sizes", fx.duck(f""", {STEPS}, src AS (SELECT case_id, pred_id inst, x, y, z FROM vox WHERE pred_id > 0),
{cc_sql('cc', 'src', 'case_id, inst', '6')}
SELECT case_id, inst, n, row_number() OVER (PARTITION BY case_id, inst ORDER BY n DESC, root) place FROM
  (SELECT case_id, inst, root, count(*) n FROM cc GROUP BY ALL)""", "vox", recursive=True))
def component_sizes(spark, sf):
    from pyspark.sql import Window as W

    v = fx.voxels(spark, sf).withColumnRenamed("pred_id", "inst")
    table = rf.component_sizes(v, fx.cases(spark, sf))
    order = W.partitionBy("case_id", "inst").orderBy(F.col("n").desc(), "root")
    return rounded(table.select("case_id", "inst", "n", F.row_number().over(order).alias("place")))


@query("refined_instances", fx.duck(f""", {STEPS}, src AS (SELECT case_id, pred_id inst, x, y, z FROM vox WHERE pred_id > 0)
{_refine_sql('src', 3, 2)} SELECT * FROM refined""", "vox", "cases", recursive=True))
def refined_instances(spark, sf):
    v = fx.voxels(spark, sf).withColumnRenamed("pred_id", "inst")
    return rf.refine(v, fx.cases(spark, sf), "inst", 3, 2)


_CC_SRC = f""", {STEPS}, msk AS (SELECT case_id, x, y, z FROM maps WHERE proba > 0.5), {cc_sql('mc', 'msk', 'case_id', '6')},
lab AS (SELECT case_id, x, y, z, dense_rank() OVER (PARTITION BY case_id ORDER BY root) inst FROM mc)"""


@query("instances_by_components", fx.duck(_CC_SRC + _refine_sql("lab", 14, 3) + " SELECT * FROM refined", *BASE, recursive=True))
def instances_by_components(spark, sf):
    return pp.connected(fx.maps(spark, sf), fx.cases(spark, sf), min_volume=14, min_axis=3)


@query("instances_by_offsets", fx.duck(_PLATEAU + _ASSIGN + _refine_sql("asg", 0, 0) + " SELECT * FROM refined", *BASE, recursive=True))
def instances_by_offsets(spark, sf):
    return pp.by_offsets(_coarse(spark, sf), fx.cases(spark, sf))


def _lines(axis: str) -> str:
    others = [a for a in "xyz" if a != axis]
    return f"(PARTITION BY case_id, {', '.join(others)} ORDER BY {axis})"


def _smooth_sql(source: str, value: str, sigma: float, prefix: str) -> str:
    """CTEs {prefix}0 (dense) .. {prefix}3: smoothing along x, y and z."""
    taps = stencil.gaussian_taps(sigma)
    radius = len(taps) // 2
    text = f", {prefix}0 AS MATERIALIZED ({source})"
    for step, axis in enumerate("xyz"):
        terms = [f"{taps[radius]!r} * {value}".replace("np.float64(", "").replace(")", "")]
        for i in range(1, radius + 1):
            w = float(taps[radius + i])
            terms.append(f"{w!r} * (coalesce(lag({value}, {i}) OVER w, 0) + coalesce(lead({value}, {i}) OVER w, 0))")
        text += (f", {prefix}{step + 1} AS MATERIALIZED (SELECT * REPLACE ({' + '.join(terms)} AS {value}) FROM {prefix}{step} "
                 f"WINDOW w AS {_lines(axis)})")
    return text


def _gradient(value: str, axis: str) -> str:
    n = f"n{axis}"
    over = f"OVER {_lines(axis)}"
    return (f"CASE WHEN {axis} = 0 THEN lead({value}) {over} - {value} WHEN {axis} = {n} - 1 THEN {value} - lag({value}) {over} "
            f"ELSE (lead({value}) {over} - lag({value}) {over}) / 2 END")


_MASKED = """SELECT g.case_id, g.x, g.y, g.z, nx, ny, nz, coalesce(proba, 0.0e0) p, proba IS NOT NULL inside FROM grid g
  LEFT JOIN (SELECT case_id, x, y, z, proba FROM maps WHERE proba > 0.5) m USING (case_id, x, y, z)"""
_HESS = _smooth_sql(_MASKED, "p", 1.0, "s") + f""", g1 AS MATERIALIZED (SELECT *, {_gradient('p', 'x')} gx, {_gradient('p', 'y')} gy,
  {_gradient('p', 'z')} gz FROM s3),
hs AS MATERIALIZED (SELECT * FROM (SELECT case_id, x, y, z, inside, {_gradient('gx', 'x')} hxx, {_gradient('gy', 'y')} hyy,
  {_gradient('gz', 'z')} hzz, {_gradient('gx', 'y')} hxy, {_gradient('gx', 'z')} hxz, {_gradient('gy', 'z')} hyz FROM g1) WHERE inside),
ridge AS MATERIALIZED (SELECT case_id, x, y, z FROM hs WHERE hxx < 0 AND hxx*hyy - hxy*hxy > 0 AND
  hxx*(hyy*hzz - hyz*hyz) - hxy*(hxy*hzz - hyz*hxz) + hxz*(hxy*hyz - hyy*hxz) < 0)"""
DENSE = ("vox", "maps", "cases", "grid")


@query("gaussian_smoothing", fx.duck(_smooth_sql("""SELECT g.case_id, g.x, g.y, g.z, coalesce(intensity, 0.0e0) p,
  intensity IS NOT NULL inside FROM grid g LEFT JOIN maps USING (case_id, x, y, z)""", "p", 1.0, "s")
                                     + " SELECT case_id, x, y, z, round(p, 6) smooth FROM s3 WHERE inside", "vox", "maps", "cases", "grid"))
def gaussian_smoothing(spark, sf):
    return rounded(stencil.gaussian(fx.maps(spark, sf), "intensity", 1.0))


@query("hessian", fx.duck(_HESS + " SELECT case_id, x, y, z, " + ", ".join(f"round({h}, 6) + 0.0e0 {h}" for h in stencil.HESSIAN)
                          + " FROM hs", *DENSE))
def hessian(spark, sf):
    return rounded(stencil.hessian(pp.foreground(fx.maps(spark, sf)), "proba", fx.cases(spark, sf)))


@query("ridge_centres", fx.duck(_HESS + f""", {STEPS}, {cc_sql('rc6', 'ridge', 'case_id', '6')}
SELECT case_id, CAST(round_even(avg(x), 0) AS BIGINT) x, CAST(round_even(avg(y), 0) AS BIGINT) y, CAST(round_even(avg(z), 0) AS BIGINT) z
FROM rc6 GROUP BY case_id, root""", *DENSE, recursive=True))
def ridge_centres(spark, sf):
    return pp.ridge_centres(fx.maps(spark, sf), fx.cases(spark, sf))


_RIDGES = _HESS + f""", {STEPS}, {cc_sql('rcl', 'ridge', 'case_id', '26')},
lab AS MATERIALIZED (SELECT case_id, x, y, z, k, dense_rank() OVER (PARTITION BY case_id ORDER BY root) inst FROM rcl),
rest AS (SELECT case_id, x, y, z FROM maps m WHERE proba > 0.5 AND NOT EXISTS (SELECT 1 FROM lab l WHERE l.case_id = m.case_id
  AND l.x = m.x AND l.y = m.y AND l.z = m.z)),
grown AS (SELECT a.case_id, a.x, a.y, a.z, arg_min(b.inst, ((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.k)) inst
  FROM rest a JOIN lab b ON a.case_id = b.case_id GROUP BY ALL),
bare AS (SELECT case_id, x, y, z FROM rest WHERE case_id NOT IN (SELECT case_id FROM lab)), {cc_sql('bc', 'bare', 'case_id', '6')},
allv AS MATERIALIZED (SELECT case_id, x, y, z, inst FROM lab UNION ALL SELECT * FROM grown UNION ALL
  SELECT case_id, x, y, z, dense_rank() OVER (PARTITION BY case_id ORDER BY root) FROM bc)"""


@query("instances_by_ridges", fx.duck(_RIDGES + _refine_sql("allv", 0, 0) + " SELECT * FROM refined", *DENSE, recursive=True))
def instances_by_ridges(spark, sf):
    return pp.by_ridges(fx.maps(spark, sf), fx.cases(spark, sf))


@query("ensemble_mean", fx.duck("SELECT case_id, x, y, z, round(sum(proba) / 5, 6) proba FROM members GROUP BY ALL", "members"))
def ensemble_mean(spark, sf):
    return rounded(pp.ensemble(fx.members(spark, sf), ["proba"], 5))


@query("ensemble_to_instances", fx.duck(f""", ens AS (SELECT case_id, x, y, z, sum(proba) / 5 proba FROM members GROUP BY ALL), {STEPS},
msk AS (SELECT case_id, x, y, z FROM ens WHERE proba > 0.55), {cc_sql('mc', 'msk', 'case_id', '6')},
lab AS (SELECT case_id, x, y, z, dense_rank() OVER (PARTITION BY case_id ORDER BY root) inst FROM mc)""" + _refine_sql("lab", 3, 2)
                                        + " SELECT * FROM refined", "members", "cases", recursive=True))
def ensemble_to_instances(spark, sf):
    """The threshold keeps clear of the fixture's own values, so that rounding cannot flip a voxel."""
    mean = pp.ensemble(fx.members(spark, sf), ["proba"], 5).withColumn("proba", F.round("proba", 9))
    return pp.postprocess(mean, fx.cases(spark, sf), ["CC"], threshold=0.55, min_volume=3, min_axis=2).drop("postprocessor")


@query("predict_and_evaluate", fx.duck(_CC_SRC + _refine_sql("lab", 0, 0) + """, ir AS (SELECT case_id, ref_id, count(*) n, max(x)-min(x)+1 ex,
  max(y)-min(y)+1 ey, max(z)-min(z)+1 ez FROM vox WHERE ref_id > 0 GROUP BY 1, 2),
small AS (SELECT case_id, ref_id FROM ir JOIN cases USING (case_id) WHERE ex*sx < 3 OR ey*sy < 3 OR ez*sz < 3 OR n*sx*sy*sz <= 14),
v AS MATERIALIZED (SELECT case_id, x, y, z, coalesce(r.ref_id, 0) ref_id, coalesce(p.inst, 0) pred_id FROM
  (SELECT * FROM vox WHERE ref_id > 0 AND (case_id, ref_id) NOT IN (SELECT (case_id, ref_id) FROM small)) r
  FULL JOIN refined p USING (case_id, x, y, z))""" + MATCH + """ SELECT case_id, count(*) FILTER (WHERE kept) tp,
  count(*) FILTER (WHERE NOT kept) removed, round(sum(iou) FILTER (WHERE kept), 6) sum_iou FROM matches GROUP BY 1""", *BASE, recursive=True))
def predict_and_evaluate(spark, sf):
    cases, v = fx.cases(spark, sf), fx.voxels(spark, sf)
    pred = pp.connected(fx.maps(spark, sf), cases).withColumnRenamed("inst", "pred_id")
    whole = materialize(overlap.align(pred, v.filter("ref_id > 0").drop("pred_id")), "aligned")
    found = ev.evaluate(whole, cases).matches
    return rounded(found.groupBy("case_id").agg(
        F.sum(F.when(F.col("kept"), 1).otherwise(0)).alias("tp"), F.sum(F.when(F.col("kept"), 0).otherwise(1)).alias("removed"),
        F.sum(F.when(F.col("kept"), F.col("iou"))).alias("sum_iou"),
    ))


@query("evaluate_two_predictors", fx.duck(_CC_SRC + _refine_sql("lab", 0, 0) + """, ir AS (SELECT case_id, ref_id, count(*) n, max(x)-min(x)+1 ex,
  max(y)-min(y)+1 ey, max(z)-min(z)+1 ez FROM vox WHERE ref_id > 0 GROUP BY 1, 2),
small AS (SELECT case_id, ref_id FROM ir JOIN cases USING (case_id) WHERE ex*sx < 3 OR ey*sy < 3 OR ez*sz < 3 OR n*sx*sy*sz <= 14),
held AS MATERIALIZED (SELECT case_id, x, y, z, ref_id FROM vox WHERE ref_id > 0 AND (case_id, ref_id) NOT IN (SELECT (case_id, ref_id) FROM small)),
v AS MATERIALIZED (SELECT case_id * 2 case_id, x, y, z, coalesce(r.ref_id, 0) ref_id, coalesce(p.inst, 0) pred_id
  FROM held r FULL JOIN refined p USING (case_id, x, y, z) UNION ALL
  SELECT case_id * 2 + 1, x, y, z, coalesce(h.ref_id, 0), pred_id FROM vox LEFT JOIN held h USING (case_id, x, y, z))""" + MATCH + """,
sums AS (SELECT case_id, count(*) FILTER (WHERE kept) tp, count(*) FILTER (WHERE NOT kept) removed,
  coalesce(sum(iou) FILTER (WHERE kept), 0) sum_iou FROM matches GROUP BY 1)
SELECT p.postprocessor, c.case_id, coalesce(tp, 0) tp, coalesce(removed, 0) removed,
  (SELECT count(*) FROM np WHERE np.case_id = c.case_id * 2 + p.i) n_pred
FROM cases c JOIN (VALUES (0, 'CC'), (1, 'stored')) p(i, postprocessor) ON true LEFT JOIN sums s ON s.case_id = c.case_id * 2 + p.i""",
                                          *BASE, recursive=True))
def evaluate_two_predictors(spark, sf):
    """Two post-processors of one model scored in one job."""
    cases, v = fx.cases(spark, sf), fx.voxels(spark, sf)
    pred = pp.connected(fx.maps(spark, sf), cases).withColumnRenamed("inst", "pred_id")
    at = ["case_id", "x", "y", "z", "pred_id"]
    both = pred.select(*at, F.lit("CC").alias("postprocessor")).unionByName(v.select(*at, F.lit("stored").alias("postprocessor")))
    found = ev.evaluate_variants(both.withColumn("model", F.lit("m")), v.select("case_id", "x", "y", "z", "ref_id"), cases).metrics
    return found.select("postprocessor", "case_id", F.col("TP").alias("tp"), F.col("FP_CLU").alias("removed"),
                        F.col("Pred_Lesion_Count").alias("n_pred"))
