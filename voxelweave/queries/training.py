"""Queries on patch sampling, augmentation, loss scores and logs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voxelweave import fixtures as fx
from voxelweave.functions import draws
from voxelweave.operators import augment, losses, overlap, sampling, tracking, windows
from voxelweave.plans import dataset, evaluate as ev
from voxelweave.queries.common import COUNTS, KEY_SQL, MATCH, SCORES, rounded
from voxelweave.queries.datasets import _splits
from voxelweave.queries.registry import query
from voxelweave.session import materialize

AT = ["case_id", "x", "y", "z"]


def _seg(spark, sf):
    return fx.dense(spark, sf).select(*AT, "intensity", "ref_id", (F.col("ref_id") > 0).cast("long").alias("seg"))


@query("class_counts", fx.duck("""SELECT case_id, count(*) FILTER (WHERE ref_id > 0) n_fg, count(*) FILTER (WHERE ref_id = 0) n_bg
  FROM dense GROUP BY 1""", "dense"))
def class_counts(spark, sf):
    return sampling.class_counts(_seg(spark, sf))


def _centre_sql(seed: int) -> str:
    """ctr: one drawn centre per case (sample 0)."""
    return f""", drawn AS MATERIALIZED (SELECT case_id, x, y, z, CAST(ref_id > 0 AS INT) fg, {draws.mix_sql(seed, 'case_id', '0', KEY_SQL)} d, {KEY_SQL} k FROM dense),
firsts AS MATERIALIZED (SELECT case_id, fg, arg_min(k, (d, k)) k FROM drawn GROUP BY 1, 2),
want AS MATERIALIZED (SELECT *, abs(fg - CAST({draws.uniform_sql(seed + 1, 'case_id', '0')} < 0.5e0 AS INT)) off FROM firsts),
ctr AS MATERIALIZED (SELECT w.case_id, CAST(w.fg AS BIGINT) fg, d.x, d.y, d.z FROM (SELECT case_id, arg_min(fg, off) fg, arg_min(k, off) k FROM want GROUP BY 1) w
  JOIN drawn d ON d.case_id = w.case_id AND d.k = w.k)"""


_WIN = """, win AS MATERIALIZED (SELECT case_id, least(greatest(x - 5, 0), nx - 10) x0, least(greatest(y - 3, 0), ny - 6) y0,
  least(greatest(z - 10, 0), greatest(nz - 20, 0)) z0, least(nx, 10) px, least(ny, 6) py, least(nz, 20) pz FROM ctr JOIN cases USING (case_id))"""
PATCH = (10, 6, 20)


@query("patch_centres", fx.duck(_centre_sql(11) + " SELECT case_id, CAST(0 AS BIGINT) sample, fg, x, y, z FROM ctr", "dense"))
def patch_centres(spark, sf):
    return sampling.patch_centres(_seg(spark, sf), 11)


# Positions of the patch first, so that the voxels meet them by equality alone.
@query("patch_voxels", fx.duck(_centre_sql(11) + _WIN + """, cells AS MATERIALIZED (SELECT case_id, x0 + i x, y0 + j y, z0 + k z, i, j, k
  FROM (SELECT *, unnest(range(0, px)) i FROM win), unnest(range(0, 6)) b(j), unnest(range(0, 20)) c(k) WHERE j < py AND k < pz)
SELECT case_id, i x, j y, k z, ref_id FROM cells JOIN dense USING (case_id, x, y, z)""", "dense", "cases"))
def patch_voxels(spark, sf):
    found = sampling.patch_windows(sampling.patch_centres(_seg(spark, sf), 11), fx.cases(spark, sf), PATCH)
    return sampling.cut_patches(_seg(spark, sf).select(*AT, "ref_id"), found, tile=4).drop("sample")


@query("class_locations", fx.duck(f"""SELECT case_id, class, x, y, z FROM (SELECT case_id, ref_id AS class, x, y, z,
  row_number() OVER (PARTITION BY case_id, ref_id ORDER BY {draws.mix_sql(5, 'case_id', KEY_SQL)}, {KEY_SQL}) r,
  count(*) OVER (PARTITION BY case_id, ref_id) n FROM vox WHERE ref_id > 0) WHERE r <= greatest(4, ceil(n * 0.3e0))""", "vox"))
def class_locations(spark, sf):
    return sampling.class_locations(fx.voxels(spark, sf), 5, "ref_id", n=4, coverage=0.3)


@query("random_decisions", fx.duck(f"""SELECT case_id, {draws.uniform_sql(3, 'case_id')} < 0.3e0 "on",
  round(0.7e0 + {draws.uniform_sql(5, 'case_id')} * 0.8e0, 6) gamma FROM cases""", "cases"))
def random_decisions(spark, sf):
    return rounded(augment.decisions(fx.cases(spark, sf), 3, 0.3, {"gamma": (0.7, 1.5)}))


def _params(cases, seed, probability, **ranges):
    return augment.decisions(cases, seed, probability, ranges)


def _draw(seed, lo, hi, i=0):
    return f"({lo}e0 + {draws.uniform_sql(seed + 2 + i, 'case_id')} * {float(hi - lo)!r})"


_STATS = "SELECT case_id, avg({v}) m, stddev_samp({v}) s, min({v}) lo, max({v}) hi FROM maps GROUP BY 1"


def _images(spark, sf):
    return fx.maps(spark, sf).select(*AT, "intensity")


for _invert in (False, True):
    _s = -1 if _invert else 1
    _seed = 21 + _invert

    def _gamma(spark, sf, invert=_invert, seed=_seed):
        params = _params(fx.cases(spark, sf), seed, 0.6, gamma=(0.7, 1.5))
        return rounded(augment.gamma(_images(spark, sf), params, invert=invert))

    query("gamma_contrast" + ("_inverted" if _invert else ""), fx.duck(f""", p AS (SELECT case_id, {draws.uniform_sql(_seed, 'case_id')} < 0.6e0 o,
  {_draw(_seed, 0.7, 1.5)} g FROM cases), st AS ({_STATS.format(v=f'intensity * {_s}')}),
c AS (SELECT case_id, x, y, z, intensity, o, m, s, pow((intensity * {_s} - lo) / (hi - lo + 1e-7), g) * (hi - lo) + lo v FROM maps JOIN p USING (case_id) JOIN st USING (case_id)),
a AS (SELECT case_id, avg(v) m2, stddev_samp(v) s2 FROM c GROUP BY 1)
SELECT case_id, x, y, z, round(CASE WHEN o THEN {_s} * (s * (v - m2) / (s2 + 1e-8) + m) ELSE intensity END, 6) + 0.0e0 intensity
FROM c JOIN a USING (case_id)""", "vox", "maps", "cases"))(_gamma)


@query("scaled_around_mean", fx.duck(f""", p AS (SELECT case_id, {draws.uniform_sql(31, 'case_id')} < 0.5e0 o, {_draw(31, -0.25, 0.25)} f FROM cases),
st AS ({_STATS.format(v='intensity')}) SELECT case_id, x, y, z, round(CASE WHEN o THEN least(greatest((intensity - m) * (1 + f) + m, lo), hi) ELSE intensity END, 6) + 0.0e0 intensity
FROM maps JOIN p USING (case_id) JOIN st USING (case_id)""", "vox", "maps", "cases"))
def scaled_around_mean(spark, sf):
    return rounded(augment.scale_fixed_mean(_images(spark, sf), _params(fx.cases(spark, sf), 31, 0.5, factor=(-0.25, 0.25))))


@query("scaled_intensity", fx.duck(f""", p AS (SELECT case_id, {draws.uniform_sql(41, 'case_id')} < 0.5e0 o, {_draw(41, -0.3, 0.3)} f FROM cases)
SELECT case_id, x, y, z, round(CASE WHEN o THEN intensity * (1 + f) ELSE intensity END, 6) + 0.0e0 intensity FROM maps JOIN p USING (case_id)""", "vox", "maps", "cases"))
def scaled_intensity(spark, sf):
    return rounded(augment.scale(_images(spark, sf), _params(fx.cases(spark, sf), 41, 0.5, factor=(-0.3, 0.3))))


@query("gaussian_noise", fx.duck(f"""SELECT case_id, x, y, z, round(CASE WHEN {draws.uniform_sql(51, 'case_id')} < 0.5e0 THEN intensity + 0.1e0 *
  sqrt(-2 * ln(greatest({draws.uniform_sql(53, 'case_id', KEY_SQL)}, 1.0e0/2147483647))) * cos({2 * math.pi!r} * {draws.uniform_sql(54, 'case_id', KEY_SQL)})
  ELSE intensity END, 6) + 0.0e0 intensity FROM maps""", "maps"))
def gaussian_noise(spark, sf):
    return rounded(augment.noise(_images(spark, sf), _params(fx.cases(spark, sf), 51, 0.5), 53))


# A table of taps per case and axis, each cut at four of the case's own deviations and normalised.
@query("smoothed_at_random", fx.duck(f""", dev AS MATERIALIZED (SELECT case_id, {draws.uniform_sql(61, 'case_id')} < 0.5e0 o, {_draw(61, 0.5, 1.0, 0)} sx,
  {_draw(61, 0.5, 1.0, 1)} sy, {_draw(61, 0.5, 1.0, 2)} sz FROM cases),
""" + ",\n".join(f"""tap{a} AS MATERIALIZED (SELECT case_id, d, w / sum(w) OVER (PARTITION BY case_id) w FROM (SELECT case_id, d, exp(-0.5e0 * (d / s{a}) * (d / s{a})) w
  FROM dev, unnest(range(-5, 6)) t(d) WHERE abs(d) <= floor(4 * s{a} + 0.5e0)))""" for a in "xyz") + """, px AS (SELECT case_id, x - d x, y, z, sum(intensity * w) v FROM maps JOIN dev USING (case_id) JOIN tapx USING (case_id) WHERE o GROUP BY ALL),
py AS (SELECT case_id, x, y - d y, z, sum(v * w) v FROM px JOIN tapy USING (case_id) GROUP BY ALL),
pz AS (SELECT case_id, x, y, z - d z, sum(v * w) v FROM py JOIN tapz USING (case_id) GROUP BY ALL)
SELECT case_id, x, y, z, round(CASE WHEN o THEN v ELSE intensity END, 6) intensity FROM maps JOIN dev USING (case_id) LEFT JOIN pz USING (case_id, x, y, z)""", "vox", "maps", "cases"))
def smoothed_at_random(spark, sf):
    params = _params(fx.cases(spark, sf), 61, 0.5, sx=(0.5, 1.0), sy=(0.5, 1.0), sz=(0.5, 1.0))
    return rounded(augment.smooth(_images(spark, sf), params))


@query("mirrored", fx.duck(f"""SELECT case_id, CASE WHEN o THEN nx - 1 - x ELSE x END x, CASE WHEN o THEN ny - 1 - y ELSE y END y,
  CASE WHEN o THEN nz - 1 - z ELSE z END z, ref_id FROM (SELECT v.*, nx, ny, nz, {draws.uniform_sql(71, 'case_id')} < 0.5e0 o FROM vox v JOIN cases USING (case_id))""", "vox", "cases"))
def mirrored(spark, sf):
    v = fx.voxels(spark, sf).select(*AT, "ref_id")
    return augment.mirror(v, _params(fx.cases(spark, sf), 71, 0.5), fx.cases(spark, sf))


def _zoom_axis(a: str) -> str:
    return f"""small{a} AS (SELECT case_id, m, t, CAST(floor(t * 16.0e0 / m) AS BIGINT) s FROM zm, unnest(range(0, 16)) u(t) WHERE t < m),
back{a} AS (SELECT c.case_id, c.s src, u.o dst, sum(1 - abs(CASE WHEN c.m > 1 THEN u.o * ((c.m - 1) / 15.0e0) ELSE 0 END - c.t)) w FROM small{a} c, unnest(range(0, 16)) u(o)
  WHERE abs(CASE WHEN c.m > 1 THEN u.o * ((c.m - 1) / 15.0e0) ELSE 0 END - c.t) < 1 GROUP BY ALL)"""


@query("simulated_low_resolution", fx.duck(f""", zm AS (SELECT case_id, {draws.uniform_sql(81, 'case_id')} < 0.5e0 o,
  greatest(CAST(round_even(16 * {_draw(81, 0.5, 1.0)}, 0) AS BIGINT), 1) m FROM cases), {_zoom_axis('x')}, {_zoom_axis('y')}, {_zoom_axis('z')}
SELECT v.case_id, bx.dst x, b_y.dst y, bz.dst z, round(sum(intensity * bx.w * b_y.w * bz.w), 6) intensity FROM maps v JOIN zm ON zm.case_id = v.case_id AND o
  JOIN backx bx ON bx.case_id = v.case_id AND bx.src = v.x JOIN backy b_y ON b_y.case_id = v.case_id AND b_y.src = v.y
  JOIN backz bz ON bz.case_id = v.case_id AND bz.src = v.z GROUP BY ALL
UNION ALL SELECT case_id, x, y, z, round(intensity, 6) FROM maps JOIN zm USING (case_id) WHERE NOT o""", "vox", "maps", "cases"))
def simulated_low_resolution(spark, sf):
    return rounded(augment.low_resolution(_images(spark, sf), _params(fx.cases(spark, sf), 81, 0.5, zoom=(0.5, 1.0)), fx.cases(spark, sf)))


# Quarter turn about z, then a shift by two along x: exact in floating point up to rounding.
def _turn(spark, sf):
    params = fx.cases(spark, sf).select("case_id", F.lit(math.pi / 2).alias("rz"), F.lit(2.0).alias("tx"), (F.col("case_id") % 2 == 0).alias("on"))
    return augment.affine_matrix(params, fx.cases(spark, sf))


@query("affine_labels", fx.duck("""SELECT g.case_id, g.x, g.y, g.z, coalesce(v.ref_id, 0) ref_id FROM grid g LEFT JOIN vox v ON v.case_id = g.case_id AND v.z = g.z
  AND v.x = CASE WHEN g.case_id % 2 = 0 THEN 15 - g.y + 2 ELSE g.x END AND v.y = CASE WHEN g.case_id % 2 = 0 THEN g.x ELSE g.y END""", "vox", "cases", "grid"))
def affine_labels(spark, sf):
    from voxelweave.operators import resample

    return resample.affine_nearest(fx.voxels(spark, sf), ["ref_id"], _turn(spark, sf))


@query("affine_intensity", fx.duck("""SELECT g.case_id, g.x, g.y, g.z, round(coalesce(v.intensity, 0), 6) intensity FROM grid g LEFT JOIN maps v ON v.case_id = g.case_id AND v.z = g.z
  AND v.x = CASE WHEN g.case_id % 2 = 0 THEN 15 - g.y + 2 ELSE g.x END AND v.y = CASE WHEN g.case_id % 2 = 0 THEN g.x ELSE g.y END""", "vox", "maps", "cases", "grid"))
def affine_intensity(spark, sf):
    from voxelweave.operators import resample

    return rounded(resample.affine_linear(fx.maps(spark, sf), ["intensity"], _turn(spark, sf)))


_TILES = """, st AS (SELECT unnest([0, 4, 8]) s), tl AS (SELECT m.*, a.s wx, b.s wy, c.s wz FROM maps m JOIN st a ON x >= a.s AND x < a.s + 8
  JOIN st b ON y >= b.s AND y < b.s + 8 JOIN st c ON z >= c.s AND z < c.s + 8)"""


@query("sliding_windows", fx.duck(_TILES + " SELECT case_id, x, y, z, wx, wy, wz FROM tl", "maps"))
def sliding_windows(spark, sf):
    tiled = windows.tile(fx.maps(spark, sf), fx.cases(spark, sf), (8, 8, 8))
    return tiled.select(*AT, *[F.col(f"w{a}").cast("long").alias(f"w{a}") for a in "xyz"])


@query("blended_windows", fx.duck(_TILES + """, w AS (SELECT *, proba + (wx + 2*wy + 3*wz) / 1000.0e0 p, greatest(exp(-0.5e0 * ((x-wx-3.5)*(x-wx-3.5)
  + (y-wy-3.5)*(y-wy-3.5) + (z-wz-3.5)*(z-wz-3.5))), 1e-3) w FROM tl)
SELECT case_id, x, y, z, round(sum(w*p)/sum(w), 6) proba FROM w GROUP BY ALL""", "maps"))
def blended_windows(spark, sf):
    tiled = windows.tile(fx.maps(spark, sf).select(*AT, "proba"), fx.cases(spark, sf), (8, 8, 8))
    out = tiled.withColumn("proba", F.col("proba") + (F.col("wx") + 2 * F.col("wy") + 3 * F.col("wz")) / 1000.0)
    return rounded(windows.blend(out, ["proba"], (8, 8, 8)))


@query("fold_patches", fx.duck(_centre_sql(11) + _WIN + """, pt AS (SELECT d.case_id, d.x - x0 x, d.y - y0 y, d.z - z0 z, ref_id FROM dense d JOIN win USING (case_id)
  WHERE d.x >= x0 AND d.x < x0 + px AND d.y >= y0 AND d.y < y0 + py AND d.z >= z0 AND d.z < z0 + pz),
cm AS (SELECT case_id, ref_id, avg(x) cx, avg(y) cy, avg(z) cz FROM pt WHERE ref_id > 0 GROUP BY 1, 2),
bt AS (SELECT case_id, CAST(floor((row_number() OVER (ORDER BY case_id) - 1) / 4) AS BIGINT) batch FROM cases WHERE fold <> 2)
SELECT batch, case_id, count(*) n, round(sum(coalesce(cx - x, 0) * (y + 1)), 4) + 0.0e0 ox FROM pt JOIN bt USING (case_id) LEFT JOIN cm USING (case_id, ref_id) GROUP BY ALL""", "dense", "cases"))
def fold_patches(spark, sf):
    """Validation patches of a fold's training cases, in batches of four."""
    cases = fx.cases(spark, sf)
    steps = dataset.validation_steps(cases, PATCH, 11)
    out = dataset.fold_dataset(_seg(spark, sf), cases, _splits(spark, sf), 2, "train", steps, 4)
    return rounded(out.groupBy("batch", "case_id").agg(F.count("*").alias("n"), F.sum(F.col("ox") * (F.col("y") + 1)).alias("ox")), 4)


@query("training_chain")
def training_chain(spark, sf):
    """The full training chain; every step has its own twin."""
    cases = fx.cases(spark, sf)
    out = dataset.fold_dataset(_seg(spark, sf), cases, _splits(spark, sf), 2, "train", dataset.train_steps(cases, PATCH, 11, remove_small=True), 4, seed=3)
    return rounded(out.groupBy("batch", "case_id").agg(F.count("*").alias("n"), F.avg("intensity").alias("mean"), F.sum("seg").alias("fg")), 4)


def _scored(spark, sf):
    """Logits, heat and offsets against made-up references on the whole grid."""
    d = fx.dense(spark, sf)
    return d.select(
        "case_id", (1.0 - F.col("proba")).alias("l0"), (F.col("proba") * 4 - 2).alias("l1"), (F.col("ref_id") > 0).cast("long").alias("g"),
        "heat", F.col("intensity").alias("heat_ref"), "ox", "oy", "oz", (F.col("intensity") - 0.5).alias("ox_ref"), (F.col("heat") - 0.5).alias("oy_ref"),
        F.col("proba").alias("oz_ref"), F.when(F.col("ref_id") > 2, 3.0).when(F.col("ref_id") > 0, 1.0).otherwise(0.0).alias("weight"),
    )


def _loss_sql(weighted: bool, smooth_l1: bool) -> str:
    w = "w" if weighted else "1"
    dist = "CASE WHEN abs({0}) < 1 THEN 0.5e0*({0})*({0}) ELSE abs({0}) - 0.5e0 END" if smooth_l1 else "abs({0})"
    off = " + ".join(f"({dist.format(e)})" for e in ("ox - (intensity - 0.5e0)", "oy - (heat - 0.5e0)", "oz - proba"))
    return f""", sc AS (SELECT case_id, CAST(ref_id > 0 AS INT) g, 1/(1 + exp((1.0e0 - proba) - (proba*4 - 2))) p, heat, intensity, {off} off,
  CASE WHEN ref_id > 2 THEN 3.0e0 WHEN ref_id > 0 THEN 1.0e0 ELSE 0.0e0 END w FROM dense),
ce AS (SELECT *, -ln(CASE WHEN g = 1 THEN p ELSE 1 - p END) ce FROM sc),
pt AS (SELECT case_id, 1 - (2*sum(p*g) + 1e-5)/(sum(p) + sum(g) + 1e-5) dice, avg(pow(1 - exp(-ce), 2) * ce * {w}) focal,
  avg((heat - intensity)*(heat - intensity) * {w}) heatmap, CASE WHEN sum(g) > 0 THEN sum(off*g*{w})/(3.0e0*sum(g)) ELSE 0 END offsets FROM ce GROUP BY 1)
SELECT case_id, round(dice, 6) dice, round(focal, 6) focal, round(0.5e0*dice + focal, 6) segmentation, round(heatmap, 6) heatmap, round(offsets, 6) offsets,
  round(0.5e0*dice + focal + heatmap + offsets, 6) loss FROM pt"""


@query("weighted_losses", fx.duck(_loss_sql(True, False), "dense"))
def weighted_losses(spark, sf):
    return rounded(losses.total_loss(_scored(spark, sf)))


@query("unweighted_losses", fx.duck(_loss_sql(False, True), "dense"))
def unweighted_losses(spark, sf):
    return rounded(losses.total_loss(_scored(spark, sf), weighted=False, kind="smooth_l1"))


@query("softmax_foreground", fx.duck("""SELECT case_id, x, y, z, round(1/(1 + exp((1.0e0 - proba) - (proba*4 - 2))) * CAST(ref_id > 0 AS INT), 6) + 0.0e0 p FROM maps""", "maps"))
def softmax_foreground(spark, sf):
    m = fx.maps(spark, sf).withColumns({"l0": 1.0 - F.col("proba"), "l1": F.col("proba") * 4 - 2})
    return rounded(m.select(*AT, losses.softmax_foreground(mask=F.col("ref_id") > 0).alias("p")))


_LOG = """, av AS (SELECT epoch, postprocessor, metric, avg(value) AS value FROM metrics_log GROUP BY ALL)"""


@query("log_averages", fx.duck(_LOG + ' SELECT epoch, postprocessor, metric, round("value", 6) AS "value" FROM av', "metrics_log"))
def log_averages(spark, sf):
    return rounded(tracking.log_averages(fx.metrics_log(spark, sf)))


@query("best_checkpoints", fx.duck(_LOG + """ SELECT epoch, postprocessor, metric, round("value", 6) AS "value", "value" > coalesce(max("value") OVER
  (PARTITION BY postprocessor, metric ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-infinity'::DOUBLE) is_best FROM av""", "metrics_log"))
def best_checkpoints(spark, sf):
    return rounded(tracking.best_so_far(tracking.log_averages(fx.metrics_log(spark, sf))))


@query("tracked_validation_metrics", fx.duck(""", v AS (SELECT * FROM gappy)""" + MATCH + COUNTS + f""" SELECT case_id % 3 epoch, 'CC' postprocessor, m.metric,
  round(avg(CASE m.metric WHEN 'DSC' THEN {SCORES['DSC']} WHEN 'nDSC' THEN {SCORES['nDSC']} ELSE {SCORES['PQ']} END), 6) AS "value"
  FROM counts, (SELECT unnest(['DSC', 'nDSC', 'PQ']) metric) m GROUP BY ALL""", "vox", "gappy", "cases"))
def tracked_validation_metrics(spark, sf):
    scores = ev.semantic_scores(overlap.contingency(fx.gappy(spark, sf)), fx.cases(spark, sf))
    tagged = scores.withColumns({"epoch": F.col("case_id") % 3, "postprocessor": F.lit("CC")}).drop("case_id")
    return rounded(tracking.tracked_means(tagged, ["DSC", "nDSC", "PQ"]))
