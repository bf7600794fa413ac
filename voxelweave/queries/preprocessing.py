"""Queries on geometry, resampling, intensities and training targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelweave import fixtures as fx
from voxelweave.operators import geometry, intensity, resample, sizes, spline, targets
from voxelweave.operators.confluence import confluence_classes
from voxelweave.plans import preprocess as prep
from voxelweave.queries.common import STEPS, cc_sql, rounded
from voxelweave.queries.registry import query
from voxelweave.session import materialize, new_path, shuffled

PERM = [2, 0, 1]


@query("axis_permutation", fx.duck("""SELECT case_id, z x, x y, y z, ref_id, sz sx, sx sy, sy sz FROM vox JOIN cases USING (case_id)""", "vox", "cases"))
def axis_permutation(spark, sf):
    cases = geometry.permute_cases(fx.cases(spark, sf), PERM).select("case_id", "sx", "sy", "sz")
    return geometry.permute(fx.voxels(spark, sf).drop("pred_id"), PERM).join(cases, "case_id")


@query("axis_order_restored", fx.duck("SELECT case_id, x, y, z, round(oy, 6) ox, round(ox, 6) oy, round(oz, 6) oz FROM maps", "maps"))
def axis_order_restored(spark, sf):
    """Offsets stored in permuted axes come back in the original axes with reordered components."""
    stored = geometry.permute(fx.maps(spark, sf).select("case_id", "x", "y", "z", "ox", "oy", "oz"), PERM)
    return rounded(geometry.reorder_offsets(stored, PERM))


def _image(spark, sf):
    """Intensities that are zero outside a box that depends on the case."""
    lo = F.col("case_id") % 4
    inside = F.lit(True)
    for a in ("x", "y", "z"):
        inside = inside & F.col(a).between(lo, 12)
    return fx.dense(spark, sf).select(
        "case_id", "x", "y", "z", F.when(inside & ((F.col("x") * 5 + F.col("y") * 3 + F.col("z")) % 11 != 0), F.col("intensity")).otherwise(0.0).alias("intensity"), "ref_id",
        F.when(F.col("ref_id") > 0, 1).otherwise(0).cast("long").alias("seg"),
    )


_IMG = """, img AS MATERIALIZED (SELECT case_id, x, y, z, CASE WHEN x BETWEEN case_id % 4 AND 12 AND y BETWEEN case_id % 4 AND 12
  AND z BETWEEN case_id % 4 AND 12 AND (x*5 + y*3 + z) % 11 <> 0 THEN intensity ELSE 0.0e0 END intensity, ref_id, CASE WHEN ref_id > 0 THEN 1 ELSE 0 END seg FROM dense),
box AS (SELECT case_id, min(x) lo_x, max(x) hi_x, min(y) lo_y, max(y) hi_y, min(z) lo_z, max(z) hi_z FROM img WHERE intensity <> 0 GROUP BY 1)"""


@query("nonzero_boxes", fx.duck(_IMG + " SELECT * FROM box", "dense"))
def nonzero_boxes(spark, sf):
    return geometry.nonzero_box(_image(spark, sf), ["intensity"])


# Zeros reached from the border; the other zeros are holes and count as inside.
_CROP = _IMG + f""", {STEPS}, dark AS MATERIALIZED (SELECT case_id, x, y, z FROM img WHERE intensity = 0),
outer_zeros AS (SELECT case_id, x, y, z FROM dark WHERE x IN (0, 15) OR y IN (0, 15) OR z IN (0, 15)
  UNION SELECT d.case_id, d.x, d.y, d.z FROM outer_zeros o JOIN steps s ON s.r = 1
    JOIN dark d ON d.case_id = o.case_id AND d.x = o.x + dx AND d.y = o.y + dy AND d.z = o.z + dz)"""


@query("crop_to_nonzero", fx.duck(_CROP + """ SELECT i.case_id, i.x - lo_x x, i.y - lo_y y, i.z - lo_z z, ref_id,
  CASE WHEN seg = 0 AND o.case_id IS NOT NULL THEN -1 ELSE seg END seg FROM img i JOIN box USING (case_id)
  LEFT JOIN outer_zeros o ON o.case_id = i.case_id AND o.x = i.x AND o.y = i.y AND o.z = i.z
  WHERE i.x BETWEEN lo_x AND hi_x AND i.y BETWEEN lo_y AND hi_y AND i.z BETWEEN lo_z AND hi_z""", "dense", recursive=True))
def crop_to_nonzero(spark, sf):
    return rounded(geometry.crop_to_nonzero(_image(spark, sf), ["intensity"], fx.cases(spark, sf))[0].drop("intensity"))


@query("crop_without_filling", fx.duck(_IMG + """ SELECT i.case_id, x - lo_x x, y - lo_y y, z - lo_z z, ref_id,
  CASE WHEN seg = 0 AND intensity = 0 THEN -1 ELSE seg END seg FROM img i JOIN box USING (case_id)
  WHERE x BETWEEN lo_x AND hi_x AND y BETWEEN lo_y AND hi_y AND z BETWEEN lo_z AND hi_z""", "dense"))
def crop_without_filling(spark, sf):
    cut, _ = geometry.crop_to_nonzero(_image(spark, sf), ["intensity"], fx.cases(spark, sf), fill_holes=False)
    return cut.drop("intensity")


@query("uncrop", fx.duck(_IMG + """ SELECT i.case_id, x, y, z, ref_id FROM img i JOIN box USING (case_id)
  WHERE x BETWEEN lo_x AND hi_x AND y BETWEEN lo_y AND hi_y AND z BETWEEN lo_z AND hi_z AND ref_id > 0""", "dense"))
def uncrop(spark, sf):
    cut, box = geometry.crop_to_nonzero(_image(spark, sf), ["intensity"], fx.cases(spark, sf), fill_holes=False)
    return geometry.uncrop(cut.filter("ref_id > 0").select("case_id", "x", "y", "z", "ref_id"), box)


@query("target_shapes", fx.duck("""SELECT case_id, CAST(round_even(nx*sx/0.7e0, 0) AS BIGINT) tx, CAST(round_even(ny*sy/1.5e0, 0) AS BIGINT) ty,
  CAST(round_even(nz*sz/1.0e0, 0) AS BIGINT) tz FROM cases""", "cases"))
def target_shapes(spark, sf):
    return geometry.new_shape(fx.cases(spark, sf), (0.7, 1.5, 1.0)).select("case_id", "tx", "ty", "tz")


@query("volumes_mm3", fx.duck("SELECT case_id, ref_id, count(*)*any_value(sx*sy*sz) volume FROM vox JOIN cases USING (case_id) WHERE ref_id > 0 GROUP BY ALL", "vox", "cases"))
def volumes_mm3(spark, sf):
    from voxelweave.functions import ratios

    n = fx.voxels(spark, sf).filter("ref_id > 0").groupBy("case_id", "ref_id").agg(F.count("*").alias("n"))
    return n.join(fx.cases(spark, sf), "case_id").select("case_id", "ref_id", ratios.volume_mm3("n").alias("volume"))


SHAPE = {"x": 11, "y": 23, "z": 16}


def _sized(spark, sf, df):
    cases = fx.cases(spark, sf).select("case_id", "nx", "ny", "nz", *[F.lit(v).cast("long").alias(f"t{a}") for a, v in SHAPE.items()])
    return df.join(cases, "case_id")


@query("resample_labels", fx.duck("""SELECT v.case_id, a.x, b.y, c.z, v.ref_id FROM vox v
  JOIN unnest(range(0, 11)) a(x) ON v.x = floor((a.x + 0.5e0) * 16 / 11) JOIN unnest(range(0, 23)) b(y) ON v.y = floor((b.y + 0.5e0) * 16 / 23)
  JOIN unnest(range(0, 16)) c(z) ON v.z = floor((c.z + 0.5e0) * 16 / 16) WHERE ref_id > 0""", "vox"))
def resample_labels(spark, sf):
    refs = fx.voxels(spark, sf).filter("ref_id > 0").drop("pred_id")
    return resample.nearest(_sized(spark, sf, refs)).select("case_id", "x", "y", "z", "ref_id")


def _axis_weights(name: str, n: int, m: int, corners: bool) -> str:
    src = f"t * ({n - 1}.0e0 / {m - 1})" if corners else f"least(greatest((t + 0.5e0) * {n} / {m} - 0.5e0, 0), {n - 1})"
    return f"{name} AS (SELECT s, t, 1 - abs({src} - s) w FROM unnest(range(0, {n})) a(s), unnest(range(0, {m})) b(t) WHERE 1 - abs({src} - s) > 0)"


for _corners in (False, True):
    def _linear(spark, sf, corners=_corners):
        return rounded(resample.linear(_sized(spark, sf, fx.maps(spark, sf).select("case_id", "x", "y", "z", "intensity")), ["intensity"], corners))

    query("resample_linear" + ("_corners" if _corners else ""), fx.duck(", " + ", ".join(
        _axis_weights(f"w{a}", 16, m, _corners) for a, m in SHAPE.items()) + """
SELECT case_id, wx.t x, wy.t y, wz.t z, round(sum(intensity * wx.w * wy.w * wz.w), 6) intensity FROM maps
  JOIN wx ON x = wx.s JOIN wy ON y = wy.s JOIN wz ON z = wz.s GROUP BY ALL""", "maps"))(_linear)


def _spline_sql(coarse: str = "-1") -> str:
    """The pipeline of three axes, each with the weights of all voxels for each target; the filter is cut where it ends for doubles."""
    pole = "(sqrt(3.0e0) - 2)"
    ctes = [f"co AS (SELECT case_id, {coarse} AS coarse FROM cases)",
            f"taps AS (SELECT j, -6 * {pole} / (1 - {pole} * {pole}) * pow({pole}, abs(j)) h FROM unnest(range(-40, 41)) u(j))"]
    last = "(SELECT case_id, x, y, z, intensity FROM dense JOIN cases USING (case_id))"
    for i, (a, m) in enumerate(SHAPE.items()):
        at = f"least(greatest((t + 0.5e0) * 16 / {m} - 0.5e0, 0), 15)"
        ctes.append(f"""wa{a} AS (SELECT t, least(greatest(k + j, 0), 15) s, sum(h * CASE WHEN abs(p - k) < 1 THEN 2.0e0 / 3 - pow(p - k, 2) + pow(abs(p - k), 3) / 2
    ELSE pow(greatest(2 - abs(p - k), 0), 3) / 6 END) w FROM (SELECT t, {at} p, floor({at}) + d k FROM unnest(range(0, {m})) a(t), unnest([-1, 0, 1, 2]) b(d)), taps GROUP BY 1, 2),
near{a} AS (SELECT t, floor((t + 0.5e0) * 16 / {m}) s, 1.0e0 w FROM unnest(range(0, {m})) a(t)),
all{a} AS (SELECT false c, * FROM wa{a} UNION ALL SELECT true, * FROM near{a})""")
        rest = ", ".join(f"v.{b}" for b in SHAPE if b != a)
        ctes.append(f"""pass{a} AS MATERIALIZED (SELECT v.case_id, w.t {a}, {rest}, sum(v.intensity * w.w) intensity FROM {last} v JOIN co USING (case_id)
  JOIN all{a} w ON w.c = (co.coarse = {i}) AND w.s = v.{a} GROUP BY v.case_id, w.t, {rest})""")
        last = f"pass{a}"
    return fx.duck(", " + ", ".join(ctes) + f" SELECT case_id, x, y, z, round(intensity, 6) + 0.0e0 intensity FROM {last}", "dense", "cases")


#: A case's slices are thick if its number says so; the tables have no such spacing.
_THICK = "case_id % 4 - 1"


@query("resample_spline", _spline_sql())
def resample_spline(spark, sf):
    return rounded(spline.cubic(_sized(spark, sf, fx.dense(spark, sf).select("case_id", "x", "y", "z", "intensity")), ["intensity"]))


@query("resample_spline_coarse", _spline_sql(_THICK))
def resample_spline_coarse(spark, sf):
    rows = _sized(spark, sf, fx.dense(spark, sf).select("case_id", "x", "y", "z", "intensity"))
    return rounded(spline.cubic(rows, ["intensity"], F.expr(_THICK)))


@query("image_statistics", fx.duck("""SELECT case_id, round(avg(intensity), 6) mean, round(stddev_samp(intensity), 6) sd,
  round(min(intensity), 6) low, round(max(intensity), 6) high FROM maps GROUP BY 1""", "maps"))
def image_statistics(spark, sf):
    return rounded(intensity.image_stats(fx.maps(spark, sf)))


@query("normalised_intensity", fx.duck("""SELECT case_id, x, y, z, round(CASE WHEN ref_id > 0 THEN (intensity - m) / greatest(s, 1e-8) ELSE intensity END, 6)
  + 0.0e0 intensity FROM maps LEFT JOIN (SELECT case_id, avg(intensity) m, stddev_pop(intensity) s FROM maps WHERE ref_id > 0 GROUP BY 1) USING (case_id)""", "maps"))
def normalised_intensity(spark, sf):
    out = intensity.zscore(fx.maps(spark, sf), "intensity", F.col("ref_id") > 0)
    return rounded(out.select("case_id", "x", "y", "z", "intensity"))


@query("fingerprint_from_summaries", fx.duck("""SELECT 0::BIGINT channel, count(*)::BIGINT n, round(avg(intensity), 6) mean, round(stddev_pop(intensity), 6) std,
  round(min(intensity), 6) min, round(max(intensity), 6) max, true near FROM maps WHERE ref_id > 0""", "maps"))
def fingerprint_from_summaries(spark, sf):
    """Stored summaries of all cases merged; ``near`` tells whether the percentiles are within a rank error of 0.002 of the exact ones."""
    rows = fx.maps(spark, sf).filter("ref_id > 0").select("case_id", F.lit(0).cast("long").alias("channel"), "intensity")
    path = new_path(spark, "summaries")
    intensity.case_summaries(rows).write.parquet(path)
    stored = spark.read.parquet(path)
    found = intensity.fingerprint_of(stored)
    ranks = rows.join(found, "channel").groupBy("channel").agg(F.count("*").alias("n"), *[
        (F.abs(F.avg((F.col("intensity") <= F.col(name)).cast("double")) - at) <= 0.002).alias(f"near_{name}")
        for at, name in intensity.FINGERPRINT.items()])
    near = ranks.select("channel", "n", F.expr(" AND ".join(f"near_{n}" for n in intensity.FINGERPRINT.values())).alias("near"))
    return rounded(found.join(near, "channel").select("channel", "n", "mean", "std", "min", "max", "near"))


def _channels(spark, sf):
    return fx.maps(spark, sf).filter("ref_id > 0").select(
        F.explode(F.array(F.struct(F.lit(0).cast("long").alias("channel"), F.col("intensity")),
                          F.struct(F.lit(1).cast("long").alias("channel"), F.col("heat").alias("intensity")))).alias("r")).select("r.*")


_CH = """, ch AS (SELECT CAST(0 AS BIGINT) channel, intensity FROM maps WHERE ref_id > 0 UNION ALL SELECT 1, heat FROM maps WHERE ref_id > 0)"""
_FP = _CH + """, fp AS (SELECT channel, avg(intensity) mean, stddev_pop(intensity) std, min(intensity) min, max(intensity) max,
  quantile_cont(intensity, 0.005) percentile_00_5, quantile_cont(intensity, 0.5) median, quantile_cont(intensity, 0.995) percentile_99_5
  FROM ch GROUP BY 1)"""


@query("intensity_fingerprint", fx.duck(_FP + " SELECT channel, " + ", ".join(
    f"round({c}, 6) {c}" for c in ("mean", "std", "min", "max", "percentile_00_5", "median", "percentile_99_5")) + " FROM fp", "maps"))
def intensity_fingerprint(spark, sf):
    return rounded(intensity.fingerprint(_channels(spark, sf)))


@query("scheme_normalised", fx.duck(_FP + """ SELECT channel, count(*) n, round(sum((least(greatest(intensity, percentile_00_5), percentile_99_5)
  - mean) / greatest(std, 1e-8)), 3) + 0.0e0 total FROM ch JOIN fp USING (channel) GROUP BY 1""", "maps"))
def scheme_normalised(spark, sf):
    rows = _channels(spark, sf)
    out = intensity.scheme_normalise(rows, intensity.fingerprint(rows))
    return rounded(out.groupBy("channel").agg(F.count("*").alias("n"), F.sum("intensity").alias("total")), 3)


@query("dataset_geometry", fx.duck("SELECT name, quantile_cont(value, 0.5) median FROM (" + " UNION ALL ".join(
    f"SELECT '{p}{a}' AS name, CAST({p}{a} AS DOUBLE) AS value FROM cases" for p in "ns" for a in "xyz") + ") GROUP BY 1", "cases"))
def dataset_geometry(spark, sf):
    return intensity.dataset_geometry(fx.cases(spark, sf))


_COM = """, com AS (SELECT case_id, ref_id, avg(x) cx, avg(y) cy, avg(z) cz, count(*) n FROM vox WHERE ref_id > 0 GROUP BY 1, 2)"""


@query("centres_of_mass", fx.duck(_COM + " SELECT case_id, ref_id, round(cx, 6) cx, round(cy, 6) cy, round(cz, 6) cz, n FROM com", "vox"))
def centres_of_mass(spark, sf):
    return rounded(sizes.centres_of_mass(fx.voxels(spark, sf)))


@query("offset_field", fx.duck(_COM + """ SELECT v.case_id, x, y, z, round(coalesce(cx - x, 0), 6) + 0.0e0 ox, round(coalesce(cy - y, 0), 6) + 0.0e0 oy,
  round(coalesce(cz - z, 0), 6) + 0.0e0 oz FROM vox v LEFT JOIN com USING (case_id, ref_id)""", "vox"))
def offset_field(spark, sf):
    v = fx.voxels(spark, sf)
    out = targets.offset_field(v, sizes.centres_of_mass(v))
    return rounded(out.select("case_id", "x", "y", "z", "ox", "oy", "oz"))


@query("centre_heatmap", fx.duck(_COM + """ SELECT g.case_id, g.x, g.y, g.z, round(max(exp(-((g.x-cx)*(g.x-cx) + (g.y-cy)*(g.y-cy)
  + (g.z-cz)*(g.z-cz)) / 8)), 6) center_heatmap FROM grid g JOIN com USING (case_id) GROUP BY ALL""", "vox", "grid"))
def centre_heatmap(spark, sf):
    grid = fx.grid(fx.cases(spark, sf)).select("case_id", "x", "y", "z")
    return rounded(targets.heatmap(grid, materialize(sizes.centres_of_mass(fx.voxels(spark, sf)), "com")))


_CLASSES = f""", {STEPS}, src AS (SELECT case_id, x, y, z FROM vox WHERE ref_id > 0), {cc_sql('cc', 'src', 'case_id', '6')},
held AS (SELECT DISTINCT cc.case_id, root, ref_id FROM cc JOIN vox USING (case_id, x, y, z)),
cf AS (SELECT DISTINCT case_id, ref_id FROM (SELECT *, count(*) OVER (PARTITION BY case_id, root) k FROM held) WHERE k > 1),
cls AS (SELECT case_id, ref_id, CASE WHEN count(*) < 20 THEN 2 ELSE 1 END s, CASE WHEN (case_id, ref_id) IN (SELECT (case_id, ref_id) FROM cf)
  THEN 2 ELSE 1 END c FROM vox WHERE ref_id > 0 GROUP BY 1, 2),
px AS (SELECT v.case_id, x, y, z, coalesce(s, 0) s, coalesce(c, 0) c, CASE WHEN s IS NULL THEN 0 ELSE (s - 1) * 2 + c END m
  FROM vox v LEFT JOIN cls USING (case_id, ref_id))"""


@query("class_maps", fx.duck(_CLASSES + """ SELECT case_id, x, y, z, CAST(s AS BIGINT) small_class, CAST(c AS BIGINT) confluent_class,
  CAST(m AS BIGINT) merged_class FROM px""", "vox", recursive=True))
def class_maps(spark, sf):
    v = fx.voxels(spark, sf)
    out = targets.class_maps(v, confluence_classes(v, fx.cases(spark, sf)), 20)
    return out.select("case_id", "x", "y", "z", "small_class", "confluent_class", "merged_class")


@query("small_object_classes", fx.duck("""SELECT case_id, x, y, z, CAST(CASE WHEN ref_id = 0 THEN 0 WHEN count(*) OVER
  (PARTITION BY case_id, ref_id) < 20 THEN 2 ELSE 1 END AS BIGINT) small_class FROM vox""", "vox"))
def small_object_classes(spark, sf):
    v = fx.voxels(spark, sf)
    return sizes.paint(v, sizes.size_classes(v, "ref_id", 20), "ref_id", "small_class").select("case_id", "x", "y", "z", "small_class")


@query("loss_weights", fx.duck(_CLASSES + """ SELECT case_id, x, y, z, CASE m WHEN 0 THEN 0.0e0 WHEN 1 THEN 1.0e0 ELSE 3.0e0 END merged,
  CASE s WHEN 2 THEN 3.0e0 ELSE CAST(s AS DOUBLE) END small, CASE c WHEN 2 THEN 1.0e0 ELSE CAST(c AS DOUBLE) END confluent FROM px""", "vox", recursive=True))
def loss_weights(spark, sf):
    maps = class_maps(spark, sf)
    return maps.select(
        "case_id", "x", "y", "z", targets.loss_weight(merged="merged_class").alias("merged"),
        targets.loss_weight(small="small_class").alias("small"), targets.loss_weight(confluent="confluent_class").alias("confluent"),
    )


# Two channels with different extents, in the order of PERM; n and t are the sizes before and after resampling.
_TWO = f""", {STEPS}, img AS MATERIALIZED (SELECT case_id, z x, x y, y z, CASE WHEN x BETWEEN case_id % 4 AND 12 AND y BETWEEN case_id % 4 AND 12
    AND z BETWEEN case_id % 4 AND 12 AND (x*5 + y*3 + z) % 11 <> 0 THEN intensity ELSE 0.0e0 END intensity,
  CASE WHEN x BETWEEN case_id % 4 AND 13 AND y BETWEEN case_id % 4 AND 12 AND z BETWEEN case_id % 4 AND 12 THEN heat ELSE 0.0e0 END flair, ref_id FROM dense),
box AS MATERIALIZED (SELECT case_id, min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz FROM img WHERE intensity <> 0 OR flair <> 0 GROUP BY 1),
dark AS MATERIALIZED (SELECT case_id, x, y, z FROM img WHERE intensity = 0 AND flair = 0),
outer_zeros AS (SELECT case_id, x, y, z FROM dark WHERE x IN (0, 15) OR y IN (0, 15) OR z IN (0, 15)
  UNION SELECT d.case_id, d.x, d.y, d.z FROM outer_zeros o JOIN steps s ON s.r = 1
    JOIN dark d ON d.case_id = o.case_id AND d.x = o.x + dx AND d.y = o.y + dy AND d.z = o.z + dz),
cut AS MATERIALIZED (SELECT i.case_id, i.x - lx x, i.y - ly y, i.z - lz z, intensity, flair, ref_id,
    CASE WHEN ref_id > 0 THEN 1 WHEN o.case_id IS NULL THEN 0 ELSE -1 END seg
  FROM img i JOIN box USING (case_id) LEFT JOIN outer_zeros o ON o.case_id = i.case_id AND o.x = i.x AND o.y = i.y AND o.z = i.z
  WHERE i.x BETWEEN lx AND hx AND i.y BETWEEN ly AND hy AND i.z BETWEEN lz AND hz),
dims AS MATERIALIZED (SELECT case_id, nx, ny, nz, CAST(round_even(nx*sz/1.0e0, 0) AS BIGINT) tx, CAST(round_even(ny*sx/1.0e0, 0) AS BIGINT) ty,
    CAST(round_even(nz*sy/1.0e0, 0) AS BIGINT) tz
  FROM (SELECT case_id, hx - lx + 1 nx, hy - ly + 1 ny, hz - lz + 1 nz FROM box) JOIN (SELECT case_id, sx, sy, sz FROM cases) USING (case_id))"""


def _reads(a: str) -> str:
    place = f"least(greatest((t + 0.5e0) * n{a} / t{a} - 0.5e0, 0), n{a} - 1)"
    return f"""lin{a} AS MATERIALIZED (SELECT case_id, s, t, 1 - abs({place} - s) w FROM dims, unnest(range(0, 16)) p(s), unnest(range(0, 40)) q(t)
  WHERE s < n{a} AND t < t{a} AND abs({place} - s) < 1),
near{a} AS MATERIALIZED (SELECT case_id, t, least(CAST(floor((t + 0.5e0) * n{a} / t{a}) AS BIGINT), n{a} - 1) s FROM dims, unnest(range(0, 40)) q(t) WHERE t < t{a})"""


def _prepared_sql(scaled: str) -> str:
    """rs: the resampled volume with seg and renumbered ref_id; data: its channels. ``scaled`` gives norm."""
    return _TWO + f""", {scaled}, {_reads('x')}, {_reads('y')}, {_reads('z')},
data AS (SELECT v.case_id, a.t x, b.t y, c.t z, sum(intensity * a.w * b.w * c.w) intensity, sum(flair * a.w * b.w * c.w) flair FROM norm v
  JOIN linx a ON a.case_id = v.case_id AND a.s = v.x JOIN liny b ON b.case_id = v.case_id AND b.s = v.y JOIN linz c ON c.case_id = v.case_id AND c.s = v.z GROUP BY ALL),
lab AS MATERIALIZED (SELECT v.case_id, a.t x, b.t y, c.t z, ref_id, seg FROM norm v JOIN nearx a ON a.case_id = v.case_id AND a.s = v.x
  JOIN neary b ON b.case_id = v.case_id AND b.s = v.y JOIN nearz c ON c.case_id = v.case_id AND c.s = v.z),
ids AS (SELECT case_id, ref_id, row_number() OVER (PARTITION BY case_id ORDER BY ref_id) id FROM (SELECT DISTINCT case_id, ref_id FROM lab WHERE ref_id > 0)),
rs AS MATERIALIZED (SELECT case_id, x, y, z, coalesce(id, 0) ref_id, seg FROM lab LEFT JOIN ids USING (case_id, ref_id)),
com AS MATERIALIZED (SELECT case_id, ref_id, avg(x) cx, avg(y) cy, avg(z) cz FROM rs WHERE ref_id > 0 GROUP BY 1, 2),
hm AS (SELECT r.case_id, avg(h) heat FROM (SELECT g.case_id, g.x, g.y, g.z, max(exp(-((g.x-cx)*(g.x-cx) + (g.y-cy)*(g.y-cy) + (g.z-cz)*(g.z-cz)) / 8)) h
  FROM rs g JOIN com USING (case_id) GROUP BY ALL) r GROUP BY 1)""" + _CLASSES.replace(f", {STEPS}", "", 1).replace("vox", "rs").replace("< 20", "< 100") + """
SELECT case_id, n, fg, outside, ids, round(heat, 6) heat, classes, round(t1, 6) + 0.0e0 t1, round(flair, 6) + 0.0e0 flair
FROM (SELECT case_id, count(*) n, count(*) FILTER (WHERE ref_id > 0) fg, count(*) FILTER (WHERE seg < 0) outside, max(ref_id) ids FROM rs GROUP BY 1)
  JOIN (SELECT case_id, CAST(sum(m) AS BIGINT) classes FROM px GROUP BY 1) USING (case_id) JOIN hm USING (case_id)
  JOIN (SELECT case_id, avg(intensity * (x + 1)) t1, avg(flair * (y + 1)) flair FROM data GROUP BY 1) USING (case_id)"""


_ZSCORED = """stat AS (SELECT case_id, avg(intensity) m1, stddev_pop(intensity) s1, avg(flair) m2, stddev_pop(flair) s2 FROM cut WHERE seg >= 0 GROUP BY 1),
norm AS MATERIALIZED (SELECT case_id, x, y, z, ref_id, seg, CASE WHEN seg >= 0 THEN (intensity - m1) / greatest(s1, 1e-8) ELSE intensity END intensity,
  CASE WHEN seg >= 0 THEN (flair - m2) / greatest(s2, 1e-8) ELSE flair END flair FROM cut JOIN stat USING (case_id))"""

_CLIPPED = """stat AS MATERIALIZED (SELECT c, avg(v) m, stddev_pop(v) s, quantile_cont(v, 0.005) lo, quantile_cont(v, 0.995) hi FROM
    (SELECT 1 c, intensity v FROM img WHERE ref_id > 0 UNION ALL SELECT 2, flair FROM img WHERE ref_id > 0) GROUP BY 1),
norm AS MATERIALIZED (SELECT case_id, x, y, z, ref_id, seg, (least(greatest(intensity, p.lo), p.hi) - p.m) / greatest(p.s, 1e-8) intensity,
  (least(greatest(flair, q.lo), q.hi) - q.m) / greatest(q.s, 1e-8) flair FROM cut JOIN stat p ON p.c = 1 JOIN stat q ON q.c = 2)"""


def _two_channels(spark, sf):
    inside = F.col("y").between(F.col("case_id") % 4, 12) & F.col("z").between(F.col("case_id") % 4, 12)
    zero, x = F.lit(0.0), F.col("x")
    lit = inside & x.between(F.col("case_id") % 4, 12) & ((x * 5 + F.col("y") * 3 + F.col("z")) % 11 != 0)
    return fx.dense(spark, sf).select(
        "case_id", "x", "y", "z", F.when(lit, F.col("intensity")).otherwise(zero).alias("intensity"),
        F.when(inside & x.between(F.col("case_id") % 4, 13), F.col("heat")).otherwise(zero).alias("flair"), "ref_id")


def _prepared(spark, sf, properties=None):
    done = prep.preprocess(_two_channels(spark, sf), fx.cases(spark, sf), PERM, (1.0, 1.0, 1.0), channels=CHANNELS, properties=properties)
    return rounded(done.voxels.groupBy("case_id").agg(
        F.count("*").alias("n"), F.sum((F.col("ref_id") > 0).cast("long")).alias("fg"), F.sum((F.col("seg") < 0).cast("long")).alias("outside"),
        F.max("ref_id").alias("ids"), F.avg("center_heatmap").alias("heat"), F.sum("merged_class").alias("classes"),
        F.avg(F.col("intensity") * (F.col("x") + 1)).alias("t1"), F.avg(F.col("flair") * (F.col("y") + 1)).alias("flair"),
    ))


CHANNELS = ("intensity", "flair")


@query("preprocess_cases", fx.duck(_prepared_sql(_ZSCORED), "dense", recursive=True))
def preprocess_cases(spark, sf):
    """The whole preprocessing of two channels, normalised case by case."""
    return _prepared(spark, sf)


@query("preprocess_by_dataset_scheme", fx.duck(_prepared_sql(_CLIPPED), "dense", recursive=True))
def preprocess_by_dataset_scheme(spark, sf):
    """The same with the dataset's foreground properties as the scheme."""
    lesions = intensity.long_channels(_two_channels(spark, sf).filter("ref_id > 0"), list(CHANNELS))
    return _prepared(spark, sf, materialize(intensity.fingerprint(lesions), "fingerprint"))


@query("preprocess_and_undo", fx.duck(_IMG + """ SELECT i.case_id, x, y, z, ref_id FROM img i JOIN box USING (case_id)
  WHERE x BETWEEN lo_x AND hi_x AND y BETWEEN lo_y AND hi_y AND z BETWEEN lo_z AND hi_z AND ref_id > 0""", "dense"))
def preprocess_and_undo(spark, sf):
    """At each case's own spacing the labels come back exactly (ids are those of the image)."""
    cases = fx.cases(spark, sf).withColumns({"sx": F.lit(1.0), "sy": F.lit(1.0), "sz": F.lit(1.0)})
    done = prep.preprocess(_image(spark, sf).drop("seg").withColumn("keep", F.col("ref_id")), cases, PERM, (1.0, 1.0, 1.0), inference=True)
    original = fx.voxels(spark, sf).select("case_id", "x", "y", "z", F.col("ref_id").alias("old"))
    back = prep.undo(done.voxels.filter("ref_id > 0").select("case_id", "x", "y", "z", "ref_id"), done, cases, PERM, [], ["ref_id"])
    return back.drop("ref_id").join(shuffled(original), ["case_id", "x", "y", "z"]).withColumnRenamed("old", "ref_id")


@query("undo_of_offsets", fx.duck(_IMG + """ SELECT i.case_id, x, y, z, 2.0e0 * (x - lo_x) ox, 1.0e0 * (z - lo_z) oy, 3.0e0 * (y - lo_y) oz
  FROM img i JOIN box USING (case_id) WHERE x BETWEEN lo_x AND hi_x AND y BETWEEN lo_y AND hi_y AND z BETWEEN lo_z AND hi_z AND ref_id > 0""", "dense"))
def undo_of_offsets(spark, sf):
    """Offset outputs in the full frame; their components are told apart by how they grow along the prepared axes."""
    cases = fx.cases(spark, sf).withColumns({"sx": F.lit(1.0), "sy": F.lit(1.0), "sz": F.lit(1.0)})
    done = prep.preprocess(_image(spark, sf).drop("seg"), cases, PERM, (1.0, 1.0, 1.0), inference=True)
    outputs = done.voxels.select("case_id", "x", "y", "z", "ref_id", F.col("x").cast("double").alias("ox"), (2.0 * F.col("y")).alias("oy"),
                                 (3.0 * F.col("z")).alias("oz"))
    back = prep.undo(outputs, done, cases, PERM, ["ox", "oy", "oz"], ["ref_id"])
    return rounded(back.filter("ref_id > 0").select("case_id", "x", "y", "z", "ox", "oy", "oz"))


@query("undo_at_changed_spacing", fx.duck(_TWO + """
SELECT c.case_id, c.y + ly x, c.z + lz y, c.x + lx z, round((""" + " + ".join(
    f"{k} * least(greatest((c.{a} + 0.5e0) * t{a} / n{a} - 0.5e0, 0), t{a} - 1)" for k, a in enumerate("xyz", 1)) + """) / 100, 6) proba
  FROM cut c JOIN box USING (case_id) JOIN dims USING (case_id)""", "dense", recursive=True))
def undo_at_changed_spacing(spark, sf):
    """Probabilities that rise along the prepared axes, brought back to each case's own grid and frame."""
    cases = fx.cases(spark, sf)
    done = prep.preprocess(_two_channels(spark, sf), cases, PERM, (1.0, 1.0, 1.0), inference=True, channels=CHANNELS)
    rising = (F.col("x") + 2 * F.col("y") + 3 * F.col("z")) / 100
    outputs = done.voxels.select("case_id", "x", "y", "z", rising.alias("proba"))
    return rounded(prep.undo(outputs, done, cases, PERM, ["proba"], []))
