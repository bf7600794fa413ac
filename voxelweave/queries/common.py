"""Shared parts of the registered queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, because two engines add in different orders."""
    return df.select(*[
        (F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType))
        else F.col(f.name)
        for f in df.schema.fields
    ])


KEY_SQL = "(x * 1099511627776 + y * 1048576 + z)"

STEPS = """steps AS (SELECT dx, dy, dz, abs(dx)+abs(dy)+abs(dz) r FROM unnest(range(-1,2)) a(dx), unnest(range(-1,2)) b(dy),
  unnest(range(-1,2)) c(dz) WHERE abs(dx)+abs(dy)+abs(dz) > 0)"""


def cc_sql(name: str, source: str, keys: str, conn: str) -> str:
    """CTEs that give {name}(keys, x, y, z, k, root): components of ``source(keys, x, y, z)``.

    ``conn`` is an expression over the alias ``a``; the query must declare STEPS and RECURSIVE.
    """
    ks = [k.strip() for k in keys.split(",")]
    same = lambda p, q: " AND ".join(f"{p}.{k} = {q}.{k}" for k in ks)
    a = ", ".join(f"a.{k}" for k in ks)
    r = ", ".join(f"r.{k}" for k in ks)
    return f"""{name}_n AS MATERIALIZED (SELECT DISTINCT {keys}, x, y, z, {KEY_SQL} k FROM {source}),
{name}_e AS MATERIALIZED (SELECT {a}, a.k u, b.k v FROM {name}_n a
  JOIN steps s ON s.r <= CASE {conn} WHEN 6 THEN 1 WHEN 18 THEN 2 ELSE 3 END
  JOIN {name}_n b ON {same('a', 'b')} AND b.x = a.x + s.dx AND b.y = a.y + s.dy AND b.z = a.z + s.dz),
{name}_s AS (SELECT * FROM {name}_n a WHERE NOT EXISTS (SELECT 1 FROM {name}_e e WHERE {same('a', 'e')} AND e.u = a.k AND e.v < a.k)),
{name}_r AS (SELECT {keys}, k, k AS root FROM {name}_s
  UNION SELECT {r}, e.v, r.root FROM {name}_r r JOIN {name}_e e ON {same('r', 'e')} AND e.u = r.k),
{name} AS MATERIALIZED (SELECT {keys}, n.x, n.y, n.z, k, root FROM {name}_n n
  JOIN (SELECT {keys}, k, min(root) root FROM {name}_r GROUP BY ALL) m USING ({keys}, k))"""


# Small references removed, then overlap and matching, over the case table.
CLEAN = """, inst_r AS (SELECT case_id, ref_id, count(*) n, max(x)-min(x)+1 ex, max(y)-min(y)+1 ey, max(z)-min(z)+1 ez
  FROM gappy WHERE ref_id > 0 GROUP BY 1, 2),
small AS (SELECT i.case_id, i.ref_id FROM inst_r i JOIN cases c USING (case_id)
  WHERE ex*sx < 3 OR ey*sy < 3 OR ez*sz < 3 OR n*sx*sy*sz <= 14),
v AS MATERIALIZED (SELECT g.case_id, x, y, z, CASE WHEN s.ref_id IS NULL THEN g.ref_id ELSE 0 END ref_id, pred_id
  FROM gappy g LEFT JOIN small s ON g.case_id = s.case_id AND g.ref_id = s.ref_id)"""

RAW = ", v AS (SELECT * FROM gappy)"

MATCH = """, np AS (SELECT case_id, pred_id, count(*) n_pred FROM v WHERE pred_id > 0 GROUP BY 1, 2),
nr AS (SELECT case_id, ref_id, count(*) n_ref FROM v WHERE ref_id > 0 GROUP BY 1, 2),
pairs AS MATERIALIZED (SELECT o.*, n_pred, n_ref, CAST(inter AS DOUBLE) / (n_pred + n_ref - inter) iou,
    2.0e0 * inter / (n_pred + n_ref) dice
  FROM (SELECT case_id, pred_id, ref_id, count(*) inter FROM v WHERE pred_id > 0 AND ref_id > 0 GROUP BY 1, 2, 3) o
  JOIN np USING (case_id, pred_id) JOIN nr USING (case_id, ref_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, pred_id ORDER BY iou DESC, ref_id) rn FROM pairs)
  WHERE rn = 1 AND iou > 0.1),
matches AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY case_id, ref_id ORDER BY iou DESC, pred_id) = 1 kept FROM best)"""

COUNTS = """, counts AS MATERIALIZED (SELECT case_id, nx*ny*nz n_all, coalesce(a.inter, 0) inter, coalesce(a.n_pred, 0) n_pred,
  coalesce(a.n_ref, 0) n_ref, coalesce(n_pred_inst, 0) n_pred_inst, coalesce(n_ref_inst, 0) n_ref_inst,
  coalesce(tp, 0) tp, coalesce(n_pred_inst, 0) - coalesce(tp, 0) fp, coalesce(n_ref_inst, 0) - coalesce(tp, 0) fn,
  coalesce(fp_clu, 0) fp_clu, coalesce(sum_iou, 0) sum_iou, mean_dice
  FROM cases LEFT JOIN (SELECT case_id, count(*) FILTER (WHERE pred_id > 0 AND ref_id > 0) inter,
      count(*) FILTER (WHERE pred_id > 0) n_pred, count(*) FILTER (WHERE ref_id > 0) n_ref,
      count(DISTINCT pred_id) FILTER (WHERE pred_id > 0) n_pred_inst,
      count(DISTINCT ref_id) FILTER (WHERE ref_id > 0) n_ref_inst FROM v GROUP BY 1) a USING (case_id)
  LEFT JOIN (SELECT case_id, count(*) FILTER (WHERE kept) tp, count(*) FILTER (WHERE NOT kept) fp_clu,
      sum(iou) FILTER (WHERE kept) sum_iou, avg(dice) FILTER (WHERE kept) mean_dice FROM matches GROUP BY 1) m USING (case_id))"""


def pq_sql(sum_iou: str, tp: str, fp: str, fn: str, n_pred: str, n_ref: str) -> str:
    return (
        f"CASE WHEN {n_pred} = 0 AND {n_ref} = 0 THEN 1.0e0 WHEN {n_ref} = 0 AND {fp} > 0 THEN 0.0e0 "
        f"WHEN {n_pred} = 0 AND {fn} > 0 THEN 0.0e0 ELSE ({sum_iou} / greatest({tp}, 1e-6)) * "
        f"({tp} / greatest({tp} + 0.5e0*{fp} + 0.5e0*{fn}, 1e-6)) END"
    )


def rate_sql(tp: str, missed: str) -> str:
    return f"CASE WHEN {tp} = 0 AND {missed} = 0 THEN 1.0e0 ELSE {tp} / ({tp} + {missed} + 1e-6) END"


SCORES = {
    "DSC": "CASE WHEN n_pred + n_ref = 0 THEN 1.0e0 ELSE 2.0e0*inter/(n_pred + n_ref) END",
    "nDSC": "CASE WHEN n_pred + n_ref = 0 THEN 1.0e0 ELSE 2.0e0*inter / ((CASE WHEN n_ref = 0 THEN 1.0e0 ELSE "
            "0.999e0*n_ref/(0.001e0*(n_all - n_ref)) END)*(n_pred - inter) + 2.0e0*inter + (n_ref - inter)) END",
    "Dice_Per_TP": "coalesce(mean_dice, 0.0e0)",
    "PQ": pq_sql("sum_iou", "tp", "fp", "fn", "n_pred_inst", "n_ref_inst"),
    "F1": "2.0e0 * ((tp/(tp+fp+1e-6)) * (tp/(tp+fn+1e-6))) / ((tp/(tp+fp+1e-6)) + (tp/(tp+fn+1e-6)) + 1e-6)",
    "Recall": rate_sql("tp", "fn"),
    "Precision": rate_sql("tp", "fp"),
    "FPR": "fp / (n_pred_inst + 1e-6)",
    "DiC": "CAST(abs(n_pred_inst - n_ref_inst) AS DOUBLE)",
}


def scores_sql(*names: str) -> str:
    return ", ".join(f'round({SCORES[n]}, 6) + 0.0e0 AS "{n}"' for n in names)


VARIANTS_SQL = "variants AS (SELECT CAST(t AS BIGINT) tier, CAST(c AS BIGINT) conn FROM unnest([0, 1]) a(t), unnest([6, 26]) b(c))"

# Voxels of every variant's mask (tier 1 grown by the cross), then components and shared ids.
CONFLUENT = f""", {STEPS}, {VARIANTS_SQL},
grown AS (SELECT DISTINCT r.case_id, r.x + s.dx x, r.y + s.dy y, r.z + s.dz z FROM v r
  JOIN (SELECT dx, dy, dz FROM steps WHERE r = 1 UNION ALL SELECT 0, 0, 0) s ON r.ref_id > 0),
mask AS (SELECT case_id, tier, conn, x, y, z FROM v, variants WHERE ref_id > 0 AND tier = 0
  UNION ALL SELECT g.case_id, tier, conn, x, y, z FROM grown g JOIN cases c USING (case_id), variants
  WHERE tier = 1 AND x >= 0 AND y >= 0 AND z >= 0 AND x < nx AND y < ny AND z < nz),
{cc_sql('cc', 'mask', 'case_id, tier, conn', 'a.conn')},
held AS (SELECT DISTINCT cc.case_id, tier, conn, root, v.ref_id FROM cc JOIN v ON cc.case_id = v.case_id AND cc.x = v.x
  AND cc.y = v.y AND cc.z = v.z WHERE v.ref_id > 0),
confluent AS MATERIALIZED (SELECT DISTINCT case_id, tier, conn, ref_id FROM (SELECT *, count(*) OVER
  (PARTITION BY case_id, tier, conn, root) k FROM held) WHERE k > 1)"""

CLU = f""", cl_best AS (SELECT * FROM (SELECT p.*, tier, conn, row_number() OVER (PARTITION BY p.case_id, tier, conn, pred_id
    ORDER BY iou DESC, p.ref_id) rn FROM pairs p JOIN confluent c ON p.case_id = c.case_id AND p.ref_id = c.ref_id)
    WHERE rn = 1 AND iou > 0.1),
cl_kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, tier, conn, ref_id ORDER BY iou DESC, pred_id) r2
    FROM cl_best) WHERE r2 = 1),
clu0 AS (SELECT c.case_id, w.tier, w.conn, fp_clu, n_pred_inst, coalesce(n_cl, 0) n_cl, coalesce(m.tp, 0) tp,
    coalesce(n_cl, 0) - coalesce(m.tp, 0) fn, coalesce(m.s, 0) s, m.d
  FROM counts c CROSS JOIN variants w
  LEFT JOIN (SELECT case_id, tier, conn, count(*) n_cl FROM confluent GROUP BY 1, 2, 3) n
    ON n.case_id = c.case_id AND n.tier = w.tier AND n.conn = w.conn
  LEFT JOIN (SELECT case_id, tier, conn, count(*) tp, sum(iou) s, avg(dice) d FROM cl_kept GROUP BY 1, 2, 3) m
    ON m.case_id = c.case_id AND m.tier = w.tier AND m.conn = w.conn),
clu1 AS (SELECT *, {rate_sql('tp', 'fn')} r, CASE WHEN n_cl = 0 AND fp_clu = 0 THEN 1.0e0 ELSE tp/(tp + fp_clu + 1e-6) END p,
    {pq_sql('s', 'tp', 'fp_clu', 'fn', 'n_pred_inst', 'n_cl')} q FROM clu0),
clu AS MATERIALIZED (SELECT case_id, tier, conn, n_cl "CLU_Count", tp "TP_CLU", fn "FN_CLU", 2.0e0*(r*p)/(r+p+1e-6) "F1_CLU",
    r "Recall_CLU", p "Precision_CLU", CASE WHEN n_cl > 0 THEN coalesce(d, 0.0e0) END "Dice_Per_TP_CLU", q "PQ_CLU" FROM clu1)"""
