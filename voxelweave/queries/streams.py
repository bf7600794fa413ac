"""Queries that run a stream over the given tables to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelweave import fixtures as fx
from voxelweave.queries.common import CLEAN, COUNTS, MATCH, rounded, scores_sql
from voxelweave.queries.registry import query
from voxelweave.session import materialize, new_path
from voxelweave.sources import voxels as vx
from voxelweave.streaming import monitor, pieces


def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return events.select(
        ((F.col("event_id") - F.col("event_id") % 50) / 50).cast("long").alias("epoch"), F.col("event_type").alias("metric"),
        F.when(F.col("user_id") % 2 == 0, "CC").otherwise("ACLS").alias("postprocessor"), "value", F.col("ts").cast("timestamp").alias("ts"),
    )


@query("stream_best_checkpoint", fx.duck("""SELECT postprocessor, metric, max("value") AS "value", arg_min(epoch, (-"value", epoch)) epoch
  FROM metrics_log GROUP BY ALL""", "metrics_log"))
def stream_best_checkpoint(spark, sf):
    out = new_path(spark, "best")
    monitor.finish(monitor.running_best, _stream(spark, sf), out, new_path(spark, "offsets"))
    return rounded(monitor.latest(spark, out, ["postprocessor", "metric"]))


# Windows are emitted once the watermark (latest time minus ten minutes) has passed their end.
_DONE = """ WHERE end_us <= (SELECT epoch_us(max(ts)) - 600000000 FROM metrics_log)"""


@query("stream_hourly_windows", fx.duck("""SELECT * FROM (SELECT epoch_us(date_trunc('hour', ts)) start_us, epoch_us(date_trunc('hour', ts)) + 3600000000 end_us,
  metric, count(*) n, round(sum("value"), 6) total FROM metrics_log GROUP BY ALL)""" + _DONE, "metrics_log"))
def stream_hourly_windows(spark, sf):
    out = new_path(spark, "hours")
    monitor.finish(monitor.windowed_summary, _stream(spark, sf), out, new_path(spark, "offsets"))
    return rounded(spark.read.parquet(out).drop("batch"))


@query("stream_sliding_windows", fx.duck("""SELECT * FROM (SELECT s start_us, s + 7200000000 end_us, metric, count(*) n, round(sum("value"), 6) total FROM
  (SELECT metric, "value", epoch_us(date_trunc('hour', ts)) - k * 3600000000 s FROM metrics_log, unnest([0, 1]) t(k)) GROUP BY ALL)""" + _DONE, "metrics_log"))
def stream_sliding_windows(spark, sf):
    out = new_path(spark, "sliding")
    monitor.finish(monitor.windowed_summary, _stream(spark, sf), out, new_path(spark, "offsets"), "2 hours", "1 hour")
    return rounded(spark.read.parquet(out).drop("batch"))


@query("stream_sessions", fx.duck(""", g AS (SELECT *, epoch_us(ts) t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY metric ORDER BY ts)
  < 7200000000 THEN 0 ELSE 1 END fresh FROM metrics_log),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY metric ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g)
SELECT * FROM (SELECT min(t) start_us, max(t) + 7200000000 end_us, metric, count(*) n, round(sum("value"), 6) total FROM s GROUP BY metric, k)""" + _DONE, "metrics_log"))
def stream_sessions(spark, sf):
    out = new_path(spark, "sessions")
    monitor.finish(monitor.session_summary, _stream(spark, sf), out, new_path(spark, "offsets"))
    return rounded(spark.read.parquet(out).drop("batch"))


@query("stream_case_scores", fx.duck(CLEAN + MATCH + COUNTS + f""" SELECT case_id, tp "TP", fp "FP", fn "FN", {scores_sql('DSC', 'PQ', 'F1')}
  FROM counts WHERE case_id IN (SELECT case_id FROM gappy WHERE pred_id > 0)""", "vox", "gappy", "cases"))
def stream_case_scores(spark, sf):
    """Predictions land as files of whole cases and are scored batch by batch."""
    v = fx.gappy(spark, sf)
    landing, out = new_path(spark, "landing"), new_path(spark, "scores")
    preds = v.filter("pred_id > 0").select("case_id", "x", "y", "z", "pred_id")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    preds.repartition(files, "case_id").write.parquet(landing)
    # Two batches, however many files the tables need.
    arriving = spark.readStream.schema(preds.schema).option("maxFilesPerTrigger", (files + 1) // 2).parquet(landing)
    stored = new_path(spark, "references")
    vx.write(v.filter("ref_id > 0").select("case_id", "x", "y", "z", "ref_id"), stored, 64)
    refs = spark.read.parquet(stored)
    monitor.finish(monitor.score_arrivals, arriving, refs, fx.cases(spark, sf), out, new_path(spark, "offsets"), 64)
    return rounded(spark.read.parquet(out).drop("batch"))


@query("stream_cases_in_pieces", fx.duck(CLEAN + MATCH + COUNTS + f""" SELECT case_id, true complete, pieces, tp "TP", fp "FP", fn "FN",
  {scores_sql('DSC', 'PQ', 'F1')} FROM counts JOIN (SELECT case_id, count(DISTINCT z % 3) pieces FROM gappy WHERE pred_id > 0 GROUP BY 1) USING (case_id)""",
  "vox", "gappy", "cases"))
def stream_cases_in_pieces(spark, sf):
    """Every case comes in up to three pieces and is scored once; after each piece both streams go on from where they stopped."""
    v = fx.gappy(spark, sf)
    landing, parts, out, stored, one, two = (new_path(spark, n) for n in ("landing", "parts", "scores", "references", "offsets", "offsets"))
    preds = v.filter("pred_id > 0").select("case_id", "x", "y", "z", "pred_id")
    preds = preds.join(preds.groupBy("case_id").agg(F.count("*").alias("declared")), "case_id").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    preds = materialize(preds, "predictions")
    vx.write(v.filter("ref_id > 0").select("case_id", "x", "y", "z", "ref_id"), stored, 64)
    refs = spark.read.parquet(stored)
    for piece in range(3):
        preds.filter(F.col("z") % 3 == piece).write.mode("append").parquet(landing)
        monitor.finish(pieces.count_arrivals, spark.readStream.schema(preds.schema).parquet(landing), refs, parts, one, 64)
        monitor.finish(pieces.score_closed, pieces.arrived_pieces(spark, parts), refs, fx.cases(spark, sf), out, two, 64)
    return rounded(spark.read.parquet(out).drop("batch"))
