"""Incremental scoring and monitoring with Structured Streaming.

Every query keeps its offsets in a checkpoint folder and writes each batch under
its batch number, so a batch that is run again after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxelweave.operators import metrics, overlap, sizes
from voxelweave.session import materialize
from voxelweave.sources.voxels import BUCKETS, of_cases


def score_arrivals(predictions: DataFrame, references: DataFrame, cases: DataFrame, path: str, checkpoint: str,
                   buckets: int = BUCKETS) -> StreamingQuery:
    """Scores cases as their predictions land; a file holds whole cases, so batches need no shared state.

    Stored references that carry ``case_bucket`` are read for the arrived cases'
    buckets only. :func:`split_cases` lists the cases that came in pieces.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch, "arrived")
        arrived = materialize(batch.select("case_id").distinct(), "arrived-cases")
        here = cases.join(arrived, "case_id", "left_semi")
        known = of_cases(references, arrived, buckets).drop("case_bucket")
        table = materialize(sizes.drop_small(overlap.contingency(overlap.align(batch, known)), here, "ref_id"), "arrived-pairs")
        scored = metrics.score(metrics.case_table(here, table, overlap.match(table)), ["DSC", "PQ", "F1"])
        scored.select("case_id", "TP", "FP", "FN", "DSC", "PQ", "F1").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return predictions.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases that were scored in several batches, each time with a part of their predictions: (case_id, batches)."""
    return spark.read.parquet(path).groupBy("case_id").agg(F.countDistinct("batch").alias("batches")).filter("batches > 1")


def running_best(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Best value and its epoch so far per post-processor and metric; the earliest epoch wins a tie."""
    best = log.groupBy("postprocessor", "metric").agg(F.max(F.struct("value", (-F.col("epoch")).alias("e"))).alias("b")).select(
        "postprocessor", "metric", F.col("b.value").alias("value"), (-F.col("b.e")).alias("epoch")
    )
    return _by_batch(best, "update", path, checkpoint)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current state of an update-mode result: the last batch that holds each key."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max(F.struct("batch", *others)).alias("r"))
    return newest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def windowed_summary(log: DataFrame, path: str, checkpoint: str, window: str = "1 hour", slide: str | None = None,
                     delay: str = "10 minutes") -> StreamingQuery:
    """Count and sum per metric in tumbling or sliding windows; rows later than ``delay`` are dropped."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    sums = log.withWatermark("ts", delay).groupBy(span.alias("w"), "metric").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return _by_batch(_flat(sums), "append", path, checkpoint)


def session_summary(log: DataFrame, path: str, checkpoint: str, gap: str = "2 hours", delay: str = "10 minutes") -> StreamingQuery:
    """Count and sum per metric in sessions that a ``gap`` of silence ends."""
    sums = log.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "metric").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )
    return _by_batch(_flat(sums), "append", path, checkpoint)


def _flat(sums: DataFrame) -> DataFrame:
    return sums.select(
        F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "metric", "n", "total"
    )


def _by_batch(df: DataFrame, mode: str, path: str, checkpoint: str) -> StreamingQuery:
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish(start: Callable[..., StreamingQuery], *args, **options) -> None:
    """Runs a query over what has arrived and waits for it."""
    start(*args, **options).awaitTermination()
