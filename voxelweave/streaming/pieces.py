"""Scoring of cases whose predictions arrive in pieces.

Two streams follow each other. The first counts what arrived: each batch is
aligned with the references of its cases and becomes one row for each case, its
overlap counts. The second keeps a case's counts as state over batches and
restarts until as many voxels as declared have come, or until the watermark is
so far past its last piece that the wait ends; then the case is scored, once.

A row of counts carries the number of its batch, and the state remembers the
numbers it holds, so a batch that is written again after a failure adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voxelweave.operators import metrics, overlap, sizes
from voxelweave.operators.overlap import COORDS
from voxelweave.session import materialize, ship_package, shuffled
from voxelweave.sources.voxels import BUCKETS, of_cases

PIECES = "case_id long, ts timestamp, declared long, n long, pairs array<struct<pred_id: long, ref_id: long, n: long>>, batch long"
#: Of the cases of a group, one entry for each.
STATE = """cases array<long>, closed array<boolean>, last array<long>, until array<long>, declared array<long>, received array<long>,
  batches array<array<long>>, counts array<array<long>>"""
CLOSED = "case_id long, complete boolean, pieces long, pred array<long>, ref array<long>, n array<long>"
GROUPS = 1024


def count_arrivals(predictions: DataFrame, references: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Writes one row of overlap counts for each case of each batch.

    ``predictions`` has case_id, x, y, z, pred_id, the time ``ts`` and ``declared``,
    the number of predicted voxels that its case will have. Only the buckets of the batch's cases
    are read from stored references.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch, "arrived")
        arrived = materialize(batch.select("case_id").distinct(), "arrived-cases")
        known = of_cases(references, arrived, buckets).drop("case_bucket")
        aligned = batch.join(shuffled(known), ["case_id", *COORDS], "left")
        pairs = aligned.groupBy("case_id", "pred_id", F.coalesce("ref_id", F.lit(0).cast("long")).alias("ref_id")).agg(
            F.count("*").alias("n"), F.max("ts").alias("ts"), F.max("declared").alias("declared"))
        rows = pairs.groupBy("case_id").agg(
            F.max("ts").alias("ts"), F.max("declared").alias("declared"), F.sum("n").alias("n"), F.collect_list(F.struct("pred_id", "ref_id", "n")).alias("pairs"))
        rows.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/part={batch_id}")

    return predictions.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrived_pieces(spark: SparkSession, path: str, files_each: int | None = None) -> DataFrame:
    """The rows of :func:`count_arrivals` as a stream."""
    reader = spark.readStream.schema(PIECES).option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", files_each) if files_each else reader).parquet(path)


@dataclass
class _Case:
    """A case while it waits, or after it was scored; ``until`` is when the wait, or the memory of it, ends."""

    closed: bool = False
    last: int = 0
    until: int = 0
    declared: int = 0
    received: int = 0
    batches: list[int] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)  # pred, ref, n of every pair in turn


def _add(case: _Case, batch: int, at: int, declared: int, received: int, pred, ref, n) -> None:
    counts = {(p, r): m for p, r, m in zip(case.counts[::3], case.counts[1::3], case.counts[2::3])}
    for p, r, m in zip(pred.tolist(), ref.tolist(), n.tolist()):
        counts[p, r] = counts.get((p, r), 0) + m
    case.counts = [v for (p, r), m in counts.items() for v in (p, r, m)]
    case.batches.append(batch)
    case.last, case.declared, case.received = max(case.last, at), max(case.declared, declared), case.received + received


def _merge(patience_ms: int, forget_ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {case: _Case(*kept) for case, *kept in zip(*state.get)} if state.exists else {}
        now, met, done = state.getCurrentWatermarkMs(), {}, []

        def close(number: int, case: _Case, complete: bool) -> None:
            done.append((number, complete, len(case.batches), case.counts[::3], case.counts[1::3], case.counts[2::3]))
            # Until it is forgotten, what comes late is not a new case.
            held[number] = _Case(True, case.last, max(case.last, now) + forget_ms)

        for frame in () if state.hasTimedOut else frames:
            for number, batch, ts, *told in zip(*[frame[c] for c in ("case_id", "batch", "ts", "declared", "n", "pred", "ref", "m")]):
                case = met[number] = held.setdefault(number, _Case())
                if not case.closed and batch not in case.batches:
                    _add(case, int(batch), int(ts.timestamp() * 1000), int(told[0]), int(told[1]), *told[2:])
        for number, case in met.items():
            if not case.closed and case.received >= case.declared:
                close(number, case, True)
            else:
                case.until = max(case.last, now) + (forget_ms if case.closed else patience_ms)
        for number, case in [(k, c) for k, c in held.items() if c.until < now]:
            if case.closed:
                del held[number]
            else:
                close(number, case, False)
        if held:
            kept = [[getattr(c, f.name) for c in held.values()] for f in fields(_Case)]
            state.update(([int(k) for k in held], *kept))
            state.setTimeoutTimestamp(min(c.until for c in held.values()))
        else:
            state.remove()
        if done:
            yield pd.DataFrame(done, columns=["case_id", "complete", "pieces", "pred", "ref", "n"])

    return run


def close_cases(pieces: DataFrame, patience_ms: int, forget_ms: int, delay: str, groups: int = GROUPS) -> DataFrame:
    """One row for each case as it closes, with its overlap counts.

    A case closes when all declared voxels came, or incomplete when the watermark,
    ``delay`` behind the latest time, is ``patience_ms`` past its last piece. What
    comes for a closed case is left out for ``forget_ms``. Python is called for each
    of ``groups`` groups of cases that a batch meets, since a call for each case takes
    longer than its counts.
    """
    ship_package(pieces.sparkSession)
    parted = pieces.withWatermark("ts", delay).select(
        F.pmod(F.xxhash64("case_id"), F.lit(groups)).alias("part"), "case_id", "ts", "declared", "n", "batch",
        F.col("pairs.pred_id").alias("pred"), F.col("pairs.ref_id").alias("ref"), F.col("pairs.n").alias("m"))
    return parted.groupBy("part").applyInPandasWithState(
        _merge(patience_ms, forget_ms), CLOSED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def contingency_of(closed: DataFrame, references: DataFrame) -> DataFrame:
    """The contingency table of closed cases: their pairs, and the reference voxels that no prediction met."""
    pairs = closed.select("case_id", F.explode(F.arrays_zip("pred", "ref", "n")).alias("p")).select(
        "case_id", F.col("p.pred").alias("pred_id"), F.col("p.ref").alias("ref_id"), F.col("p.n").alias("n"))
    met = pairs.filter("ref_id > 0").groupBy("case_id", "ref_id").agg(F.sum("n").alias("met"))
    whole = references.filter("ref_id > 0").groupBy("case_id", "ref_id").agg(F.count("*").alias("all"), *overlap.bounds())
    left = whole.join(met, ["case_id", "ref_id"], "left").withColumn("n", F.col("all") - F.coalesce("met", F.lit(0).cast("long")))
    left = left.withColumn("pred_id", F.lit(0).cast("long")).drop("all", "met")
    # The remainder carries the box of its whole reference.
    return left.unionByName(pairs, allowMissingColumns=True)


def score_closed(pieces: DataFrame, references: DataFrame, cases: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS,
                 patience_ms: int = 3_600_000, forget_ms: int = 7 * 86_400_000, delay: str = "1 hour") -> StreamingQuery:
    """Scores each case when it closes: case_id, complete, pieces, TP, FP, FN, DSC, PQ, F1."""

    def score(batch: DataFrame, batch_id: int) -> None:
        closed = materialize(batch, "closed")
        here = cases.join(closed.select("case_id"), "case_id", "left_semi")
        table = contingency_of(closed, of_cases(references, closed, buckets).drop("case_bucket"))
        table = materialize(sizes.drop_small(table, here, "ref_id"), "closed-pairs")
        scored = metrics.score(metrics.case_table(here, table, overlap.match(table)), ["DSC", "PQ", "F1"])
        scored = scored.join(closed.select("case_id", "complete", "pieces"), "case_id")
        scored.select("case_id", "complete", "pieces", "TP", "FP", "FN", "DSC", "PQ", "F1").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return close_cases(pieces, patience_ms, forget_ms, delay).writeStream.foreachBatch(score).option(
        "checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
