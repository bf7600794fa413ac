"""Quality scores by Bradley-Terry ranking of preference pairs.

Labelled documents give pairs: a good one is preferred to a bad one. The strength
of a document is a weighted sum of features of its whole text; the weights
minimise the logistic loss of feature differences over the pairs. The threshold
is the quantile of the training strengths at the share of bad documents, and the
score puts it at 0.7.

The model is fitted on all labelled rows but the held out ones, whose crc32 of the
id as text leaves 2 modulo 4. They are dealt to blocks by a hash of the id; pairs
are drawn inside a block so that every row is in some. Each Newton step is a pass
over the blocks that sums slopes and curvatures; the quantile is exact.

Defined cases: a null text counts as empty and is scored like any text; a null
id counts as the text ``''`` and is never labelled; a document with several
labels has the highest; a repeated id counts once, with its smallest features;
without labels of both kinds every score is 0.7; all
input columns stay, except that ``held_out``, ``score`` and ``predicted`` replace
columns of these names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelweave.llm.words import for_texts
from voxelweave.session import materialize

BLOCK_ROWS = 256
FEWEST = 16  # rows of either label in a block, on average
PAIRS_EACH = 8
THRESHOLD = 0.7
LETTERS = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
BLANKS = b" \t\n\x0b\x0c\r"
PLAIN = b".,;:'\"()-?"


def features(text: bytes) -> list[float]:
    """Shares and lengths over the whole text, none of them dependent on its language."""
    words = text.split()
    n, m = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split(b"\n") if x]
    distinct = len(set(words)) / m
    symbols = len(text.translate(None, LETTERS + BLANKS + PLAIN)) / n
    upper = (len(text) - len(text.translate(None, bytes(range(65, 91))))) / n
    digits = (len(text) - len(text.translate(None, b"0123456789"))) / n
    length = n / m
    twice = sum(a == b for a, b in zip(words, words[1:])) / m
    again = 1 - len(set(lines)) / max(1, len(lines))
    # Texts of many words repeat some of them; what is missing against that is what counts.
    expected = 1.05 - 0.055 * np.log(m)
    return [
        min(symbols, 0.1) * 10, min(max(symbols - 0.015, 0), 0.05) * 20, min(upper, 0.5), float(upper > 0.25 and m > 3),
        min(digits, 0.3), max(0.0, expected - distinct), float(distinct < 0.6 * expected), min(twice, 0.3) * 3,
        float(twice > 0.12), again, float(again > 0.34), max(0.0, length - 7.5), max(0.0, 5.2 - length) * (m > 12), np.log1p(m) / 10,
    ]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    cut: float
    slope: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        strength = (rows - self.centre) / self.spread @ self.weights
        high = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.slope * (strength - self.cut) + high, -500, 500)))


def pairs(rows: np.ndarray, labels: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Feature differences (good less bad); every row is in ``PAIRS_EACH`` pairs at least."""
    good, bad = rows[labels == 1], rows[labels == 0]
    most = max(len(good), len(bad)) if len(good) and len(bad) else 0
    turns = [good[np.resize(draw.permutation(len(good)), most)] - bad[np.resize(draw.permutation(len(bad)), most)] for _ in range(PAIRS_EACH)]
    return np.concatenate(turns)


def _summed(blocks: DataFrame, part: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``part`` of (block, features, labels, first places); a task sends one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block, rows, labels, first in _unpacked(batches):
            v = part(block, rows, labels, first)
            total = v if total is None else total + v
        if total is not None:
            yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    got = blocks.mapInArrow(run, "v array<double>").collect()
    return np.sum(sorted([r["v"] for r in got]), axis=0)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            held = batch.column("rows")[i].values
            x = held.field("x").flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)
            yield batch.column("block")[i].as_py(), x, held.field("y").to_numpy(zero_copy_only=False), held.field("first").to_numpy(zero_copy_only=False)


def _blocks(rows: DataFrame, n: int, few: int, rarer: int) -> DataFrame:
    """block, rows. Rows of a rare label are repeated over several blocks, so that no block lacks one."""
    count = -(-n // BLOCK_ROWS)
    while True:
        copies = min(count, max(1, -(-FEWEST * count // few)))
        turn = F.explode(F.sequence(F.lit(0), F.when(F.col("y") == rarer, copies - 1).otherwise(0)))
        dealt = rows.withColumn("turn", turn).withColumn("block", F.pmod(F.xxhash64("id") + F.col("turn"), F.lit(count)))
        held = F.sort_array(F.collect_list(F.struct("id", "y", (F.col("turn") == 0).alias("first"), "x")))
        blocks = materialize(dealt.groupBy("block").agg(held.alias("rows")).sortWithinPartitions("block"), "quality-blocks")
        if count == 1 or blocks.filter("array_min(rows.y) = array_max(rows.y)").isEmpty():
            return blocks
        count //= 2


def _of_rank(values: DataFrame, rank: int, bins: int = 1000) -> float:
    """The value ``s`` with that many values before it: counts by bin, then only the bin that holds it."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    while low < high:
        at = F.least(F.floor((F.col("s") - low) / F.lit(high - low) * bins), F.lit(bins - 1))
        here = values.filter(F.col("s").between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("s").alias("a"), F.max("s").alias("b"))
        for r in here.orderBy("bin").collect():  # at most ``bins``
            low, high = r["a"], r["b"]
            if rank < r["n"]:
                break
            rank -= r["n"]
    return low


def fit(rows: DataFrame, steps: int = 40, decay: float = 1e-3, seed: int = 5) -> Model:
    """Newton steps on the mean logistic loss over pairs, from all of ``rows`` (id, y, x)."""
    width = len(features(b""))
    known = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not known.get(0) or not known.get(1):
        return Model(np.zeros(width), np.zeros(width), np.ones(width), 0.0, 1.0)
    n, rarer = known[0] + known[1], int(known[1] < known[0])
    blocks = _blocks(rows, n, known[rarer], rarer)
    sums = _summed(blocks, lambda block, x, y, first: np.concatenate([x[first].sum(axis=0), (x[first] ** 2).sum(axis=0)]))
    # Rounded, because tasks may add in another order.
    centre = np.round(sums[:width] / n, 12)
    spread = np.round(np.sqrt(np.maximum(sums[width:] / n - (sums[:width] / n) ** 2, 0)), 9) + 1e-6
    weights = np.zeros(width)

    def part(block: int, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
        diff = pairs(x, y, np.random.default_rng([seed, block])) / spread
        p = 1 / (1 + np.exp(np.clip(diff @ weights, -60, 60)))  # how surprising each preference is
        return np.concatenate([[len(diff)], diff.T @ p, ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()])

    for _ in range(steps):
        sums = _summed(blocks, part)
        slope = -sums[1:width + 1] / sums[0] + decay * weights
        bend = sums[width + 1:].reshape(width, width) / sums[0] + decay * np.eye(width)
        step = np.linalg.solve(bend, slope)
        weights = weights - step * min(1.0, 4 / (np.linalg.norm(step) + 1e-12))
        if np.linalg.norm(slope) < 1e-8:
            break
    weights = np.round(weights, 9)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, _, first in _unpacked(batches):
            yield pa.record_batch([pa.array((x[first] - centre) / spread @ weights)], names=["s"])

    values = materialize(blocks.mapInArrow(strengths, "s double"), "quality-strengths")
    at = min(n - 1, known[0])
    before = _of_rank(values, max(0, at - 1))
    after = values.agg(F.count(F.when(F.col("s") <= before, 1)).alias("n"), F.min(F.when(F.col("s") > before, F.col("s"))).alias("next")).first()
    cut = (before + (before if after["n"] > at else after["next"])) / 2
    return Model(weights, centre, spread, float(cut), 1.0)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _feature_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x or b"") for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    for_texts(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.filter("id IS NOT NULL AND y IN (0, 1)").filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    number = F.col(f"`{id_col}`").cast("long")
    some = docs.filter(number.isNotNull() & ~held_out(number))
    # Features before the join: they are smaller than the texts.
    rows = _feature_rows(some, f"`{id_col}`", f"`{text_col}`").groupBy("id").agg(F.min("x").alias("x"))
    return fit(materialize(rows.join(known, "id").select("id", "y", "x"), "quality-rows"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents with held_out, score and predicted."""
    for_texts(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name not in ("held_out", "score", "predicted")]
    extra = [T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features((x.as_py() or b"")) for x in batch.column(read).cast(pa.binary())]).reshape(batch.num_rows, -1)
            scores = model.score(rows) if len(rows) else np.zeros(0)
            yield pa.record_batch([
                *[batch.column(f.name) for f in keep], batch.column("__held"), pa.array(scores),
                pa.array((scores >= THRESHOLD).astype(np.int32)),
            ], names=[*[f.name for f in keep], "held_out", "score", "predicted"])

    given = any(f.name == text_col and isinstance(f.dataType, T.StringType) for f in keep)
    read = text_col if given else "__text"
    rows = docs.select(*[F.col(f"`{f.name}`") for f in keep], *([] if given else [F.col(text_col).cast("string").alias("__text")]),
                       held_out(F.col(id_col)).alias("__held"))
    return rows.mapInArrow(run, T.StructType([*keep, *extra]))
