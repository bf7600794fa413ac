"""Exact top-k search by inner product with a KD-tree for each shard.

A KD-tree of median splits over a bounded sample (``SAMPLE_ROWS`` vectors, at most
``CELLS`` leaves) deals out all vectors to cells; a cell is one shard, or several
of bounded size. A cell's tight box is that of all its vectors. A task builds the
KD-tree of a shard (median splits along the widest side, tight bounding boxes) and
streams the queries past it, batch by batch. The search is best-first: each query
opens the box with the highest possible score, and stops when no open box can reach
its kth score. A first pass meets each query with one shard of its own cell only;
the kth score found there goes with the query to the shards of all cells whose box
can reach it. Where vectors cluster these are few; where no box can be ruled out,
every query meets every shard.

Defined cases: a vector that is null or holds a null, NaN or infinite component
takes no part, nor does a row without an id. Only vectors of one length are
compared. Rows that repeat an id are all candidates, but one query: the smallest
vector. A query never finds rows of its own id. Scores beyond 64 bits count as
the nearest 64-bit number. Ties go to the smaller id. With fewer than k
candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.session import materialize, ship_package

SHARD_ROWS = 1024
LEAF_ROWS = 64
SAMPLE_ROWS, CELLS, SPREAD = 16_384, 512, 1 << 32
EXACT = 2.0**52  # integers below this are exact in a double


class Tree:
    """KD-tree over the rows of one shard."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.low, self.high, self.kids, self.rows = [], [], [], []
        self.ids, self.points = ids, points
        self._grow(np.arange(len(ids)), leaf_rows)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.peak = float(np.abs(points).max(initial=0.0))

    def _grow(self, rows: np.ndarray, leaf_rows: int) -> int:
        node, part = len(self.kids), self.points[rows]
        self.low.append(part.min(axis=0))
        self.high.append(part.max(axis=0))
        self.kids.append(None)
        self.rows.append(None)
        if len(rows) <= leaf_rows or part.shape[1] == 0:
            self.rows[node] = rows
            return node
        axis = int(np.argmax(self.high[node] - self.low[node]))
        order = np.argpartition(part[:, axis], len(rows) // 2)
        half = len(rows) // 2
        self.kids[node] = (self._grow(rows[order[:half]], leaf_rows), self._grow(rows[order[half:]], leaf_rows))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The highest inner product that any point of each box can reach."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, qids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and row numbers, (queries, k), best first; -inf and -1 where there is none."""
        n = len(qids)
        scores, found = np.full((n, k), -np.inf), np.full((n, k), -1)
        if np.abs(queries).max(initial=0.0) * self.peak * max(1, self.points.shape[1]) >= EXACT:
            return self._plain(qids, queries, k)
        bound, open_ = self.bounds(queries), np.full((n, len(self.kids)), -np.inf)
        open_[:, 0] = bound[:, 0]
        kth = kth.copy()
        while True:
            node = open_.argmax(axis=1)
            live = np.nonzero((open_[np.arange(n), node] >= kth) & (open_[np.arange(n), node] > -np.inf))[0]
            if not len(live):
                return scores, found
            at = node[live]
            open_[live, at] = -np.inf
            for one in np.unique(at):
                who = live[at == one]
                if self.kids[one] is not None:
                    for kid in self.kids[one]:
                        open_[who, kid] = bound[who, kid]
                    continue
                rows = self.rows[one]
                got = queries[who] @ self.points[rows].T
                got[self.ids[rows][None, :] == qids[who][:, None]] = -np.inf
                got[got < kth[who][:, None]] = -np.inf
                who, got = who[keep := got.max(axis=1) > -np.inf], got[keep]
                if not len(who):
                    continue
                both = np.hstack([scores[who], got])
                names = np.hstack([found[who], np.broadcast_to(rows, got.shape)])
                order = np.lexsort((self.ids[names], -both), axis=1)[:, :k]
                scores[who] = np.take_along_axis(both, order, 1)
                found[who] = np.where(scores[who] > -np.inf, np.take_along_axis(names, order, 1), -1)
                kth[who] = np.maximum(kth[who], scores[who, k - 1])

    def _plain(self, qids, queries, k):
        """Whole numbers too large for doubles: every score in Python's integers."""
        points = [[int(x) for x in row] for row in self.points]
        scores, found = np.full((len(qids), k), -np.inf, dtype=object), np.full((len(qids), k), -1)
        for i, q in enumerate(queries):
            q = [int(x) for x in q]
            dots = [min(max(sum(a * b for a, b in zip(q, p)), -(2**63)), 2**63 - 1) for p in points]
            rows = sorted((-x, self.ids[j], j) for j, x in enumerate(dots) if self.ids[j] != qids[i])
            for place, (score, _, j) in enumerate(rows[:k]):
                scores[i, place], found[i, place] = -score, j
        return scores, found


def _vectors(column: pa.ListArray, width: int, scale: float) -> np.ndarray:
    """Rows of one length as whole numbers held in doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values.reshape(len(column), width) * scale)


class Splits:
    """Median splits of a sample: which cell a vector is in."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.at = np.zeros(1 << depth, dtype=np.int64), np.zeros(1 << depth)
        parts = {1: points}
        for node in range(1, 1 << depth):
            part = parts.pop(node)
            if len(part):
                self.axis[node] = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                self.at[node] = np.median(part[:, self.axis[node]])
            right = part[:, self.axis[node]] >= self.at[node]
            parts[2 * node], parts[2 * node + 1] = part[~right], part[right]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.at[node])
        return node - (1 << self.depth)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch with vectors of one length."""
    width = batch.column("width").to_numpy(zero_copy_only=False)
    edge = np.nonzero(np.diff(width))[0] + 1
    for start, end in zip([0, *edge.tolist()], [*edge.tolist(), len(width)]):
        if start < end:
            yield int(width[start]), batch.slice(start, end - start)


def _celled(splits: dict[int, Splits], scale: float):
    """Adds the cell; vectors of a length that the sample lacks are in cell 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in _runs(batch):
                points = _vectors(part.column("vec"), width, scale)
                cell = splits[width].cell(points) if width in splits else np.zeros(len(points), dtype=np.int64)
                yield pa.record_batch([part.column("id"), part.column("vec"), part.column("width"), pa.array(cell, pa.int64())],
                                      names=["id", "vec", "width", "cell"])

    return run


def _boxed(scale: float):
    """The box of each cell of what a task reads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[tuple[int, int], np.ndarray] = {}
        high: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for width, part in _runs(batch):
                points, cell = _vectors(part.column("vec"), width, scale), part.column("cell").to_numpy()
                for c in np.unique(cell).tolist():
                    mine = points[cell == c]
                    key = (width, c)
                    low[key] = np.minimum(low.get(key, mine[0]), mine.min(axis=0))
                    high[key] = np.maximum(high.get(key, mine[0]), mine.max(axis=0))
        if low:
            yield pa.record_batch([
                pa.array([k[0] for k in low], pa.int32()), pa.array([k[1] for k in low], pa.int64()),
                pa.array([v.tolist() for v in low.values()], pa.list_(pa.float64())), pa.array([v.tolist() for v in high.values()], pa.list_(pa.float64())),
            ], names=["width", "cell", "low", "high"])

    return run


def _routed(boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], scale: float):
    """Each query with the cells whose box can reach its kth score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in _runs(batch):
                if width not in boxes:
                    continue
                cells, low, high = boxes[width]
                queries, kth = _vectors(part.column("vec"), width, scale), part.column("kth").to_numpy(zero_copy_only=False)
                bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
                peak = np.maximum(np.abs(low), np.abs(high)).max(initial=0.0)
                sure = np.abs(queries).max(axis=1, initial=0.0) * peak * max(1, width) < EXACT
                open_ = ~sure[:, None] | np.isnan(kth)[:, None] | (bound >= kth[:, None])
                lists = [pa.array(cells[row], pa.int64()) for row in open_]
                offsets = pa.array(np.cumsum([0, *open_.sum(axis=1)]).astype(np.int32))
                flat = pa.concat_arrays(lists) if lists else pa.array([], pa.int64())
                yield pa.record_batch([*[part.column(c) for c in ("id", "vec", "width", "kth", "shard")], pa.ListArray.from_arrays(offsets, flat)],
                                      names=["id", "vec", "width", "kth", "shard", "cells"])

    return run


def _searcher(k: int, scale: float, leaf_rows: int):
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, parts, tree = None, [], [], None
        for batch in batches:
            shard, width, query = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("shard", "width", "is_query"))
            edge = np.nonzero((np.diff(shard) != 0) | (np.diff(width) != 0) | (np.diff(query) != 0))[0] + 1
            for start, end in zip([0, *edge], [*edge, len(shard)]):
                if start == end:
                    continue
                if at != (shard[start], width[start]):
                    at, ids, parts, tree = (shard[start], width[start]), [], [], None
                piece = batch.slice(start, end - start)
                names = piece.column("id").to_numpy(zero_copy_only=False)
                vectors = _vectors(piece.column("vec"), int(width[start]), scale)
                if not query[start]:
                    ids.append(names)
                    parts.append(vectors)
                    continue
                if not ids:
                    continue
                if tree is None:
                    tree = Tree(np.concatenate(ids), np.vstack(parts), leaf_rows)
                kth = piece.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
                for low in range(0, len(names), 1024):
                    cut = slice(low, low + 1024)
                    scores, found = tree.search(names[cut], vectors[cut], np.where(np.isnan(kth[cut]), -np.inf, kth[cut]), k)
                    i, j = np.nonzero(found >= 0)
                    yield pa.record_batch([
                        pa.array(names[cut][i], pa.int64()), pa.array(tree.ids[found[i, j]], pa.int64()),
                        pa.array([int(x) for x in scores[i, j]], pa.int64()),
                    ], schema=out)

    return run


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: float = 64.0, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The k candidates of highest inner product for each query: (query_id, rank, vec_id, score).

    Each component x counts as floor(scale * x).
    """
    spark = candidates.sparkSession
    ship_package(spark)

    def clean(df: DataFrame) -> DataFrame:
        sound = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        return df.filter("id IS NOT NULL AND vec IS NOT NULL").filter(sound).withColumn("width", F.size("vec"))

    rows = clean(candidates)
    total = rows.count()
    depth = min(max(0, int(np.ceil(np.log2(max(1, total / shard_rows))))), int(np.log2(CELLS)))
    some = rows.orderBy(F.xxhash64("id", F.lit(23)), "id").limit(SAMPLE_ROWS).collect() if depth else []
    known: dict[int, list] = {}
    for r in some:  # a bounded sample
        known.setdefault(r["width"], []).append(np.floor(np.array(r["vec"], dtype=np.float64) * scale))
    splits = {w: Splits(np.vstack(v), depth) for w, v in known.items() if w}
    celled = "id long, vec array<double>, width int, cell long"
    placed = materialize(rows.mapInArrow(_celled(splits, scale), celled), "cells")
    sizes = placed.groupBy("width", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("parts"))
    sizes = materialize(sizes, "cell-sizes")  # at most CELLS rows for each length of vectors
    part = F.pmod(F.xxhash64("id", F.lit(17)), "parts")
    shard = (F.col("cell") * SPREAD + part).alias("shard")
    shards = sizes.agg(F.sum("parts")).first()[0] or 1
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // 4))
    columns = ["shard", "width", "is_query", "id", "vec", "kth"]
    no_kth = F.lit(None).cast("double").alias("kth")
    held = placed.join(sizes, ["width", "cell"]).select(shard, "width", F.lit(False).alias("is_query"), "id", "vec", no_kth)
    asked = clean(queries).groupBy("id").agg(F.min("vec").alias("vec")).withColumn("width", F.size("vec"))
    asked = asked.mapInArrow(_celled(splits, scale), celled).join(sizes, ["width", "cell"])
    asked = materialize(asked.select("id", "vec", "width", no_kth, shard), "queries")

    def meet(with_queries: DataFrame) -> DataFrame:
        both = held.unionByName(with_queries.withColumn("is_query", F.lit(True)).select(*columns))
        dealt = both.repartition(tasks, "shard", "width").sortWithinPartitions("shard", "width", "is_query", "id")
        return dealt.mapInArrow(_searcher(k, scale, leaf_rows), "query_id long, vec_id long, score long")

    first = materialize(meet(asked), "nearest")
    reached = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("low"))
    reached = reached.select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("low")).alias("kth"))
    boxes: dict[int, list] = {}
    merged = placed.mapInArrow(_boxed(scale), "width int, cell long, low array<double>, high array<double>").groupBy("width", "cell").agg(
        F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))  # a box for each task that read some of the cell
    ends = lambda name, pick: F.aggregate(F.slice(name, 2, F.size(name)), F.element_at(name, 1), lambda a, x: F.zip_with(a, x, lambda p, q: pick(p, q))).alias(name)
    for r in merged.select("width", "cell", ends("low", F.least), ends("high", F.greatest)).collect():  # at most CELLS rows for each length
        boxes.setdefault(r["width"], []).append((r["cell"], r["low"], r["high"]))
    tables = {w: (np.array([b[0] for b in v]), np.array([b[1] for b in v], dtype=np.float64).reshape(len(v), w),
                  np.array([b[2] for b in v], dtype=np.float64).reshape(len(v), w)) for w, v in boxes.items()}
    rest = asked.drop("kth").join(reached, "id", "left").select("id", "vec", "width", "kth", "shard")
    rest = rest.mapInArrow(_routed(tables, scale), "id long, vec array<double>, width int, kth double, shard long, cells array<long>")
    rest = rest.withColumnRenamed("shard", "home").withColumn("cell", F.explode("cells")).drop("cells").join(sizes, ["width", "cell"])
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p")
    rest = rest.select("id", "vec", "width", "kth", "home", "cell", others).withColumn("shard", F.col("cell") * SPREAD + F.col("p"))
    rest = rest.filter("shard <> home").select("shard", "width", "id", "vec", "kth")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (first.unionByName(meet(rest)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
