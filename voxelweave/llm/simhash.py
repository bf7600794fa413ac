"""SimHash near-duplicates, linked with BK-trees.

A fingerprint is taken of each text; equal fingerprints are one node. Two
fingerprints that differ in at most ``radius`` of 64 bits agree on one of
``radius + 1`` bands, so the nodes of each band value are a shard. A task builds
the shard's BK-tree (children keyed by the Hamming distance to their parent) and
looks up the shard's nodes in it, following only edges within the radius of the
distance met. A shard above ``tree_rows`` nodes is split into trees of that
size, and every tree meets every slice of the shard's nodes, so no link is lost
and no task holds more than two slices. A tree reports one link for each node at
most (a spanning forest of the links it found). The trees travel by the shuffle;
all of them together have no proven size, so they are not broadcast.

Defined cases: a null text counts as empty; a text without words has fingerprint
zero and is linked like any other; rows without an id keep a component that is
the smallest id of the others (null when there is none); repeated rows are in
one component; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.operators.components import merge_pieces
from voxelweave.llm.words import for_texts
from voxelweave.session import materialize, ship_package

TREE_ROWS = 1024
SEED = 42


def shingles(text: bytes | None, words_each: int) -> np.ndarray:
    """The hash of each shingle of a text in UTF-8; A to Z are lower-cased. A text of fewer words is one shingle."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < words_each:
        return np.array([digest(joined, SEED)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - words_each] + 1).tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words_each - 1:].tolist())], dtype="<u8")


def fingerprint(text: bytes | None, words_each: int) -> int:
    """Unsigned SimHash of the shingles of a text in UTF-8; A to Z are lower-cased."""
    if not (text or b"").strip():
        return 0
    raw = shingles(text, words_each).view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, dtype=np.int64)
    for low in range(0, len(raw), 1 << 16):
        counts += np.unpackbits(raw[low:low + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(raw), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}  # by a digest of 128 bits, for the copies in a batch
            out = np.empty(batch.num_rows, dtype=np.uint64)
            for i, text in enumerate(batch.column("text")):
                text = text.as_py() or b""
                key = hashlib.blake2b(text, digest_size=16).digest()
                if key not in seen:
                    seen[key] = fingerprint(text, words_each)
                out[i] = seen[key]
            yield pa.record_batch([batch.column("id"), pa.array(out.view(np.int64))], names=["id", "fp"])

    for_texts(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


class Forest:
    """The BK-trees of several groups, grown level by level."""

    def __init__(self, prints: np.ndarray, group: np.ndarray):
        self.prints = prints
        left, key = np.arange(len(prints)), group.astype(np.int64)
        keys, nodes = [], []
        level = 0
        while len(left):
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            head = left[first]
            if level:
                keys.append(key[first])
                nodes.append(head)
            else:
                self.roots, self.root_groups = head, group[head]
            rest = np.ones(len(left), dtype=bool)
            rest[first] = False
            left, parent = left[rest], head[inverse[rest]]
            key = parent * 65 + np.bitwise_count(prints[left] ^ prints[parent]).astype(np.int64)
            level += 1
        # An edge is known by parent * 65 + distance.
        keys, nodes = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, nodes))
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], nodes[order]

    def within(self, prints: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, level by level."""
        place = np.searchsorted(self.root_groups, group)
        place = np.minimum(place, max(0, len(self.root_groups) - 1))
        query = np.nonzero(self.root_groups[place] == group)[0] if len(self.root_groups) else np.empty(0, np.int64)
        node = self.roots[place[query]] if len(query) else query
        while len(query):
            d = np.bitwise_count(prints[query] ^ self.prints[node]).astype(np.int64)
            hit = d <= radius
            yield query[hit], node[hit]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            many = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right") - low
            query = np.repeat(query, many)
            step = np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many)
            node = self.nodes[np.repeat(low, many) + step]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes the label of every linked pair the smaller one, in place."""
    while len(a):
        high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        apart = high != low
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def _links(prints: np.ndarray, group: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int, step: int = 2048):
    """Links of whole groups: positions (node, smallest position it is linked with)."""
    tree = np.nonzero(in_tree)[0]
    forest, label = Forest(prints[tree], group[tree]), np.arange(len(prints))
    asking = np.nonzero(asks)[0]
    for low in range(0, len(asking), step):
        who = asking[low:low + step]
        for query, node in forest.within(prints[who], group[who], radius):
            _join(label, who[query], tree[node])
    moved = np.nonzero(label != np.arange(len(label)))[0]
    return moved, label[moved]


def _linker(radius: int, hold: int = 1 << 15):
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    names = ("band", "value", "i", "j")

    def links(table: list[dict]) -> pa.RecordBatch:
        whole = {n: np.concatenate([t[n] for t in table]) for n in table[0]}
        new = np.zeros(len(whole["fp"]), dtype=np.int64)
        for n in names:
            new[1:] |= np.diff(whole[n]) != 0
        group = np.cumsum(new)
        one = whole["i"] == whole["j"]
        node, top = _links(whole["fp"].view(np.uint64), group, whole["part"] == whole["i"], one | (whole["part"] == whole["j"]), radius)
        return pa.record_batch([pa.array(whole["fp"][node]), pa.array(whole["fp"][top])], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in (*names, "part", "fp")}
            if rows >= hold:  # what precedes the first new unit of this batch is whole
                new = np.zeros(len(part["fp"]), dtype=bool)
                for n in names:
                    new[0] |= part[n][0] != kept[-1][n][-1]
                    new[1:] |= np.diff(part[n]) != 0
                if new.any():
                    cut = int(new.argmax())
                    kept.append({n: x[:cut] for n, x in part.items()})
                    yield links(kept)
                    kept, rows, part = [], 0, {n: x[cut:] for n, x in part.items()}
            kept.append(part)
            rows += len(part["fp"])
        if kept:
            yield links(kept)

    return run


def near_links(nodes: DataFrame, radius: int = 3, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that join all within the radius."""
    spark = nodes.sparkSession
    ship_package(spark)
    width, bands = 64 // (radius + 1), radius + 1
    pieces = F.array(*[
        F.struct(F.lit(b).alias("band"), F.shiftrightunsigned("fp", b * width).bitwiseAND((1 << width) - 1).alias("value"))
        for b in range(bands)
    ])
    banded = nodes.select("fp", F.explode(pieces).alias("x")).select("fp", "x.band", "x.value")
    crowds = banded.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1")
    crowds = materialize(crowds.select("band", "value", F.ceil(F.col("n") / tree_rows).alias("parts")), "crowds")
    dealt = banded.join(crowds, ["band", "value"]).withColumn("part", F.pmod(F.xxhash64("fp", F.lit(5)), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select(
        "band", "value", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp"
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unit = ["band", "value", "i", "j"]
    return dealt.repartition(tasks, *unit).sortWithinPartitions(*unit).mapInArrow(_linker(radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, radius: int = 3,
                    tree_rows: int = TREE_ROWS) -> DataFrame:
    """One row for each document: (id, fp, component_id), the smallest id that links reach."""
    prints = materialize(with_fingerprints(docs, id_col, text_col, words_each), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    roots = merge_pieces(near_links(nodes, radius, tree_rows).distinct(), [])
    if roots is None:
        labelled = nodes.withColumn("component_id", F.col("low"))
    else:
        rooted = nodes.join(roots.withColumnRenamed("piece", "fp"), "fp", "left")
        rooted = materialize(rooted.withColumn("root", F.coalesce("root", "fp")), "rooted")
        lows = materialize(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
        labelled = rooted.join(lows, "root")
    return prints.join(materialize(labelled.select("fp", "component_id"), "classes"), "fp").select("id", "fp", "component_id")
