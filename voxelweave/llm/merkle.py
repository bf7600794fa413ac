"""Merkle manifest of a dataset, a SHA-256 midstate tree.

Every row is a leaf. The leaves of a source ascend by id; three consecutive nodes
become their parent until one is left, and the sources' nodes go on in the same
way to the root. A digest as hex text is exactly one block of SHA-256, so a
parent can keep the hash state before each of its child slots. To fold a changed
child, the state before its slot is resumed with the replacement and the right
siblings; left siblings are not read.

Leaves are ranked by a range partitioning with prefix sums over the partitions.
A block of ``3 ** levels`` consecutive nodes of a source is one small group; the
blocks' nodes are the leaves of the next tier, so a source of any size takes a
few rounds and no task holds more than a block. Paths go down tier by tier.

Defined cases: nulls in any column are written as ``-``; a null source comes
before all others and a null id before all other ids; rows of one id stand in
order of their leaves, so equal rows are interchangeable; a source of one row
has its leaf as its node; a row without any siblings has the hash of nothing as
its proof; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.session import materialize, ship_package

ARITY = 3
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = 2 + 32 + 64  # of a path: siblings left and right, the state before the slot, the siblings


def _root(value: int, power: int) -> int:
    """Whole part of a root, exactly."""
    low = round(value ** (1 / power))
    while low**power > value:
        low -= 1
    while (low + 1) ** power <= value:
        low += 1
    return low


# SHA-256's constants are the first 32 bits behind the point of roots of primes.
_PRIMES = [n for n in range(2, 312) if all(n % d for d in range(2, math.isqrt(n) + 1))]
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _PRIMES[:8]], dtype=np.uint32)
ROUND = np.array([_root(p << 96, 3) & 0xFFFFFFFF for p in _PRIMES[:64]], dtype=np.uint32)


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The next states (n, 8) of SHA-256 after a block (n, 16) each."""
    def turn(x: np.ndarray, by: int) -> np.ndarray:
        return (x >> np.uint32(by)) | (x << np.uint32(32 - by))

    words = list(np.ascontiguousarray(block.T))
    a, b, c, d, e, f, g, h = first = list(np.ascontiguousarray(state.T))
    for i in range(64):
        if i >= 16:
            x, y = words[i - 15], words[i - 2]
            words.append(words[i - 16] + (turn(x, 7) ^ turn(x, 18) ^ (x >> np.uint32(3))) + words[i - 7]
                         + (turn(y, 17) ^ turn(y, 19) ^ (y >> np.uint32(10))))
        high = h + (turn(e, 6) ^ turn(e, 11) ^ turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[i] + words[i]
        low = (turn(a, 2) ^ turn(a, 13) ^ turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = high + low, a, b, c, d + high, e, f, g
    return np.stack([x + y for x, y in zip(first, (a, b, c, d, e, f, g, h))], axis=1)


_HEX = np.array([[ord(c) for c in f"{i:02x}"] for i in range(256)], dtype=np.uint8)


def absorb(state: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """States after the hex text of digests (n, 32)."""
    return compress(state, _HEX[digests].reshape(-1, 64).view(">u4").astype(np.uint32))


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of whole blocks that led to these states."""
    end = np.zeros((len(state), 16), dtype=np.uint32)
    end[:, 0] = 0x80000000
    bits = np.asarray(blocks, dtype=np.uint64) * np.uint64(512)
    end[:, 14], end[:, 15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return compress(state, end).astype(">u4").view(np.uint8)


def _some(state: np.ndarray, digests: np.ndarray, which: np.ndarray) -> np.ndarray:
    """States after the digests, where ``which``."""
    out = state.copy()
    if which.any():
        out[which] = absorb(state[which], digests[which])
    return out


def grow(nodes: np.ndarray, levels: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Above the nodes (n, 32), level by level: digests (m, 32) and the states (m, 3, 8) before each child slot."""
    digests, states = [], []
    for _ in range(levels):
        n = len(nodes)
        m = -(-n // ARITY)
        room = np.zeros((m * ARITY, 32), dtype=np.uint8)
        room[:n] = nodes
        room = room.reshape(m, ARITY, 32)
        children = np.full(m, ARITY)
        children[-1] = n - (m - 1) * ARITY
        now, before = np.repeat(START[None], m, axis=0), []
        for slot in range(ARITY):
            before.append(now)
            now = _some(now, room[:, slot], children > slot)
        nodes = finish(now, children)
        digests.append(nodes)
        states.append(np.stack(before, axis=1))
    return digests, states


def block_levels(total: int, most: int) -> int:
    """Levels inside a block of a source with so many nodes in this tier, at most ``most``."""
    levels = 0
    while total > 1 and levels < most:
        total, levels = -(-total // ARITY), levels + 1
    return levels


def steps(nodes: np.ndarray, digests: list[np.ndarray], states: list[np.ndarray]) -> np.ndarray:
    """The steps (n, levels, STEP) from each node of a block to the block's root."""
    n = len(nodes)
    out, at, below = np.zeros((n, len(digests), STEP), dtype=np.uint8), np.arange(n), nodes
    for level, (above, kept) in enumerate(zip(digests, states)):
        parent, slot = at // ARITY, at % ARITY
        last = np.minimum(len(below) - parent * ARITY, ARITY)
        out[:, level, 0], out[:, level, 1] = slot, last - 1 - slot
        out[:, level, 2:34] = kept[parent, slot].astype(">u4").view(np.uint8)
        for place in range(ARITY - 1):
            sibling = parent * ARITY + place + (place >= slot)
            there = place < last - 1
            out[there, level, 34 + 32 * place:66 + 32 * place] = below[sibling[there]]
        at, below = parent, above
    return out


def fold(values: np.ndarray, path: np.ndarray, proof: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folds values (n, 32) up their path (n, levels, STEP).

    Each step resumes the state before the slot with the value and the right
    siblings. ``proof`` are the states of the hash over all siblings met so far,
    ``seen`` how many these were.
    """
    for level in range(path.shape[1]):
        step = path[:, level]
        left, right = step[:, 0].astype(np.int64), step[:, 1].astype(np.int64)
        siblings = step[:, 34:].reshape(-1, ARITY - 1, 32)
        now = absorb(np.ascontiguousarray(step[:, 2:34]).view(">u4").astype(np.uint32), values)
        for place in range(ARITY - 1):
            there = place < left + right
            now = _some(now, siblings[:, place], there & (place >= left))
            proof = _some(proof, siblings[:, place], there)
        values, seen = finish(now, left + 1 + right), seen + left + right
    return values, proof, seen


def _bytes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def leaf(values: list[Column]) -> Column:
    """SHA-256 in hex over all values: ``-`` for a null, else the length in bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[
        F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)) for x in texts
    ]).cast("binary"), 256)


@dataclass
class Manifest:
    """Written tables of a tree.

    ``leaves``: grp, pos, total, block, digest and the columns that were carried.
    ``tree``: grp, tier, block, total, nodes, root, and packed digests and states
    of all levels above. ``grp`` orders the sources; the tree over them has grp -1.
    """

    leaves: DataFrame
    tree: DataFrame
    tiers: int
    top_tiers: int
    levels: int

    @property
    def block(self) -> int:
        return ARITY**self.levels


_TREE = "grp long, tier int, block long, total long, root binary, nodes binary, digests binary, states binary"


def _tier(tier: int, levels: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        nodes, total = _bytes(table["digest"], 32), table["total"][0].as_py()
        digests, states = grow(nodes, block_levels(total, levels))
        root = digests[-1][0] if digests else nodes[0]
        kept = b"".join(s.astype("<u4").tobytes() for s in states)
        return pa.table({
            "grp": pa.array([key[0].as_py()], pa.int64()), "tier": pa.array([tier], pa.int32()),
            "block": pa.array([key[1].as_py()], pa.int64()), "total": pa.array([total], pa.int64()),
            "root": pa.array([root.tobytes()], pa.binary()), "nodes": pa.array([nodes.tobytes() if tier else b""], pa.binary()),
            "digests": pa.array([b"".join(d.tobytes() for d in digests)], pa.binary()), "states": pa.array([kept], pa.binary()),
        })

    return run


def _unpacked(row: dict, count: int, levels: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The levels of a block above its ``count`` nodes."""
    digests, states, a = [], [], 0
    flat, kept = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32), np.frombuffer(row["states"], "<u4").reshape(-1, ARITY, 8)
    for _ in range(block_levels(row["total"], levels)):
        count = -(-count // ARITY)
        digests.append(flat[a:a + count])
        states.append(kept[a:a + count])
        a += count
    return digests, states


def _grown(nodes: DataFrame, most: int, levels: int) -> tuple[DataFrame, int]:
    """The tree tables over (grp, pos, total, digest), tier by tier, and how many tiers there are."""
    tiers, tables, size = 0, [], ARITY**levels
    while True:
        blocked = nodes.select("grp", F.expr(f"pos div {size}").alias("block"), "pos", "total", "digest")
        table = materialize(blocked.groupBy("grp", "block").applyInArrow(_tier(tiers, levels), _TREE), f"tier-{tiers}")
        tables.append(table)
        tiers += 1
        if most <= size:
            break
        most = -(-most // size)
        nodes = table.filter(F.col("total") > size).select(
            "grp", F.col("block").alias("pos"), F.expr(f"(total + {size - 1}) div {size}").alias("total"), F.col("root").alias("digest"))
    tree = tables[0]
    for table in tables[1:]:
        tree = tree.unionByName(table)
    return tree, tiers


def _ranked(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """The rows with ``at``, their place in the whole order."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("__m", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("__part", F.shiftright("__m", 33))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")  # a row for each partition
    return placed.join(counts.select("__part", before.alias("__base")), "__part").withColumn(
        "at", F.col("__base") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m", "__part", "__base")


def build(docs: DataFrame, digest: Column, source: Column, order: Column, carry: dict[str, Column] | None = None,
          levels: int = LEVELS) -> Manifest | None:
    """The written tree over the rows of a table; None for an empty one.

    ``digest`` is a leaf's hash in hex; in a source, leaves ascend by ``order`` and hash.
    """
    ship_package(docs.sparkSession)
    size = ARITY**levels
    rows = materialize(docs.select(source.alias("__source"), order.alias("__order"), F.unhex(digest).alias("digest"),
                                   *[c.alias(name) for name, c in (carry or {}).items()]), "leaves")
    rows = _ranked(rows, ["__source", "__order", "digest"], "ranked")
    groups = materialize(rows.groupBy("__source").agg(F.min("at").alias("grp"), F.count("*").alias("total")), "sources")
    most, sources = groups.agg(F.max("total"), F.count("*")).first()
    if not sources:
        return None
    ranked = _ranked(groups.select("grp", "total"), ["grp"], "source-ranks").select("grp", F.col("at").alias("top"))
    leaves = rows.join(groups, rows["__source"].eqNullSafe(groups["__source"])).drop(groups["__source"])
    leaves = leaves.withColumn("pos", F.col("at") - F.col("grp")).withColumn("block", F.expr(f"pos div {size}"))
    leaves = materialize(leaves.drop("__source", "__order", "at"), "placed")
    tree, tiers = _grown(leaves.select("grp", "pos", "total", "digest"), most, levels)
    roots = tree.filter(f"total <= {size}").join(ranked, "grp")
    roots = materialize(roots.select(F.lit(-1).cast("long").alias("grp"), F.col("top").alias("pos"),
                                     F.lit(sources).cast("long").alias("total"), F.col("root").alias("digest"), F.col("grp").alias("of")), "subroots")
    top, top_tiers = _grown(roots.select("grp", "pos", "total", "digest"), sources, levels)
    named = roots.select(F.lit(-1).cast("long").alias("grp"), "pos", F.col("of"))
    top = top.unionByName(named.select("grp", F.lit(-1).alias("tier"), F.col("pos").alias("block"), F.col("of").alias("total"), *[
        F.lit(None).cast("binary").alias(c) for c in ("root", "nodes", "digests", "states")]))
    return Manifest(leaves, materialize(tree.unionByName(top), "tree"), tiers, top_tiers, levels)


def root(manifest: Manifest) -> bytes:
    """The root of the whole tree."""
    return bytes(manifest.tree.filter(f"grp = -1 and tier >= 0 and total <= {manifest.block}").first()["root"])


def _paths(levels: int):
    """For each node of a block: its steps inside the block, then the block's own path."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes = np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32)
                inside = steps(nodes, *_unpacked(row, len(nodes), levels))
                first = row["block"] * ARITY**levels
                yield pa.record_batch([
                    pa.array([row["grp"]] * len(nodes), pa.int64()), pa.array(range(first, first + len(nodes)), pa.int64()),
                    pa.array([x.tobytes() + row["path"] for x in inside], pa.binary()), pa.array([row["subroot"]] * len(nodes), pa.binary()),
                ], names=["grp", "block", "path", "subroot"])

    return run


def paths(manifest: Manifest) -> DataFrame:
    """(grp, block, path, subroot): the steps from the root of each block of leaves to the root of the whole tree."""
    schema = "grp long, block long, path binary, subroot binary"
    tree, nothing, size, levels = manifest.tree, F.lit(b"").cast("binary"), manifest.block, manifest.levels
    above = tree.filter(f"grp = -1 and tier >= 0 and total <= {size}").select("grp", "block", nothing.alias("path"), nothing.alias("subroot"))
    for tier in reversed(range(manifest.top_tiers)):
        here = tree.filter(f"grp = -1 and tier = {tier}")
        # At tier 0 the top tree keeps no nodes: they are the sources' roots.
        if tier:
            above = here.join(above, ["grp", "block"]).mapInArrow(_paths(levels), schema)
        else:
            subroots = tree.filter("grp = -1 and tier = -1").select(F.col("block").alias("pos"), F.col("total").alias("of"))
            ends = tree.filter(f"grp >= 0 and total <= {size}").select(F.col("grp").alias("of"), "root")
            named = subroots.join(ends, "of").withColumn("block", F.expr(f"pos div {size}"))
            packed = here.select("grp", "block", "total", "digests", "states").join(above, ["grp", "block"]).drop("subroot")
            above = named.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(_source_paths(levels), schema)
    above = materialize(above, "source-paths")
    for tier in reversed(range(1, manifest.tiers)):
        here = tree.filter(f"grp >= 0 and tier = {tier}")
        last = above.filter("block = 0") if tier == manifest.tiers - 1 else above
        below = here.join(last, ["grp", "block"]).mapInArrow(_paths(levels), schema)
        # Sources that are whole in a lower tier wait for it.
        whole = tree.filter(f"grp >= 0 and tier < {tier} and total <= {size}").select("grp")
        above = materialize(below.unionByName(above.join(whole, "grp", "left_semi")), f"paths-{tier}")
    return above


def _source_paths(levels: int):
    """As ``_paths``, for the sources' nodes."""
    def run(named: pa.Table, packed: pa.Table) -> pa.Table:
        named = named.sort_by("pos")
        row = packed.to_pylist()[0]
        nodes = _bytes(named["root"], 32)
        inside = steps(nodes, *_unpacked(row, len(nodes), levels))
        return pa.table({
            "grp": named["of"].cast(pa.int64()), "block": pa.array([0] * len(nodes), pa.int64()),
            "path": pa.array([x.tobytes() + row["path"] for x in inside], pa.binary()), "subroot": named["root"].cast(pa.binary()),
        })

    return run


def _folded(carry: list[str], changed: str, levels: int):
    def run(leaves: pa.Table, above: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("pos")
        row = above.to_pylist()[0]
        nodes, new = _bytes(leaves["digest"], 32), _bytes(leaves[changed], 32)
        inside = steps(nodes, *_unpacked(row, len(nodes), levels))
        proof, seen = np.repeat(START[None], len(nodes), axis=0), np.zeros(len(nodes), dtype=np.int64)
        new, proof, seen = fold(new, inside, proof, seen)
        outside = np.frombuffer(row["path"], np.uint8).reshape(1, -1, STEP)
        new, proof, seen = fold(new, np.broadcast_to(outside, (len(nodes), *outside.shape[1:])), proof, seen)
        return pa.table({c: leaves[c] for c in carry} | {
            "leaf": leaves["digest"].cast(pa.binary()), "subroot": pa.array([row["subroot"]] * len(nodes), pa.binary()),
            "proof": pa.array([x.tobytes() for x in finish(proof, seen)], pa.binary()),
            "folded": pa.array([x.tobytes() for x in new], pa.binary()),
        })

    return run


def folded(manifest: Manifest, changed: str) -> DataFrame:
    """Each leaf with its proof and the root that its changed digest leads to.

    ``changed`` names a carried column with the digests (binary) to put in the
    leaves' places, one at a time. Gives the carried columns, leaf, subroot, proof
    (the hash over all siblings up to the root) and folded.
    """
    carried = [f for f in manifest.leaves.schema.fields if f.name not in ("grp", "pos", "total", "block", "digest")]
    above = manifest.tree.filter("grp >= 0 and tier = 0").select("grp", "block", "total", "digests", "states").join(paths(manifest), ["grp", "block"])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carried] + ["leaf binary, subroot binary, proof binary, folded binary"])
    return manifest.leaves.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(
        _folded([f.name for f in carried], changed, manifest.levels), schema)


def tampered_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, levels: int = LEVELS) -> DataFrame:
    """Each row's digests, and whether it verifies after line ends of every other row are lost.

    Line ends go from the text where 2 divides the crc32 of the id.
    """
    values = [F.col(f"`{c}`") for c in fields]
    hit = F.coalesce(F.crc32(values[0].cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = values[-1].cast("string")
    changed = [*values[:-1], F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)]
    tree = build(docs, leaf(values), values[1].cast("string"), values[0].cast("long"),
                 {"id": values[0].cast("long"), "changed": F.unhex(leaf(changed))}, levels)
    if tree is None:
        return docs.sparkSession.createDataFrame([], "id long, changed binary, leaf binary, subroot binary, proof binary, folded binary, root binary, verified boolean")
    whole = root(tree)
    return folded(tree, "changed").withColumns({"root": F.lit(whole), "verified": F.col("folded") == F.lit(whole)})
