"""Connected components of voxel sets, for many cases and problems at once.

Inside a brick the labels come from a vectorised union-find over the sorted
voxels. Pieces that touch across brick faces are then joined by a contraction
loop over the (small) graph of touching pieces. A grid that fits one brick needs
no loop.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelweave.operators import bricks
from voxelweave.operators.overlap import COORDS
from voxelweave.operators.ranking import rank_in_group
from voxelweave.schema import AXIS_BITS, voxel_key
from voxelweave.session import by_rows, materialize, shuffled

# Number of axes that may differ between neighbours: faces, edges, corners.
REACH = {6: 1, 18: 2, 26: 3}
HALF_STEPS = [
    (dx, dy, dz)
    for dx in (-1, 0, 1)
    for dy in (-1, 0, 1)
    for dz in (-1, 0, 1)
    if (dx, dy, dz) > (0, 0, 0)
]


def half_steps(conn: int) -> list[tuple[int, int, int]]:
    """One of each opposite pair of neighbour steps."""
    if conn not in REACH:
        raise ValueError("connectivity must be 6, 18 or 26")
    return [s for s in HALF_STEPS if sum(map(abs, s)) <= REACH[conn]]


def _steps_column(reach: str):
    steps = F.array(*[
        F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip((*s, sum(map(abs, s))), ("dx", "dy", "dz", "r"))])
        for s in HALF_STEPS
    ])
    return F.filter(steps, lambda s: s["r"] <= F.col(reach))


def adjacency(voxels: DataFrame, conn: int, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Pairs (u, v) of neighbouring voxels as voxel keys, each pair once with u < v."""
    half_steps(conn)
    keys = list(keys)
    there = voxels.withColumn("__reach", F.lit(REACH[conn])).withColumn("s", F.explode(_steps_column("__reach")))
    there = there.select(*keys, voxel_key().alias("u"), *[(F.col(a) + F.col(f"s.d{a}")).alias(a) for a in COORDS])
    here = voxels.select(*keys, *COORDS, voxel_key().alias("v"))
    return there.join(shuffled(here), [*keys, *COORDS]).select(*keys, "u", "v")


def encode_runs(voxels: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Runs of consecutive z on each (x, y) line: z0, z1 and the key of the first voxel."""
    line = W.partitionBy(*keys, "x", "y").orderBy("z")
    gaps = voxels.withColumn("__island", F.col("z") - F.row_number().over(line))
    runs = gaps.groupBy(*keys, "x", "y", "__island").agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
    return runs.drop("__island").withColumn("run", voxel_key("x", "y", "z0"))


def label_codes(code: np.ndarray, wide: int, reach: np.ndarray | int) -> np.ndarray:
    """For sorted brick codes, the index of the first voxel of each voxel's piece."""
    us, vs = [], []
    for dx, dy, dz in HALF_STEPS:
        u, v = bricks.lookup(code, (dx * wide + dy) * wide + dz)
        near = (reach[u] if isinstance(reach, np.ndarray) else np.full(len(u), reach)) >= abs(dx) + abs(dy) + abs(dz)
        us.append(u[near])
        vs.append(v[near])
    u, v = np.concatenate(us), np.concatenate(vs)
    parent = np.arange(len(code))
    while True:
        a, b = parent[u], parent[v]
        split = a != b
        if not split.any():
            return parent
        u, v, a, b = u[split], v[split], a[split], b[split]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def pack(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """voxel_key on arrays."""
    return (x << (2 * AXIS_BITS)) + (y << AXIS_BITS) + z


def _labeller(keys: list[str], side: int):
    """Label of each voxel: the smallest voxel key of its piece of the brick."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        code, wide = bricks.brick_codes(pdf, [*keys, "conn"], side, 0, 1)
        first = label_codes(code, wide, pdf["reach"].to_numpy())
        at = [pdf[a].to_numpy()[first] for a in COORDS]
        return pdf[[*keys, "conn", *COORDS]].assign(piece=pack(*at))

    return label


def face_links(pieces: DataFrame, keys: list[str], side: int) -> DataFrame:
    """Pairs of pieces that touch across a brick face."""
    on_face = F.lit(False)
    for a in COORDS:
        on_face = on_face | (F.col(a) % side).isin(0, side - 1)
    rim = pieces.filter(on_face)
    reach = F.create_map(*[F.lit(x) for kv in REACH.items() for x in kv])
    there = rim.withColumn("__reach", reach[F.col("conn").cast("int")]).withColumn("s", F.explode(_steps_column("__reach")))
    crosses = F.lit(False)
    for a in COORDS:
        crosses = crosses | (F.floor((F.col(a) + F.col(f"s.d{a}")) / side) != F.floor(F.col(a) / side))
    there = there.filter(crosses).select(
        *keys, "conn", F.col("piece").alias("u"), *[(F.col(a) + F.col(f"s.d{a}")).alias(a) for a in COORDS]
    )
    here = rim.select(*keys, "conn", *COORDS, F.col("piece").alias("v"))
    return there.join(shuffled(here), [*keys, "conn", *COORDS]).select(*keys, "conn", "u", "v").distinct()


def merge_pieces(links: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest piece reachable from each linked piece: (keys, piece, root).

    Each round hooks every node to its smallest neighbour, jumps once, and
    contracts the links; hooking always goes to a smaller key, so the smallest
    key of a component becomes its root. It ends when no link is left.
    """
    both = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    links = materialize(links.filter("u <> v").select(*keys, both.alias("e")).select(*keys, "e.u", "e.v"), "links")
    roots = None
    while rows := links.count():
        hook = links.groupBy(*keys, "u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        jump = hook.select(*keys, F.col("u").alias("p"), F.col("p").alias("pp"))
        hook = materialize(
            hook.join(by_rows(jump, rows), [*keys, "p"]).select(*keys, "u", F.col("pp").alias("p")), "hooks"
        )
        if roots is None:
            roots = hook.select(*keys, F.col("u").alias("piece"), F.col("p").alias("root"))
        else:
            moved = hook.select(*keys, F.col("u").alias("root"), "p")
            roots = materialize(
                roots.join(by_rows(moved, rows), [*keys, "root"], "left")
                .select(*keys, "piece", F.coalesce("p", "root").alias("root")), "roots",
            )
        at_u = hook.select(*keys, "u", F.col("p").alias("pu"))
        at_v = hook.select(*keys, F.col("u").alias("v"), F.col("p").alias("pv"))
        links = materialize(
            links.join(by_rows(at_u, rows), [*keys, "u"]).join(by_rows(at_v, rows), [*keys, "v"]).filter("pu <> pv")
            .select(*keys, F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "links",
        )
    return roots


def components(voxels: DataFrame, cases: DataFrame | None = None, conn: int | None = 6,
               keys: tuple[str, ...] = ("case_id",), side: int = bricks.SIDE) -> DataFrame:
    """Adds ``root``, the smallest voxel key of each voxel's connected component.

    ``keys`` separates problems (case, instance, variant, ...). ``conn`` is 6, 18
    or 26, or None to read it from a column ``conn``. The result holds keys, conn,
    x, y, z and root.
    """
    keys = list(keys)
    if conn is not None:
        half_steps(conn)
        voxels = voxels.withColumn("conn", F.lit(conn).cast("long"))
    problem = [k for k in keys if k != "conn"] + ["conn"]
    reach = F.create_map(*[F.lit(x) for kv in REACH.items() for x in kv])
    rows = voxels.select(*problem, *COORDS, reach[F.col("conn").cast("int")].alias("reach"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*problem, *COORDS]) + ", piece bigint"
    labelled = bricks.map_bricks(rows, problem, side, _labeller([k for k in problem if k != "conn"], side), schema)
    labelled = materialize(labelled, "pieces")
    merged = merge_pieces(face_links(labelled, problem[:-1], side), problem)
    if merged is None:
        return labelled.withColumnRenamed("piece", "root")
    return labelled.join(by_rows(merged), [*problem, "piece"], "left").select(
        *problem, *COORDS, F.coalesce("root", "piece").alias("root")
    )


def number_components(rooted: DataFrame, keys: tuple[str, ...] = ("case_id",), out: str = "label") -> DataFrame:
    """Labels 1..n per problem in the order in which a scan of the volume meets the components."""
    keys = list(keys)
    roots = rooted.select(*keys, "root").distinct()
    # At most 2**18 grid positions share the upper bits that serve as the bucket.
    numbered = rank_in_group(roots, keys, [F.col("root")], _key_bucket(F.col("root")), out)
    return rooted.join(numbered, [*keys, "root"])


def _key_bucket(key):
    """Rising bucket of a voxel key: x, then blocks of 64 y-lines."""
    return [F.shiftright(key, 2 * AXIS_BITS), F.shiftright(key, AXIS_BITS + 6)]


def component_table(rooted: DataFrame, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    from voxelweave.operators.overlap import bounds

    return rooted.groupBy(*keys, "root").agg(F.count("*").alias("n"), *bounds())
