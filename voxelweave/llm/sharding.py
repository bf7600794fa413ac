"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows fall into blocks by a hash. How many rows each block sends to each shard is
drawn first, so that the whole matrix has the distribution that a uniform
shuffle gives: a tree halves the blocks, and the left half of a node takes its
share of every shard's rows by a chain of hypergeometric draws. Each block then
permutes its rows and sends the first ones to the first shard, and so on; after
the exchange every shard permutes what it got. Shards differ by one row at most.

A draw inverts the distribution function over all counts within twelve standard
deviations (and 40) of the mean; what lies outside is below what a double holds.

Defined cases: columns may hold nulls; a null row key is hashed like any other
value; rows that agree in all ``keys`` stand in order of a hash of all their
columns (but maps), so only equal rows may change places; all input columns stay, except that ``shard`` and ``slot`` replace
columns of these names; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are among the ``marked``, for a uniform number ``u``."""
    def span(x: Column) -> Column:
        n, k, m = (x[c].cast("double") for c in ("n", "k", "m"))
        mean = F.when(n > 0, k / n * m).otherwise(0.0)
        var = F.when(n > 1, mean * (1 - k / n) * (n - m) / (n - 1)).otherwise(0.0)
        wide = 12 * F.sqrt(F.greatest(var, F.lit(0.0))) + 40
        least = F.greatest(F.lit(0).cast("long"), x["k"] + x["m"] - x["n"])
        most = F.least(x["k"], x["m"])
        return F.struct(x["n"].alias("n"), x["k"].alias("k"), x["m"].alias("m"), x["u"].alias("u"),
                        F.greatest(least, F.floor(mean - wide)).alias("low"), F.least(most, F.ceil(mean + wide)).alias("high"))

    def step(x: Column, w: Column, i: Column) -> Column:
        n, k, m, i = (c.cast("double") for c in (x["n"], x["k"], x["m"], i))
        return w * (k - i) * (m - i) / ((i + 1) * (n - k - m + i + 1))

    def draw(x: Column) -> Column:
        counts = F.sequence(x["low"], x["high"])
        mass = F.aggregate(
            counts, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")),
            lambda a, i: F.struct(step(x, a["w"], i).alias("w"), (a["s"] + a["w"]).alias("s")), lambda a: a["s"],
        )
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("c"), (x["u"] * mass).alias("t"))
        return x["low"] + F.least(x["high"] - x["low"], F.aggregate(
            counts, start,
            lambda a, i: F.struct(step(x, a["w"], i).alias("w"), (a["s"] + a["w"]).alias("s"),
                                  (a["c"] + F.when(a["s"] + a["w"] <= a["t"], 1).otherwise(0)).alias("c"), a["t"].alias("t")),
            lambda a: a["c"],
        ))

    given = F.struct(total.cast("long").alias("n"), marked.cast("long").alias("k"), drawn.cast("long").alias("m"), u.alias("u"))
    return _let(given, lambda x: _let(span(x), draw))


def _share(sizes: Column, take: Column, seed: int, *keys: Column) -> Column:
    """Rows of each shard among ``take`` rows drawn from shards of these sizes: a multivariate draw."""
    def next_shard(a: Column, size: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys, F.size(a["out"])), 11) / F.lit(float(2**53))
        return _let(hypergeometric(a["left"], size, a["take"], u), lambda x: F.struct(
            (a["left"] - size).alias("left"), (a["take"] - x).alias("take"), F.concat(a["out"], F.array(x)).alias("out")))

    start = F.struct(
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("left"), take.alias("take"),
        F.array().cast("array<bigint>").alias("out"),
    )
    return F.aggregate(sizes, start, next_shard, lambda a: a["out"])


def communication_matrix(blocks: DataFrame, sizes: list[int], n_blocks: int, seed: int) -> DataFrame:
    """(block, ends): the running counts of rows that each block sends to each shard.

    ``blocks`` has (block, n) for blocks 0 to n_blocks - 1 that have rows. One row
    holds the counts of all blocks at the root; ``n_blocks`` is about the square
    root of the rows.
    """
    spark = blocks.sparkSession
    depth = max(0, math.ceil(math.log2(max(1, n_blocks))))
    at = F.transform(F.sequence(F.lit(0), F.lit((1 << depth) - 1)), lambda i: F.coalesce(
        F.element_at(F.col("by"), i.cast("long")), F.lit(0).cast("long")))
    tree = blocks.agg(F.map_from_entries(F.collect_list(F.struct("block", "n"))).alias("by")).select(
        F.lit(0).cast("long").alias("block"), at.alias("counts"),
        F.array(*[F.lit(s).cast("long") for s in sizes]).alias("sizes"),
    )
    for level in range(depth):
        half = 1 << (depth - level - 1)
        left = F.slice("counts", 1, half)
        take = F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x)
        tree = tree.withColumn("drawn", _share(F.col("sizes"), take, seed, F.lit(level), F.col("block")))
        both = F.array(
            F.struct(F.col("block"), left.alias("counts"), F.col("drawn").alias("sizes")),
            F.struct((F.col("block") + half).alias("block"), F.slice("counts", half + 1, half).alias("counts"),
                     F.zip_with("sizes", "drawn", lambda a, b: a - b).alias("sizes")),
        )
        tree = tree.select(F.explode(both).alias("x")).select("x.*")
        if level == depth // 2:
            tree = tree.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block")
    ends = F.aggregate("sizes", F.array().cast("array<bigint>"), lambda a, x: F.concat(
        a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")))))
    return tree.select("block", ends.alias("ends"))


def shuffle_into_shards(rows: DataFrame, shards: int = 16, seed: int = 7, keys: tuple[str, ...] | None = None) -> DataFrame:
    """All rows with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    rows = rows.drop("shard", "slot")
    keys = [F.col(f"`{c}`") for c in (keys or rows.columns)]
    every = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    total = rows.count()
    sizes = [total // shards + (i < total % shards) for i in range(shards)]
    blocks = max(1, math.isqrt(total))
    hashed = rows.withColumns({
        "__block": F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(blocks)),
        "__first": F.xxhash64(F.lit(seed + 1), *keys), "__second": F.xxhash64(F.lit(seed + 2), *keys), "__third": F.xxhash64(*every),
    })
    counts = hashed.groupBy(F.col("__block").alias("block")).agg(F.count("*").alias("n"))
    matrix = communication_matrix(counts, sizes, blocks, seed)
    place = F.row_number().over(Window.partitionBy("__block").orderBy("__first", "__second", "__third"))
    sent = hashed.withColumn("__place", place).join(matrix.select(F.col("block").alias("__block"), F.col("ends").alias("__ends")), "__block")
    sent = sent.withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__place"))).cast("int"))
    # The second permutation, in pieces: ranks of the second hash are the ranks of its upper part, then of the rest.
    sent = sent.withColumn("__piece", F.pmod(F.shiftrightunsigned("__second", 32), F.lit(max(1, blocks // shards))))
    pieces = sent.groupBy("shard", "__piece").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("shard").orderBy("__piece")) - F.col("m")
    pieces = pieces.select("shard", "__piece", before.alias("__before"))
    inner = F.row_number().over(Window.partitionBy("shard", "__piece").orderBy("__second", "__first", "__third"))
    return (sent.withColumn("__inner", inner).join(pieces, ["shard", "__piece"])
            .withColumn("slot", F.col("__before") + F.col("__inner") - 1)
            .select(*[f"`{c}`" for c in rows.columns], "shard", "slot"))
