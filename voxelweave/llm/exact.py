"""Exact duplicates by an extendible-hash index on shared files.

The directory grows by doubling: while a bucket holds more keys than fit, it is
split by the next bit of the hash. A key whose rows alone exceed a bucket cannot
be split by bits; it gets overflow pages. Owner tasks take whole buckets (or
pages), chain the entries of equal hashes, tell them apart by comparing the texts
byte by byte, and write the chains with their members to the shared folder. The
pages of one text are joined by comparing texts again.

A bucket holds about the square root of all rows, so the directory and the list
of paged keys have at most so many rows as well and may be broadcast.

Defined cases: a null text counts as empty; of equal texts the row with the most
code points in the original stays, then the smallest id, a null id last; of
repeated rows one stays; other columns play no part; an empty table gives no
rows. The input must give the same rows in the same partitions each time it is
read, as stored tables do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.session import materialize

BLANKS = " \t\n\x0b\x0c\r"  # fixed value: the characters that equality ignores


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def directory(prefixes: DataFrame, depth: int, most: int) -> DataFrame:
    """Buckets by extendible hashing: (slot, bucket), a row for each of the ``2 ** depth`` slots in use.

    ``prefixes`` has (slot, n): distinct keys for each prefix of ``depth`` bits.
    Level by level, the keys below a prefix are counted; a slot belongs to the
    shortest prefix whose keys fit.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    counted = prefixes.select("slot", "n", levels)
    counted = counted.withColumn("prefix", F.expr(f"shiftright(slot, {depth} - level)"))
    sizes = counted.groupBy("level", "prefix").agg(F.sum("n").alias("keys"))
    fits = counted.join(sizes, ["level", "prefix"]).filter((F.col("keys") <= most) | (F.col("level") == depth))
    first = fits.groupBy("slot").agg(F.min("level").alias("level"))
    return first.select("slot", F.expr(f"shiftleft(shiftright(slot, {depth} - level), {depth} - level) * 64 + level").alias("bucket"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """Writes the index and gives it back: (bucket, page, pages, hash, norm, best, members, row).

    ``members`` has all rows of a chain entry as (points, order, uid, id); a page
    holds about a bucket's rows at most. ``best`` is the member that stays and
    ``row`` its whole row, null unless ``whole_rows``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("raw"),
        F.monotonically_increasing_id().alias("uid"), (row if whole_rows else F.lit(None).cast("string")).alias("row"),
    ).withColumn("norm", normalised(F.col("raw"))).withColumn("hash", F.xxhash64("norm"))
    keys = materialize(rows.groupBy("hash").agg(F.count("*").alias("n")), "keys")
    total, distinct = keys.agg(F.sum("n"), F.count("*")).first()
    most = max(512, 2 * math.isqrt(total or 1))
    depth = max(0, math.ceil(math.log2(max(1, (distinct or 1) / most)))) + 2
    slot = F.shiftrightunsigned("hash", 64 - depth)
    slots = directory(keys.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")), depth, most)
    paged = keys.filter(F.col("n") > most).select("hash", F.ceil(F.col("n") / most).alias("pages"))
    # Both have at most about the square root of all rows, by the choice of ``most``.
    placed = rows.withColumn("slot", slot).join(F.broadcast(slots), "slot").join(F.broadcast(paged), "hash", "left")
    placed = placed.withColumn("pages", F.coalesce("pages", F.lit(1).cast("long")))
    placed = placed.withColumn("page", F.pmod(F.xxhash64("uid", F.lit(3)), "pages"))
    member = F.struct(
        F.coalesce(F.length("raw"), F.lit(0)).alias("points"), F.bitwise_not(F.coalesce("id", F.lit(2**63 - 1))).alias("order"),
        F.bitwise_not("uid").alias("uid"), F.col("id"),
    )
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # With whole rows the text travels once, inside its row.
    text = [] if whole_rows else ["norm"]
    owned = placed.select("bucket", "page", "pages", "hash", *text, "row", member.alias("m")).repartition(tasks, "bucket", "page")
    if whole_rows:
        owned = owned.withColumn("norm", normalised(F.col(f"row.`{text_col}`")))
    chains = owned.groupBy("bucket", "page", "pages", "hash", "norm").agg(
        F.max("m").alias("best"), F.collect_list("m").alias("members"), F.max_by("row", "m").alias("row"))
    return materialize(chains, "index")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept and text_sha256."""
    index = build_index(docs, id_col, text_col)
    sha = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
    single = index.filter("pages = 1").select(
        "members", F.col("best").alias("top"), F.size("members").cast("long").alias("group_size"), sha)
    many = index.filter("pages > 1")
    whole = many.groupBy("hash", "norm").agg(F.max("best").alias("top"), F.sum(F.size("members")).cast("long").alias("group_size"))
    spread = many.select("hash", "norm", "members").join(whole, ["hash", "norm"]).select("members", "top", "group_size", sha)
    out = single.unionByName(spread).select(F.explode("members").alias("m"), "top", "group_size", "text_sha256")
    return out.select(
        F.col("m.id").alias(id_col), F.col("top.id").alias("keep_id"), "group_size",
        (F.col("m.uid") == F.col("top.uid")).alias("kept"), "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    index = build_index(docs, id_col, text_col, whole_rows=True)
    paged = index.filter("pages > 1").groupBy("hash", "norm").agg(F.max_by("row", "best").alias("row"))
    return index.filter("pages = 1").select("row.*").unionByName(paged.select("row.*"))
