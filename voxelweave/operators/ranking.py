"""Ranks inside a group without putting the group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_in_group(df: DataFrame, group: list[str], order: list[Column], bucket: list[Column], out: str) -> DataFrame:
    """Row number of each row in its group, in ``order``.

    ``bucket`` must not fall as ``order`` rises; it cuts a group into pieces of a
    limited size. Rows are numbered inside a piece, and a prefix sum over the
    piece counts (one row per piece) shifts the numbers. ``order`` must be total.
    """
    names = [f"__b{i}" for i in range(len(bucket))]
    keyed = df.withColumns(dict(zip(names, bucket)))
    counts = keyed.groupBy(*group, *names).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = before.orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    shift = counts.withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = W.partitionBy(*group, *names).orderBy(*order)
    numbered = keyed.withColumn("__rn", F.row_number().over(inside))
    return (
        numbered.join(shift, [*group, *names])
        .withColumn(out, (F.col("__rn") + F.col("__shift")).cast("long"))
        .drop("__rn", "__shift", *names)
    )
