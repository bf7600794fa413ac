"""Logs of training and validation, and the best checkpoint so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def log_averages(log: DataFrame, keys: tuple[str, ...] = ("epoch", "postprocessor", "metric")) -> DataFrame:
    return log.groupBy(*keys).agg(F.avg("value").alias("value"))


def best_so_far(averages: DataFrame, keys: tuple[str, ...] = ("postprocessor", "metric")) -> DataFrame:
    """``is_best``: the value is strictly above all earlier epochs (the first one always is)."""
    earlier = W.partitionBy(*keys).orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.max("value").over(earlier), F.lit(float("-inf")))
    return averages.withColumn("is_best", F.col("value") > before)


def tracked_means(scores: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("epoch", "postprocessor")) -> DataFrame:
    """Per-case validation metrics in long form, averaged over cases."""
    long = scores.unpivot(list(keys), metrics, "metric", "value")
    return log_averages(long, (*keys, "metric"))
