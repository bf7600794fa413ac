"""Intensity statistics and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelweave.session import materialize, per_case


def image_stats(df: DataFrame, value: str = "intensity", keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """mean, sd (sample), low and high per image."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high")
    )


def zscore(df: DataFrame, value: str | list[str] = "intensity", mask: Column | None = None) -> DataFrame:
    """(x - mean) / max(sd, 1e-8) per case and channel with the population deviation.

    ``value`` names one or several channel columns; all share one pass for their
    statistics. With a mask, statistics and change are limited to it.
    """
    values = [value] if isinstance(value, str) else list(value)
    inside = F.lit(True) if mask is None else mask
    stats = materialize(df.filter(inside).groupBy("case_id").agg(
        *[a for i, v in enumerate(values) for a in (F.avg(v).alias(f"__m{i}"), F.stddev_pop(v).alias(f"__s{i}"))]
    ), "statistics")
    scaled = {
        v: F.when(inside, (F.col(v) - F.col(f"__m{i}")) / F.greatest(F.col(f"__s{i}"), F.lit(1e-8))).otherwise(F.col(v))
        for i, v in enumerate(values)
    }
    return df.join(per_case(stats), "case_id", "left").withColumns(scaled).select(*df.columns)


# Rank error of the sketch is at most 1 / SKETCH; fences stand four errors off.
SKETCH = 10_000
FENCE = 4 / SKETCH


def _brackets(df: DataFrame, group: list[str], value: str, at: list[float]) -> DataFrame:
    """Per group and wanted share: a range of values that is sure to hold its ranks, and the count before it.

    A mergeable sketch proposes the range, an exact count proves it; a range that
    fails is replaced by all values.
    """
    shares = sorted({min(1.0, max(0.0, a + d)) for a in at for d in (-FENCE, FENCE)})
    wanted = F.array(*[
        F.struct(F.lit(float(a)).alias("at"), *[F.lit(shares.index(min(1.0, max(0.0, a + d)))).alias(n) for d, n in ((-FENCE, "i"), (FENCE, "j"))])
        for a in at
    ])
    ends = df.groupBy(*group).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count(value).alias("__n"),
                                  F.percentile_approx(value, shares, SKETCH).alias("__f"))
    fenced = materialize(ends.withColumn("w", F.explode(wanted)).select(
        *group, "w.at", (F.col("w.at") * (F.col("__n") - 1)).alias("__r"), "__lo", "__hi",
        F.when(F.col("w.i") == 0, F.col("__lo")).otherwise(F.col("__f")[F.col("w.i")]).alias("__from"),
        F.when(F.col("w.j") == len(shares) - 1, F.col("__hi")).otherwise(F.col("__f")[F.col("w.j")]).alias("__to"),
    ), "fences")
    counted = df.join(fenced, group).groupBy(*group, "at").agg(
        F.count_if(F.col(value) < F.col("__from")).alias("__before"), F.count_if(F.col(value).between(F.col("__from"), F.col("__to"))).alias("__in")
    )
    sound = (F.col("__before") <= F.floor("__r")) & (F.ceil("__r") < F.col("__before") + F.col("__in"))
    return materialize(fenced.join(counted, [*group, "at"]).select(
        *group, "at", "__r", F.when(sound, F.col("__before")).otherwise(0).alias("__before"),
        F.when(sound, F.col("__from")).otherwise(F.col("__lo")).alias("__from"), F.when(sound, F.col("__to")).otherwise(F.col("__hi")).alias("__to"),
    ), "brackets")


def exact_percentiles(df: DataFrame, group: list[str], value: str, at: list[float], pieces: int = 4096) -> DataFrame:
    """Exact percentiles with linear interpolation, without holding a group's values in one task.

    A wanted rank is first fenced in by ranks, so outliers do not matter. Equal-width
    pieces of the fenced range are counted; only the values of the pieces that hold
    the rank are then counted one by one. NULL and NaN do not count; a group
    without other values gives no row. Result: group, at, percentile. The group and
    value columns are written once, however costly ``df`` is, and read from there.
    """
    df = df.select(*group, value).filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    df = materialize(df, "values")
    width = (F.col("__to") - F.col("__from")) / pieces
    piece = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("__from")) / width), F.lit(pieces - 1))).otherwise(0)
    placed = df.join(_brackets(df, group, value, at), group).filter(F.col(value).between(F.col("__from"), F.col("__to")))
    placed = placed.withColumn("__p", F.coalesce(piece.cast("long"), F.lit(0)))
    order = W.partitionBy(*group, "at").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy(*group, "at", "__p").agg(F.count("*").alias("__c"), F.first("__r").alias("__r"), F.first("__before").alias("__before"))
    counts = counts.withColumn("__before", F.col("__before") + F.coalesce(F.sum("__c").over(order), F.lit(0)))
    hit = counts.filter((F.ceil("__r") >= F.col("__before")) & (F.floor("__r") < F.col("__before") + F.col("__c")))
    hit = materialize(hit.select(*group, "at", "__p", "__r", "__before"), "pieces")
    values = placed.join(hit.select(*group, "at", "__p"), [*group, "at", "__p"], "left_semi").groupBy(*group, "at", "__p", value)
    inside = W.partitionBy(*group, "at", "__p").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    values = values.agg(F.count("*").alias("__m")).withColumn("__upto", F.sum("__m").over(inside))
    near = hit.join(values, [*group, "at", "__p"])
    end = F.col("__before") + F.col("__upto")
    holds = lambda k: (end > k) & (end - F.col("__m") <= k)
    low, high = (F.max(F.when(holds(k("__r")), F.col(value))) for k in (F.floor, F.ceil))
    share = F.max("__r") - F.floor(F.max("__r"))
    return near.groupBy(*group, "at").agg(F.when(low == high, low).otherwise(low + (high - low) * share).alias("percentile"))


# Percentiles of the foreground intensities that the fingerprint holds.
FINGERPRINT = {0.005: "percentile_00_5", 0.5: "median", 0.995: "percentile_99_5"}


def fingerprint(df: DataFrame, channel: str = "channel", value: str = "intensity") -> DataFrame:
    """Foreground intensity properties per channel."""
    basic = df.groupBy(channel).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    q = exact_percentiles(df, [channel], value, list(FINGERPRINT))
    wide = q.groupBy(channel).agg(*[F.max(F.when(F.col("at") == a, F.col("percentile"))).alias(n) for a, n in FINGERPRINT.items()])
    return basic.join(wide, channel)


def case_summaries(df: DataFrame, channel: str = "channel", value: str = "intensity", k: int = 4000) -> DataFrame:
    """What the fingerprint needs of each case: count, mean, squared deviations, ends and a mergeable sketch of the values.

    A row for each case and channel, to be stored beside the case; NULL and NaN do not count.
    """
    df = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("__v", F.col(value).cast("double"))
    return df.groupBy("case_id", channel).agg(
        F.count("*").alias("n"), F.avg("__v").alias("mean"), (F.var_pop("__v") * F.count("*")).alias("m2"),
        F.min("__v").alias("min"), F.max("__v").alias("max"), F.kll_sketch_agg_double("__v", F.lit(k)).alias("sketch"))


def fingerprint_of(summaries: DataFrame, channel: str = "channel", k: int = 4000) -> DataFrame:
    """The fingerprint from :func:`case_summaries`, so a new case costs a scan of that case only.

    Mean, deviation and ends are those of all values. Percentiles come from the
    merged sketches, whose rank error is about 1.8 / k; :func:`fingerprint` has the exact ones.
    """
    n, mean = F.col("n").cast("double"), F.col("mean")
    sums = summaries.groupBy(channel).agg(
        F.sum(n).alias("__n"), (F.sum(n * mean) / F.sum(n)).alias("mean"), F.sum("m2").alias("__within"),
        F.sum(n * mean * mean).alias("__squares"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("__sketch"))
    between = F.greatest(F.col("__squares") - F.col("__n") * F.col("mean") * F.col("mean"), F.lit(0.0))
    return sums.select(
        channel, "mean", F.sqrt((F.col("__within") + between) / F.col("__n")).alias("std"), "min", "max",
        *[F.kll_sketch_get_quantile_double("__sketch", F.lit(a)).alias(name) for a, name in FINGERPRINT.items()])


def dataset_geometry(cases: DataFrame) -> DataFrame:
    """Median grid length and spacing per axis over the dataset."""
    long = cases.select(F.explode(F.array(*[
        F.struct(F.lit(f"{p}{a}").alias("name"), F.col(f"{p}{a}").cast("double").alias("value")) for p in "ns" for a in "xyz"
    ])).alias("r")).select("r.name", "r.value")
    return exact_percentiles(long, ["name"], "value", [0.5]).select("name", F.col("percentile").alias("median"))


def scheme_normalise(df: DataFrame, properties: DataFrame, channel: str = "channel", value: str = "intensity") -> DataFrame:
    """Clip to the dataset's foreground percentiles, then z-score with its foreground mean and deviation."""
    p = properties.select(channel, *[F.col(c).alias(f"__{c}") for c in ("mean", "std", "percentile_00_5", "percentile_99_5")])
    joined = df.join(p, channel)
    clipped = F.least(F.greatest(F.col(value), F.col("__percentile_00_5")), F.col("__percentile_99_5"))
    scaled = (clipped - F.col("__mean")) / F.greatest(F.col("__std"), F.lit(1e-8))
    return joined.withColumn(value, scaled).select(*df.columns)


def scheme_normalise_columns(df: DataFrame, values: list[str], properties: DataFrame, channel: str = "channel") -> DataFrame:
    """The same for channels held as columns; ``properties`` has a row for each column name."""
    rows = {r[channel]: r for r in properties.filter(F.col(channel).isin(values)).collect()}  # one row per channel column
    missing = [v for v in values if v not in rows]
    if missing:
        raise ValueError(f"no foreground properties of {missing}")
    scaled = {}
    for v in values:
        low, high, mean, std = (rows[v][c] for c in ("percentile_00_5", "percentile_99_5", "mean", "std"))
        scaled[v] = (F.least(F.greatest(F.col(v), F.lit(low)), F.lit(high)) - F.lit(mean)) / F.lit(max(std, 1e-8))
    return df.withColumns(scaled)


def long_channels(df: DataFrame, values: list[str]) -> DataFrame:
    """(channel, intensity) of channels held as columns, as :func:`fingerprint` reads them."""
    each = F.array(*[F.struct(F.lit(v).alias("channel"), F.col(v).cast("double").alias("intensity")) for v in values])
    return df.select(F.explode(each).alias("r")).select("r.channel", "r.intensity")
