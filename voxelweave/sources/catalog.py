"""File catalogs: which files make up which case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Channel number in an image file name, as in case_007_0001.nii.gz.
CHANNEL_PATTERN = r"^(.*)_([0-9]{4})$"


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path and length of the files under ``folder``; contents are never read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .load(folder).select("path", "length")
    )


def file_name(path) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path, ending: str) -> Column:
    """File name without a fixed ending; NULL when the name ends otherwise."""
    name = file_name(path)
    return F.when(F.endswith(name, F.lit(ending)), F.substring(name, 1, F.length(name) - len(ending)))


def case_of_prediction(path, postprocessor: str, ending: str = ".nii.gz") -> Column:
    """Case id of an instance-map prediction file; NULL for any other file."""
    return stem(path, f"_instance_seg_pred_{postprocessor}{ending}")


def case_catalog(files: DataFrame, ending: str = ".nii.gz") -> DataFrame:
    """case and the sorted channel files of each case."""
    parts = files.withColumn("__stem", stem(F.col("path"), ending)).filter(F.col("__stem").rlike(CHANNEL_PATTERN))
    named = parts.select(F.regexp_extract("__stem", CHANNEL_PATTERN, 1).alias("case"), "path")
    # A case has at most 10,000 channel numbers, so the list is short.
    return named.groupBy("case").agg(F.sort_array(F.collect_list("path")).alias("files"))


def pair_files(refs: DataFrame, preds: DataFrame, exact: bool = True) -> DataFrame:
    """Pairs each reference case with its prediction file: case, file, n, status.

    ``refs`` has ``case``; ``preds`` has ``file`` and, for the exact mode, ``case``.
    The other mode pairs when the file name contains the case id. It is an equi
    join too: a name is cut into all its pieces of the lengths that case ids
    have (a name has at most 255 characters).
    """
    if exact:
        hits = preds.select("case", "file")
    else:
        lengths = refs.select(F.length("case").alias("len")).distinct()
        pieces = preds.select("file", F.explode(F.sequence(F.lit(1), F.length("file"))).alias("len")).join(lengths, "len")
        start = F.explode(F.sequence(F.lit(1), F.length("file") - F.col("len") + 1))
        pieces = pieces.withColumn("at", start)
        hits = pieces.select(F.substring("file", F.col("at"), F.col("len")).alias("case"), "file").distinct()
    found = refs.select("case").join(hits, "case", "left").groupBy("case").agg(
        F.count("file").alias("n"), F.min("file").alias("file")
    )
    status = F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "ok").otherwise("several")
    return found.select("case", F.when(F.col("n") == 1, F.col("file")).alias("file"), "n", status.alias("status"))


def require_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs, or an error that names a few cases without exactly one file."""
    bad = pairs.filter("status <> 'ok'").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['case']}: {r['status']} prediction file ({r['n']} found)" for r in bad))
    return pairs.select("case", "file")
