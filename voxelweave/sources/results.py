"""Sinks and scans of evaluation results.

Tables are partitioned by ``model``, ``fold`` and ``postprocessor``, so that one
scan gives all folds with their labels and a filter on a label prunes files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelweave.session import new_path


def write(df: DataFrame, path: str, by: list[str] | None = None, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Parquet, JSON or CSV; rows are first brought together by the partition labels and the case."""
    by = by or []
    spread = df.repartition(*by, *[c for c in ("case_id", "patient_id") if c in df.columns]) if by else df
    writer = spread.write.mode(mode).format(fmt).partitionBy(*by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def read(spark: SparkSession, path: str, schema=None, fmt: str = "parquet") -> DataFrame:
    """All folds under ``path``; ``schema`` is needed for JSON and CSV, which carry no types."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def save_evaluation(result, path: str, extra_keys: DataFrame | None = None, by: list[str] | None = None) -> None:
    """Case details (JSON), lesion tables (JSON and CSV) and the dataset summary (JSON)."""
    from voxelweave.operators import metrics

    by = by or []

    def tagged(df: DataFrame, key: str) -> DataFrame:
        return df if extra_keys is None else df.join(extra_keys.withColumnRenamed("case_id", key), key)

    write(tagged(result.metrics, "case_id"), f"{path}/metrics_details", by, "json")
    for name in ("pred_matches", "ref_matches"):
        table = tagged(getattr(result, name), "patient_id")
        write(table, f"{path}/{name}_json", by, "json")
        write(table, f"{path}/{name}_csv", by, "csv")
    write(metrics.summarise(tagged(result.metrics, "case_id"), by), f"{path}/metrics_summary", [], "json")


def round_trip(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """Writes a partitioned tree to the shared folder and scans it back."""
    path = new_path(df.sparkSession, label)
    write(df, path, by)
    return read(df.sparkSession, path)
