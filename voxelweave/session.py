"""Session set-up and the shared folder for cut lineage.

Iterative operators cut their lineage by writing a Parquet table to the folder
that ``spark.checkpoint.dir`` names. On a cluster that folder is shared, so the
table outlives any executor. A private folder is made up only for a local master
that names none, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("voxelweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder for cut-lineage tables: the session's own setting comes first."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="voxelweave-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which Spark may broadcast a written table.
FEW_ROWS = 200_000


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that has about as many rows as there are voxels: it is shuffled, not broadcast.

    Spark goes by the size of the files, and voxel tables shrink to a byte or two a
    row; such a broadcast does not fit the driver.
    """
    return df.hint("merge")


def by_rows(df: DataFrame, most: int | None = None) -> DataFrame:
    """The same for a table that may be small: its rows decide, or ``most``, the most that it can have."""
    return df if (df.count() if most is None else most) <= FEW_ROWS else shuffled(df)


#: Rows up to which a table with a row for each case is broadcast; a row of seven numbers takes about 100 bytes.
MOST_CASES = 1_000_000


def per_case(df: DataFrame) -> DataFrame:
    """The side of a join with voxels that has a row of a few numbers for each case: if a side is broadcast, this one is.

    Left to itself Spark may take the files of the voxels for the smaller side. The rows
    are counted, so ``df`` should be a written table.
    """
    return F.broadcast(df) if df.count() <= MOST_CASES else shuffled(df)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application.

    Workers then need neither an installed copy nor the driver's search path.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="voxelweave-")) / "voxelweave.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(package.rglob("*.py")):
            target.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
