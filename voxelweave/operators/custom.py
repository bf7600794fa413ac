"""A user's own metric in Python, spread over the bricks of a case.

A metric that column expressions cannot say is given as three functions: ``part``
turns the voxels of some bricks into a vector of doubles, ``merge`` joins two such
vectors, and ``finish`` turns a case's vector into its value. ``merge`` must not
depend on order, so parts are joined where they arise, then once for each case; no
task holds a case, and Python is called for whole batches, not for each group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.operators import bricks
from voxelweave.operators.overlap import COORDS


@dataclass(frozen=True)
class PythonMetric:
    """``start`` is the vector of no voxels at all, with which merging changes nothing."""

    name: str
    start: tuple[float, ...]
    part: Callable[[dict[str, np.ndarray]], np.ndarray]
    finish: Callable[[np.ndarray, dict], float | None]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add


METRICS: dict[str, PythonMetric] = {}


def register(metric: PythonMetric) -> None:
    """Adds a metric to those that :func:`score` works out when none are named."""
    METRICS[metric.name] = metric


def _parts(chosen: list[PythonMetric], columns: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        case = pdf["case_id"].to_numpy()
        cuts = np.flatnonzero(case[1:] != case[:-1]) + 1
        for low, high in zip([0, *cuts], [*cuts, len(pdf)]):
            here = {c: pdf[c].to_numpy()[low:high] for c in columns}
            rows += [(int(case[low]), i, np.asarray(m.part(here), dtype=float).tolist()) for i, m in enumerate(chosen)]
        return pd.DataFrame(rows, columns=["case_id", "metric", "v"])

    return run


def _joined(chosen: list[PythonMetric]):
    """Joins the vectors of each run of equal case and metric; a task keeps one vector at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, v = None, None
        for pdf in frames:
            done = []
            for case, metric, part in zip(pdf["case_id"].tolist(), pdf["metric"].tolist(), pdf["v"]):
                if key != (case, metric):
                    if key is not None:
                        done.append((*key, np.asarray(v, dtype=float).tolist()))
                    key, v = (case, metric), np.array(chosen[metric].start, dtype=float)
                v = chosen[metric].merge(v, np.asarray(part, dtype=float))
            if done:
                yield pd.DataFrame(done, columns=["case_id", "metric", "v"])
        if key is not None:
            yield pd.DataFrame([(*key, np.asarray(v, dtype=float).tolist())], columns=["case_id", "metric", "v"])

    return run


def score(voxels: DataFrame, cases: DataFrame, names: list[str] | None = None, columns: tuple[str, ...] = ("ref_id", "pred_id"),
          side: int = bricks.SIDE) -> DataFrame:
    """case_id and one column for each metric, for every case, also for one without voxels.

    ``part`` gets x, y, z and the ``columns`` as arrays; ``finish`` the case's vector
    and its row of ``cases``, and gives None where the metric does not apply.
    """
    chosen = [METRICS[n] for n in (names or METRICS)]
    columns = [*COORDS, *columns]
    rows = voxels.select("case_id", *columns)
    schema, order = "case_id long, metric long, v array<double>", ["case_id", "metric"]
    parts = bricks.map_bricks(rows, ["case_id"], side, _parts(chosen, columns), schema)
    # Rows come case by case, so a task sends on few vectors of a case, however many bricks it has.
    here = parts.sortWithinPartitions(*order).mapInPandas(_joined(chosen), schema)
    tasks = int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = here.repartition(tasks, *order).sortWithinPartitions(*order).mapInPandas(_joined(chosen), schema)
    wide = whole.groupBy("case_id").agg(*[F.max(F.when(F.col("metric") == i, F.col("v"))).alias(f"__v{i}") for i in range(len(chosen))])
    told = cases.join(wide, "case_id", "left")

    def run(frames):
        for pdf in frames:
            out = {"case_id": pdf["case_id"]}
            given = pdf.drop(columns=[f"__v{i}" for i in range(len(chosen))]).to_dict("records")
            for i, m in enumerate(chosen):
                vectors = [np.array(m.start if v is None else v, dtype=float) for v in pdf[f"__v{i}"]]
                out[m.name] = pd.array([m.finish(v, row) for v, row in zip(vectors, given)], dtype="Float64")
            yield pd.DataFrame(out)

    return told.mapInPandas(run, "case_id long, " + ", ".join(f"`{m.name}` double" for m in chosen))
