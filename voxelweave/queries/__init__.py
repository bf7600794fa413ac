"""All registered queries, grouped by the kind of work they do."""

from __future__ import annotations

import importlib

from voxelweave.queries.registry import ORACLES, QUERIES

GROUPS = ("evaluation", "postprocessing", "datasets", "preprocessing", "training", "streams")


def load_all():
    for group in GROUPS:
        importlib.import_module(f"voxelweave.queries.{group}")
    return QUERIES, ORACLES
