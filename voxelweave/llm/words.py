"""A bounded memory of what a Python worker has already encoded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from voxelweave.session import ship_package

BATCH_ROWS = 1000
MOST = 600_000
#: Encodes units: all ids, and how many belong to each unit (-1: the unit cannot stand alone).
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class Memory:
    """Unit of text -> its ids. When it is full, the units used since the last time stay."""

    def __init__(self, encode: Encode, kind: type, most: int = MOST, at_once: int = 32_768):
        self.encode, self.most, self.at_once = encode, most, at_once
        self.slots: dict[str, int] = {}
        self.ids, self.held = np.empty(1 << 16, dtype=kind), 0
        self.first, self.size, self.used = (np.empty(0, dtype=np.int64) for _ in range(3))
        self.turn = 0

    def _add(self, units: list[str]) -> None:
        ids, size = self.encode(units)
        if self.held + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.held], np.empty(max(len(ids), self.held), dtype=self.ids.dtype)])
        self.ids[self.held:self.held + len(ids)] = ids
        ends = self.held + np.cumsum(np.maximum(size, 0))
        base = len(self.first)
        self.slots.update(zip(units, range(base, base + len(units))))
        self.first = np.concatenate([self.first, ends - np.maximum(size, 0)])
        self.size = np.concatenate([self.size, size])
        self.used = np.concatenate([self.used, np.full(len(units), self.turn)])
        self.held += len(ids)

    def _forget(self) -> None:
        """Keeps the units of the last turn."""
        keep = self.used >= self.turn
        new = np.cumsum(keep) - 1
        self.slots = {u: int(new[s]) for u, s in self.slots.items() if keep[s]}
        size = self.size[keep]
        ids = ragged(self.ids, self.first[keep], np.maximum(size, 0))
        ends = np.cumsum(np.maximum(size, 0))
        self.ids, self.held, self.first, self.size = ids, len(ids), ends - np.maximum(size, 0), size
        self.turn += 1
        self.used = np.full(len(size), self.turn - 1)

    def look_up(self, units: list[str]) -> np.ndarray:
        """The slot of each of these distinct units."""
        if len(self.slots) + len(units) > self.most:
            self._forget()
        new = [u for u in units if u not in self.slots]
        for low in range(0, len(new), self.at_once):
            self._add(new[low:low + self.at_once])
        slots = np.fromiter(map(self.slots.__getitem__, units), dtype=np.int64, count=len(units))
        self.used[slots] = self.turn
        return slots

    def encode_lists(self, units: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a list of units from each text: all ids, how many each text has, and which texts a unit spoils."""
        words = units.flatten().dictionary_encode()
        slots = self.look_up(words.dictionary.to_pylist())
        at = slots[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, dtype=np.int64)
        size = self.size[at]
        bad = np.concatenate([[0], np.cumsum(size < 0)])
        size = np.maximum(size, 0)
        ends = np.concatenate([[0], np.cumsum(size)])
        edges = units.offsets.to_numpy(zero_copy_only=False).astype(np.int64) - units.offsets[0].as_py()
        return ragged(self.ids, self.first[at], size), np.diff(ends[edges]), np.diff(bad[edges]) > 0


def ragged(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of values that begin at ``first``, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(first - (ends - size), size) + np.arange(total)]


def slices(texts: pa.Array, most_bytes: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Runs (low, high) of texts of about that many bytes together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(texts):
        past = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, past + most_bytes, side="right")))
        yield low, high
        low = high


def for_texts(spark: SparkSession) -> None:
    """Readies a session for Python over texts: the package travels, and no Arrow batch has over BATCH_ROWS rows.

    Whole texts can be long, and a worker holds a batch of them at a time.
    """
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
