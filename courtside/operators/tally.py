"""Sums of arrays over tasks, and the order of doubles as whole numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DIRECT = 16            # tasks whose sums go straight to the driver


def in_order(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    bits = (v + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2 ** 63 - 1))


def value_of(key: np.ndarray) -> np.ndarray:
    """The values that ``in_order`` gives these numbers."""
    return (key ^ ((key >> 63) & np.int64(2 ** 63 - 1))).view(np.float64)


def added(frame: DataFrame, tally: Callable, width: int, tasks: int | None = None) -> np.ndarray:
    """The sum of the arrays that ``tally`` gives for each task: in groups first if there are many."""
    parts = frame.mapInArrow(tally, "v binary")
    if (frame.rdd.getNumPartitions() if tasks is None else tasks) > DIRECT:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    total += np.frombuffer(raw)
            yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})
        parts = parts.repartition(DIRECT).mapInArrow(add, "v binary")
    total = np.zeros(width)
    for r in parts.collect():
        total += np.frombuffer(r.v)
    return total
