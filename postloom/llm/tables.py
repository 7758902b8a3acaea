"""Sums of one number table per task: each table has a fixed size, however many rows a task reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
_MIDDLE = 1024
_SCHEMA = "block int, part int, numbers binary"


def summed(rows: DataFrame, length: int, table: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of ``table``, an array of ``length`` numbers from a task's batches.

    Tables are cut into blocks and added in two steps, so no task adds more than about a thousand
    blocks at once for each million tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = table(batches)
        task = TaskContext.get().partitionId() % _MIDDLE
        blocks = range(-(-length // BLOCK))
        cut = [np.ascontiguousarray(numbers[b * BLOCK : (b + 1) * BLOCK], np.float32).tobytes() for b in blocks]
        kept = [b for b in blocks if np.frombuffer(cut[b], np.float32).any()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kept, pa.int32()),
                pa.array([task] * len(kept), pa.int32()),
                pa.array([cut[b] for b in kept], pa.binary()),
            ],
            names=["block", "part", "numbers"],
        )

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in group.column("numbers"))
        return pa.table(
            {
                "block": pa.array(group.column("block").to_pylist()[:1], pa.int32()),
                "part": pa.array([0], pa.int32()),
                "numbers": pa.array([total.astype(np.float32).tobytes()], pa.binary()),
            }
        )

    parts = rows.mapInArrow(run, _SCHEMA).groupBy("block", "part").applyInArrow(added, _SCHEMA)
    got = parts.groupBy("block").applyInArrow(added, _SCHEMA).select("block", F.col("numbers")).toArrow()
    out = np.zeros(length)
    for block, numbers in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        own = np.frombuffer(numbers, np.float32)
        out[block * BLOCK : block * BLOCK + len(own)] = own
    return out
