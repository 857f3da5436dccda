"""A global order of tokens from rare to common, of fixed size.

Counts of all tokens of the corpus are folded into a fixed number of counters
by token hash.  A prefix filter is exact under any one total order, so that a
shared counter only costs pruning; tokens in more than some ten-thousandths of
the texts stand out of the background at every corpus size.  The counters take
4 MB however large the input, which is why they may be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .io import lean

COUNTERS = 1 << 20
PARTS = 64
_MASK = np.uint64(COUNTERS - 1)


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes & _MASK).astype(np.int64)


class Counter:
    """The counters of one task, given out as ``PARTS`` rows."""

    def __init__(self) -> None:
        self.counts = np.zeros(COUNTERS, np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        self.counts += np.bincount(slot(hashes), minlength=COUNTERS).astype(np.uint32)

    def parts(self) -> list[bytes]:
        return [p.tobytes() for p in np.split(self.counts, PARTS)]


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, counts in zip(b[0].to_pylist(), b[1]):
            more = np.frombuffer(counts.as_buffer(), np.uint32).astype(np.uint64)
            total[part] = total[part] + more if part in total else more
    if total:
        # counters saturate instead of wrapping; the order stays total
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(c, 0xFFFFFFFF).astype(np.uint32).tobytes() for c in total.values()], pa.binary())], names=["part", "counts"])


def counters(rows: DataFrame) -> Broadcast:
    """Broadcast sum of ``(part, counts)`` rows: ``COUNTERS`` 32-bit numbers."""
    once = rows.select("part", "counts").withColumn("salt", F.spark_partition_id() % 8)
    some = once.repartition("part", "salt").select("part", "counts").mapInArrow(lean(_sum), "part int, counts binary")
    summed = some.repartition("part").mapInArrow(lean(_sum), "part int, counts binary").collect()  # PARTS rows
    out = np.zeros((PARTS, COUNTERS // PARTS), np.uint32)
    for part, counts in summed:
        out[part] = np.frombuffer(counts, np.uint32)
    return rows.sparkSession.sparkContext.broadcast(out.reshape(-1))
