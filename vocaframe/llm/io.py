"""Tables between the jobs of one operator."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir, ship_package


#: Bytes of an Arrow batch: texts may be long, and several workers share an
#: executor's memory.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, and keep Arrow
    batches of this session within ``BATCH_BYTES``."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``; memory it has freed goes back to the system
    at the end of a partition, as idle workers live on beside busy ones."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return wrapped


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: what follows
    reads files that outlive any executor, and the lineage ends here."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


#: Rows up to which a list of ids (16 bytes a row and less) is broadcast.
BROADCAST_ROWS = 1 << 22


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast join if it has ``limit`` rows at most;
    beyond that Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= limit else df


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All batches of a partition as one table (partitions are sized by
    ``spark.sql.shuffle.partitions`` and the advisory size)."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def binary_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # nothing, or beyond one chunk's size
        column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks])
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), offsets
