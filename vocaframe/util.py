from __future__ import annotations

from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Union[Column, str]


def col_of(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: the plan above it runs once, and a lost executor re-reads the
    files instead of recomputing the lineage."""
    from .session import fresh_dir

    path = fresh_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


#: Bytes up to which a side of a join is broadcast.
BROADCAST_BYTES = 64 << 20


def broadcast_up_to(df, row_bytes: int, limit: int = BROADCAST_BYTES):
    """``df`` marked for a broadcast join if its rows, counted first, take
    ``limit`` bytes at most; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
