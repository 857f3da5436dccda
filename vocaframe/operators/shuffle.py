"""Reproducible shuffling of training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import with_place


def shuffle_key(seed: int, *key_cols: str) -> Column:
    """``md5("seed|key|key...")``: the order of the permutation, which any
    system can recompute."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols]).cast("binary"))


def shuffle_places(df: DataFrame, seed: int, *key_cols: str) -> DataFrame:
    """``df`` with ``place``: each row's place (bigint, from 0) in a random
    permutation of the whole table, by :func:`shuffle_key` and then the keys."""
    keyed = df.withColumn("_shuffle_key", shuffle_key(seed, *key_cols))
    return with_place(keyed, "_shuffle_key", *key_cols).drop("_shuffle_key")


def shuffle_samples(df: DataFrame, seed: int, *key_cols: str, shards: int | None = None) -> DataFrame:
    """Random permutation keyed by a hash of ``(seed, key)``.

    The order depends only on the seed and the keys, not on partitioning or
    task retries (``rand(seed)`` promises neither).  Without ``shards`` this
    is one global range-partitioned sort.  With ``shards`` the result has so
    many partitions, each in order, which hold ``ceil(n / shards)`` rows of
    the permutation one after the other; the last ones hold the rest."""
    if not shards:
        return df.orderBy(shuffle_key(seed, *key_cols), *key_cols)
    if shards < 1:
        raise ValueError("shards must be positive")
    placed = shuffle_places(df, seed, *key_cols)
    size = max(1, -(-placed.count() // shards))
    dealt = placed.repartitionById(shards, F.floor(F.col("place") / size).cast("int"))
    return dealt.sortWithinPartitions("place").drop("place")
