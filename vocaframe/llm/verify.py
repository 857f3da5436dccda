"""Exact check of candidate pairs of token sets that stay in their texts.

Pairs are small; sets are not.  The sets are read from the texts that hold
them, joined with the (broadcast, if small) list of where each is needed, and
shuffled once to the pair's first vertex, whose set is compared with all
others there.  A vertex with many partners is split by salt, with a copy of
its set for each salt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .io import batch, lean, small, table, whole

PARTNERS = 512
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = whole(batches)
        if t is None:
            return
        a, salt, vid = (t[c].to_numpy() for c in ("a", "salt", "vid"))
        sets = t["tokens"]  # several chunks beyond 2 GiB
        first = vid == a
        order = np.lexsort((~first, salt, a))
        out, own, at = [], None, None
        for r in order.tolist():
            tokens = np.frombuffer(sets[r].as_buffer(), np.uint64)
            if first[r]:
                own, at = tokens, (a[r], salt[r])
            elif at == (a[r], salt[r]):
                both = np.concatenate((own, tokens))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    out.append((a[r], vid[r]))
        if out:
            got = np.array(out, np.int64)
            yield batch(_PAIRS, got[:, 0], got[:, 1])

    return run


def routes(pairs: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """``a, salt, vid, doc_id``: where each vertex of the pairs ``(a, b)`` is
    needed, with a document that holds it; ``a`` itself is at each salt."""
    pairs = table(pairs.where("a != b").distinct(), f"{name}_pairs")
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / PARTNERS))
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    needs = salted.select("a", "salt", F.col("b").alias("vid")).unionByName(salted.select("a", "salt", F.col("a").alias("vid")).distinct())
    return table(needs.join(places, "vid"), f"{name}_needs")


def matching_pairs(pairs: DataFrame, docs: DataFrame, places: DataFrame, sets_of: Callable, percent: int, name: str) -> DataFrame:
    """The pairs ``(a, b)`` whose sets reach a Jaccard similarity of
    ``percent`` hundredths.

    ``docs``: doc_id, text; ``places``: ``vid, doc_id``, a document that holds
    each vertex; ``sets_of``: a mapInArrow function from doc_id, text to
    ``doc_id, vid, tokens`` (sorted distinct 64-bit tokens)."""
    needs = routes(pairs, places, name)
    texts = docs.join(small(needs.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "text")
    sets = texts.mapInArrow(lean(sets_of), "doc_id long, vid long, tokens binary").join(small(needs), ["vid", "doc_id"])
    met = sets.select("a", "salt", "vid", "tokens").repartition("a", "salt").mapInArrow(lean(_compare(percent)), "a long, b long")
    return table(met.distinct(), f"{name}_links")
