"""Speaker similarity: cosine of every reference against one target."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name
from ..functions.vectors import COSINE_EPS
from ..session import ship_package
from ..util import materialize
from .places import with_place


def score_references(refs: DataFrame, target: DataFrame, emb_col: str = "embedding") -> DataFrame:
    """Add ``similarity`` (cosine, DOUBLE) of each reference to the target.

    ``target`` must hold one vector (more raise, none gives no rows): it is
    the only thing that is collected and sent to the tasks.  A batch of
    references is one matrix over Arrow's own buffer, multiplied once; no
    join, no shuffle.  Same value as
    :func:`vocaframe.functions.cosine_similarity`: a reference that is null,
    has a null element or another length gives NULL, a zero vector 0."""
    got = target.select(F.col(emb_col).cast("array<double>")).limit(2).collect()
    if len(got) > 1:
        raise ValueError("more than one target")
    if not got or got[0][0] is None:
        return refs.where(F.lit(False)).withColumn("similarity", F.lit(None).cast("double"))
    ship_package(refs.sparkSession)
    vector = got[0][0]
    packed = refs.select(F.struct(*refs.columns).alias("row"), F.col(emb_col).cast("array<double>").alias("v"))
    row = packed.schema["row"].dataType.simpleString()
    out = packed.mapInArrow(_cosines(vector), f"row {row}, similarity double")
    return out.select("row.*", "similarity")


def _cosines(vector: list):
    def run(batches):
        import pyarrow as pa

        whole = all(x is not None for x in vector)
        t = np.array([0.0 if x is None else x for x in vector], float)
        size = max(np.sqrt(t @ t), COSINE_EPS)
        for b in batches:
            lists = b["v"]
            values = lists.values
            good = lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(lists.offsets.to_numpy()) == len(t)) & whole
            if values.null_count:
                holes = np.concatenate(([0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))))[lists.offsets.to_numpy()]
                good &= np.diff(holes) == 0
            out = np.full(b.num_rows, np.nan)
            if good.any():
                flat = values.to_numpy(zero_copy_only=False)
                rows = np.flatnonzero(good)
                x = flat[lists.offsets.to_numpy()[rows][:, None] + np.arange(len(t))]
                out[rows] = x @ t / (np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), COSINE_EPS) * size)
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(out, pa.float64(), mask=~good)], names=["row", "similarity"])

    return run


def top_k(scored: DataFrame, k: int = 10, id_col: str = "vec_id") -> DataFrame:
    """The ``k`` most similar references, ties broken by id.  A global top-k
    (TakeOrderedAndProject): each task keeps k rows, the driver merges k per
    task."""
    return scored.orderBy(F.desc("similarity"), F.asc(id_col)).limit(k)


def ranked(scored: DataFrame, k: int = 10, id_col: str = "vec_id") -> DataFrame:
    """``top_k`` with an explicit ``rank`` column (1..k)."""
    w = Window.orderBy(F.desc("similarity"), F.asc(id_col))
    return top_k(scored, k, id_col).withColumn("rank", F.row_number().over(w))


#: Bytes of target vectors that are sent to the tasks at a time, and cells of a
#: similarity matrix that a task holds.
TARGET_BYTES, CELLS = 64 << 20, 1 << 22
#: Similarities are compared at this many decimals, so that equal vectors tie
#: whatever block they stand in.
COMPARED = 9


def top_k_per_target(refs: DataFrame, targets: DataFrame, k: int = 10, id_col: str = "vec_id", emb_col: str = "embedding",
                     target_bytes: int = TARGET_BYTES) -> DataFrame:
    """``target, rank, <id_col>, similarity``: the ``k`` most similar
    references of each target (rank from 1), ties broken by id; a reference
    with the target's id is left out.

    The targets are numbered and sent to the tasks in slices of
    ``target_bytes``, each of which meets all references as matrix products,
    a block at a time.  A task keeps one list of ``k`` a target whatever it
    reads, and those lists are merged by target: no row is ever paired with
    all others in a join, and nothing is collected but a slice.

    Null vectors, null elements and null ids never match; vectors of
    different length are not compared; a target without any match has no
    rows.  A target id that occurs twice is ranked once, over both vectors'
    references; repeated references each take a rank."""
    spark = refs.sparkSession
    ship_package(spark)
    kind = dict(refs.dtypes)[id_col]
    clean = targets.select(F.col(id_col).cast("long").alias("target"), F.col(emb_col).cast("array<double>").alias("v"))
    clean = clean.where(F.col("target").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & (F.array_size("v") > 0))
    numbered = materialize(with_place(clean, "target"), "targets")
    n, longest = numbered.agg(F.count(F.lit(1)), F.max(F.array_size("v"))).first()
    step = max(1, target_bytes // (8 * (longest or 1)))
    slim = refs.select(F.col(id_col).cast("long").alias("id"), F.col(emb_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull())
    lists = spark.createDataFrame([], "target long, id long, similarity double")
    for first in range(0, n, step):
        some = numbered.where((F.col("place") >= first) & (F.col("place") < first + step)).toArrow()
        sent = spark.sparkContext.broadcast(_matrices(some["target"].to_pylist(), some["v"].to_pylist()))
        lists = lists.unionByName(slim.mapInArrow(_nearest(sent, k), "target long, id long, similarity double"))
    best = Window.partitionBy("target").orderBy(F.desc("similarity"), F.asc("id"))
    merged = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.select("target", F.col("rank").cast("bigint").alias("rank"), F.col("id").cast(kind).alias(id_col), "similarity")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), COSINE_EPS)[:, None]


def _matrices(ids: list, vectors: list) -> dict:
    """Target ids and unit vectors by length."""
    groups: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        groups.setdefault(len(v), []).append(i)
    return {size: (np.array([ids[i] for i in own], np.int64), _unit(np.array([vectors[i] for i in own], float))) for size, own in groups.items()}


class _Lists:
    """The ``k`` best references of each target, over any number of blocks."""

    def __init__(self, targets: np.ndarray, matrix: np.ndarray, k: int) -> None:
        self.targets, self.matrix, self.k = targets, matrix, k
        self.scores = np.full((len(targets), k), -np.inf)
        self.ids = np.full((len(targets), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        step = max(1, CELLS // len(ids))
        for s in range(0, len(self.targets), step):
            e = min(s + step, len(self.targets))
            scores = np.round(self.matrix[s:e] @ x.T, COMPARED) + 0.0
            scores[self.targets[s:e, None] == ids] = -np.inf
            if len(ids) > self.k:
                least = np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            else:
                least = np.full(e - s, -np.inf)
            least = np.maximum(least, self.scores[s:e].min(axis=1))
            row, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
            # old and new candidates of each target, the best first
            row = np.concatenate((row, np.repeat(np.arange(e - s), self.k)))
            score = np.concatenate((scores[row[:len(column)], column], self.scores[s:e].ravel()))
            who = np.concatenate((ids[column], self.ids[s:e].ravel()))
            order = np.lexsort((who, -score, row))
            row = row[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            kept = order[place < self.k]
            self.scores[s:e] = score[kept].reshape(-1, self.k)
            self.ids[s:e] = who[kept].reshape(-1, self.k)


def _nearest(sent, k: int):
    def run(batches):
        import pyarrow as pa

        lists: dict[int, _Lists] = {}
        for b in batches:
            vectors, ids = b["v"], b["id"].to_numpy()
            edges = vectors.offsets.to_numpy()
            sizes = np.diff(edges)
            values = vectors.values
            good = vectors.is_valid().to_numpy(zero_copy_only=False)
            if values.null_count:
                holes = np.concatenate(([0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))))[edges]
                good &= np.diff(holes) == 0
            flat = values.to_numpy(zero_copy_only=False)
            for size, (targets, matrix) in sent.value.items():
                rows = np.flatnonzero(good & (sizes == size))
                if len(rows):
                    if size not in lists:
                        lists[size] = _Lists(targets, matrix, k)
                    lists[size].add(ids[rows], _unit(flat[edges[rows][:, None] + np.arange(size)]))
        for found in lists.values():
            real = found.scores > -np.inf
            columns = (np.repeat(found.targets, real.sum(axis=1)), found.ids[real], found.scores[real])
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["target", "id", "similarity"])

    return run


def by_base_name(scored: DataFrame, path_col: str = "path", order_col: str = "vec_id") -> DataFrame:
    """One row per file base name: the score of the *last* reference with that
    name, at the position of the *first* (dict-overwrite semantics).
    Partial aggregates only: a hot name is combined map-side."""
    named = scored.withColumn("name", base_name(path_col))
    return named.groupBy("name").agg(
        F.max_by("similarity", order_col).alias("similarity"),
        F.min(order_col).alias("first_pos"),
    )


def csv_lines(named: DataFrame, digits: int = 4) -> DataFrame:
    """Add ``line``: ``name,0.1234`` (no header); order by ``first_pos``."""
    return named.withColumn("line", F.format_string(f"%s,%.{digits}f", F.col("name"), F.col("similarity")))


def write_csv(named: DataFrame, path: str, digits: int = 4) -> None:
    """Text sink of the CSV lines, globally ordered by first position (range
    partitioned sort, so part files are in order)."""
    csv_lines(named, digits).orderBy("first_pos").select("line").write.mode("overwrite").text(path)
