"""Quality classifier: similarity-weighted vote of nearest labelled texts.

A text becomes a vector of *forms* (how it is written, in any language):
hashed trigrams of character classes with runs of letters taken as one, and
soft bins of shares such as repeated words, distinct words, capitals, digits,
marks, word and line length.  Labelled texts span a latent semantic space: the
weighted form matrix of a bounded training sample is factored, and its leading
right singular vectors project every text.  A document's neighbours are the
training vectors of greatest cosine, found exactly by blocked products of all
documents with all (broadcast) training vectors; each votes for its label with
its similarity to a power.

The sample takes the rows of each label with the smallest hash of their id, at
most ``MAX_TRAIN / 2`` of each; votes are weighted back to the share of the
labels among all training rows.  The model has a fixed size (about
``MAX_TRAIN * RANK`` numbers) and is broadcast.

Cases: null counts as the empty text, which has a score like any other; of
conflicting labels for one id the smaller counts; without labels of both kinds
the score is the share of label 1 (1 without any label); repeated rows get the
same score.  Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .io import lean, prepare

#: Most labelled rows that the classifier is fitted on.
MAX_TRAIN = 4096
HASHED = 1021
BINS = 12
RANK = 48
NEIGHBOURS = 24
POWER = 8

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE = range(5)
_CLASS = np.zeros(256, np.int64)
_MARKS = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
_CLASS[_MARKS] = np.arange(5, 5 + len(_MARKS))
_CLASS[0x41:0x5B] = _UPPER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[:0x21] = _SPACE
_CLASS[0x0A] = _LINE
_N = 5 + len(_MARKS)
SHARES = 10


def _share(values: np.ndarray, cuts: np.ndarray, total: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values)))[cuts]
    return np.diff(sums) / np.maximum(total, 1)


def forms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of raw forms for each text: hashed trigrams, then soft bins."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    kind = _CLASS[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | (kind[1:] >= 5)
    inner = offsets[:-1][offsets[:-1] < len(kind)]
    keep[inner] = True
    at = np.flatnonzero(keep)
    run = kind[at]
    own = np.searchsorted(offsets, at, "right") - 1
    tri = np.zeros((n, HASHED))
    if len(run) > 2:
        code = (run[:-2] * _N + run[1:-1]) * _N + run[2:]
        inside = own[:-2] == own[2:]
        tri = np.bincount((own[:-2] * HASHED + (code * 2654435761 >> 7) % HASHED)[inside], minlength=n * HASHED).reshape(n, HASHED).astype(float)
    starts, ends, first = K.word_spans(data, offsets)
    hashes = K.range_hash(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    words = np.diff(first)
    row = np.repeat(np.arange(n), words)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((hashes, row)) if len(hashes) else np.zeros(0, np.int64)
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    shares = np.stack([
        _share(again, first, words),
        _share(new, first, words),
        _share(kind == _UPPER, offsets, size),
        _share(kind == _DIGIT, offsets, size),
        _share(kind >= 5, offsets, size) * 2,
        _share(kind == _LINE, offsets, size) * 8,
        np.minimum(_share(ends - starts, first, words) / 24, 1),
        np.minimum(np.log1p(words) / 10, 1),
        _share(data >= 0x80, offsets, size),
        np.minimum(_share(kind >= 5, offsets, words) / 3, 1),
    ], axis=1)
    place = np.clip(np.sqrt(np.clip(shares, 0, 1)), 0, 1) * (BINS - 1)
    soft = np.clip(1 - np.abs(place[:, :, None] - np.arange(BINS)), 0, 1)
    soft[:, :2] *= 2  # repetition says most
    soft = soft.reshape(n, SHARES * BINS)
    return np.concatenate([np.log1p(tri), soft], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """Weights of the forms, projection, and the labelled vectors."""

    def __init__(self, raw: np.ndarray, labels: np.ndarray, share: float) -> None:
        self.share, self.vectors = share, None
        if not len(labels) or labels.min() == labels.max():
            return
        seen = (raw > 0).sum(axis=0)
        self.weight = np.log((1 + len(raw)) / (1 + seen))
        self.weight[HASHED:] = 1
        x = self.weigh(raw)
        # right singular vectors, from the small Gram matrix of the forms
        _, right = np.linalg.eigh(x.T.astype(float) @ x)
        self.basis = right[:, ::-1][:, :RANK].astype(np.float32)
        self.vectors = _unit(x @ self.basis).astype(np.float32)
        counts = np.bincount(labels, minlength=2)
        self.vote = np.where(labels == 1, share / counts[1], (1 - share) / counts[0])
        self.labels = labels

    def weigh(self, raw: np.ndarray) -> np.ndarray:
        return np.concatenate([_unit(raw[:, :HASHED] * self.weight[:HASHED]), _unit(raw[:, HASHED:])], axis=1).astype(np.float32)

    def score(self, raw: np.ndarray) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(raw), self.share)
        out = np.empty(len(raw))
        for s in range(0, len(raw), 512):
            cosine = _unit(self.weigh(raw[s:s + 512]) @ self.basis) @ self.vectors.T
            k = min(NEIGHBOURS, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(cosine, near, axis=1), 1e-6, 1).astype(float) ** POWER * self.vote[near]
            out[s:s + 512] = (weight * (self.labels[near] == 1)).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def held_out(doc_id: Column) -> Column:
    """Rows never used for training: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, data, offsets in K.chunks(b["text"]):
            rows = forms(data, offsets).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b["quality"].slice(at, len(rows)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["quality", "forms"])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most ``max_train`` labelled rows (the bound of the sample)."""
    prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    totals = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = totals.get(1, 0) / max(sum(totals.values()), 1) if totals else 1.0
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw, marks = [], []
    for quality in (0, 1):
        some = known.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train // 2)
        picked = texts.join(F.broadcast(some), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_train // 2)
        for r in picked.select("quality", "text").mapInArrow(lean(_features), "quality int, forms binary").collect():
            raw.append(np.frombuffer(r.forms, np.float32))
            marks.append(r.quality)
    return Model(np.array(raw, float).reshape(len(raw), HASHED + SHARES * BINS), np.array(marks, np.int64), share)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.value.score(forms(data, offsets)) for _, data, offsets in K.chunks(b["text"])]
            yield pa.RecordBatch.from_arrays([b["row"], b["text"], pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["row", "text", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``: 0 to 1, higher when label 1 is likelier."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("text", "score")]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *names).alias("row"), F.col("text").cast("string").alias("text"))
    row = packed.schema["row"].dataType.simpleString()
    out = packed.mapInArrow(lean(_score(shared)), f"row {row}, text string, score double")
    return out.select(*[F.col("row")[c].alias(c) if c != "text" else F.col("text") for c in docs.columns if c != "score"], "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``."""
    return score(docs, fit(docs, labels)).where(F.col("score") >= threshold).select(*docs.columns)
