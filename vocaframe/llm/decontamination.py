"""Benchmark decontamination: training passages queried against an inverted
index of the test items, by BM25 with block-max pruning.

* Items are indexed by length class: up to 32, 64, 128, ... words.  For each
  class every document is cut into overlapping passages, two neighbouring
  segments of the class's length, so that each stretch as long as an item lies
  whole in some passage.  Every passage of every document is a query.  What is
  found of an item does not depend on the lengths of other items.
* Words are runs of characters but ASCII marks, A-Z folded.  In scripts written
  without spaces (Han, kana, Thai, Lao, Khmer, Myanmar) each character is a
  word, and full-width marks part words, so that items are found inside
  running text; word pairs are then pairs of characters.
* An item's score for a passage is the sum of the BM25 impacts of the distinct
  item words that the passage holds, divided by the item's sum over all its
  words: 1 when the passage holds every word of the item.
* The index keeps, for each word and block of items, the largest impact
  (block maxima).  As in WAND, the commonest words of an item, as long as
  their impacts together stay below ``slack``, are not looked up at first:
  ``sum of block maxima + slack of the block`` bounds the score of every item
  of a block.  Only (passage, block) pairs whose bound reaches the threshold
  are scored, exactly, and all items that reach it are retrieved.  Bounds are
  computed for a whole slice of passages at a time.
* A retrieved item counts as found when the passage also holds enough of the
  word pairs of its question (all but the last sentence; the first half of the
  words of a single sentence) and of its answer (the rest).  A part without
  word pairs asks for nothing more.  An item of one word has no pairs at all:
  it is found only in documents that consist of that word.

The index is broadcast in slices of at most ``INDEX_BYTES`` of item text; a
larger benchmark is matched slice by slice.  Document frequencies and the mean
length are those of all items.  ``passage`` counts segments of the item's class.

Cases: null or empty texts have no passages; items without words are never
found; an empty benchmark finds nothing; repeated documents and items are each
matched; a null doc_id or item_id is carried through.  Texts are processed
whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .io import lean, prepare

INDEX_BYTES = 64 << 20
BLOCK = 8
K1, B = 1.2, 0.75
SHORTEST = 32
_ENDS = re.compile(r"[.!?]+(?:\s+|$)|[。！？]+\s*")

#: Code points of scripts written without spaces.
ALONE = np.array([(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)])
#: Marks of these scripts, and full-width ones.
MARKS = np.array([(0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)])


def _within(points: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    at = np.maximum(np.searchsorted(ranges[:, 0], points, "right") - 1, 0)
    return (points >= ranges[at, 0]) & (points <= ranges[at, 1])


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each row plus the total)."""
    starts, ends, first = K.word_spans(data, offsets, K.NOT_WORD)
    lead = np.flatnonzero(data >= 0xE0)  # first bytes of characters of three or four bytes
    four = data[lead] >= 0xF0
    b0, b1, b2, b3 = (np.append(data, np.zeros(3, np.uint8))[lead + k].astype(np.int64) & (0x3F if k else 0x0F) for k in range(4))
    point = np.where(four, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3, b0 << 12 | b1 << 6 | b2)
    mark = _within(point, MARKS)
    own = mark | _within(point, ALONE)
    if own.any():  # words end before such a character and begin after it
        cuts = np.unique(np.concatenate((starts, lead[own], (lead + 3 + four)[own])))
        limit = ends[np.searchsorted(starts, cuts, "right") - 1]
        cuts, limit = cuts[cuts < limit], limit[cuts < limit]
        ends = np.minimum(np.append(cuts[1:], len(data)), limit)
        stay = ~np.isin(cuts, lead[mark], assume_unique=True)
        starts, ends = cuts[stay], ends[stay]
        first = np.searchsorted(starts, offsets)
    return K.range_hash(data, starts, ends), first


def _words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return _hashes(raw, np.array([0, len(raw)]))[0]


def _pairs(hashes: np.ndarray) -> np.ndarray:
    return K.distinct(K.shingles(hashes, 2))


def _border(text: str, n_words: int) -> int:
    """Words of the question: all but the last sentence; one sentence is cut
    in the middle of its words."""
    ends = [m.end() for m in _ENDS.finditer(text)]
    cuts = [e for e in ends if text[e:].strip() and text[:e].strip()]
    return len(_words(text[:cuts[-1]])) if cuts else n_words // 2


def _parts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word pairs of the question, and those that end in the answer (a pair
    across the border is the answer's, so that one word is enough)."""
    all_words = _words(text)
    if len(all_words) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pairs = K.shingles(all_words, 2)
    border = max(_border(text, len(all_words)) - 1, 0)
    return K.distinct(pairs[:border]), K.distinct(pairs[border:])


class Index:
    """The block-max index of a list of ``(item_id, text)`` of at most
    ``half`` words each."""

    def __init__(self, items: list[tuple], half: int, frequency: dict[int, int], n_items: int, mean_words: float, slack: float) -> None:
        self.ids = [i for i, _ in items]
        self.items: list[tuple[np.ndarray, np.ndarray]] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.lengths: list[int] = []
        self.half = half
        postings: list[tuple[int, int, float]] = []
        self.slack = np.zeros(-(-max(len(items), 1) // BLOCK))
        for d, (_, text) in enumerate(items):
            hashes = _words(text or "")
            self.lengths.append(len(hashes))
            terms, times = np.unique(hashes, return_counts=True)
            df = np.array([frequency.get(int(t), 1) for t in terms.view(np.int64)], float)
            idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
            impact = idf * times * (K1 + 1) / (times + K1 * (1 - B + B * len(hashes) / max(mean_words, 1)))
            impact = impact / impact.sum() if len(terms) else impact
            self.items.append((terms, impact))
            self.parts.append(_parts(text or ""))
            common_first = np.lexsort((terms, -df))
            sums = np.cumsum(impact[common_first])
            left_out = int(np.searchsorted(sums, slack, "right"))
            if left_out:
                self.slack[d // BLOCK] = max(self.slack[d // BLOCK], sums[left_out - 1])
            postings += [(int(terms[t]), d // BLOCK, float(impact[t])) for t in common_first[left_out:]]
        best: dict[tuple[int, int], float] = {}
        for term, block, impact in postings:
            best[term, block] = max(best.get((term, block), 0.0), impact)
        rows = sorted(best.items())
        self.terms, self.start = np.unique(np.array([k[0] for k, _ in rows], np.uint64), return_index=True)
        self.start = np.append(self.start, len(rows))
        self.block = np.array([k[1] for k, _ in rows], np.int64)
        self.best = np.array([v for _, v in rows], float)

    def find(self, hashes: np.ndarray, first: np.ndarray, threshold: float, overlap: float) -> Iterator[tuple[int, int, int, float, float, float]]:
        """(row, item number, passage, score, question and answer overlap)."""
        if not len(self.terms):
            return
        half = self.half
        blocks = len(self.slack)
        count = np.maximum(-(-np.diff(first) // half), 1)
        base = np.concatenate(([0], np.cumsum(count)))
        row = np.repeat(np.arange(len(count)), np.diff(first))
        segment = base[row] + (np.arange(len(hashes)) - first[row]) // half
        # block maxima of the looked-up words, summed by segment and block
        term = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[term] == hashes)
        term = term[hit]
        fan = self.start[term + 1] - self.start[term]
        place = np.repeat(self.start[term] - (np.cumsum(fan) - fan), fan) + np.arange(fan.sum())
        keys, at = np.unique(np.repeat(segment[hit], fan) * blocks + self.block[place], return_inverse=True)
        if not len(keys):
            return
        sums = np.bincount(at, self.best[place])
        owner = np.repeat(np.arange(len(count)), count)
        # a passage is a segment and the next one of its document
        inside = owner[keys // blocks]
        earlier = keys[(keys // blocks) > base[inside]] - blocks
        passages = np.unique(np.concatenate((keys, earlier)))

        def total(k: np.ndarray) -> np.ndarray:
            i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            return np.where(keys[i] == k, sums[i], 0.0)

        owners = owner[passages // blocks]
        more = passages // blocks + 1 < base[owners + 1]
        bound = total(passages) + np.where(more, total(passages + blocks), 0.0) + self.slack[passages % blocks]
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for key in passages[bound >= threshold - 1e-9]:
            p, block = int(key) // blocks, int(key) % blocks
            r = int(owner[p])
            if p not in kept:
                kept.clear()
                begin = first[r] + (p - base[r]) * half
                own = hashes[begin:min(begin + 2 * half, first[r + 1])]
                kept[p] = K.distinct(own), _pairs(own)
            words, pairs = kept[p]
            for d in range(block * BLOCK, min((block + 1) * BLOCK, len(self.items))):
                terms, impact = self.items[d]
                score = float(impact[np.isin(terms, words, assume_unique=True)].sum()) if len(terms) else 0.0
                if score >= threshold and (self.lengths[d] > 1 or first[r + 1] - first[r] == 1):
                    shares = [float(np.isin(x, pairs, assume_unique=True).mean()) if len(x) else 1.0 for x in self.parts[d]]
                    if min(shares) >= overlap:
                        yield r, d, p - int(base[r]), score, *shares


_HIT = pa.struct([("item_id", pa.int64()), ("passage", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())])


def indexes(items: list[tuple], frequency: dict[int, int], n_items: int, mean_words: float, slack: float) -> list[Index]:
    """An index for each length class of ``(item_id, text)``."""
    classes: dict[int, list[tuple]] = {}
    for item in items:
        classes.setdefault(max(SHORTEST, 1 << (len(_words(item[1] or "")) - 1).bit_length()), []).append(item)
    return [Index(classes[half], half, frequency, n_items, mean_words, slack) for half in sorted(classes)]


def _match(index, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits: list[dict[tuple, dict]] = [{} for _ in range(b.num_rows)]
            for at, data, offsets in K.chunks(b["text"]):
                hashes, first = _hashes(data, offsets)
                for part in index.value:
                    for r, d, passage, score, question, answer in part.find(hashes, first, threshold, overlap):
                        old = hits[at + r].get((part.half, d))
                        if old is None or score > old["score"]:
                            hits[at + r][part.half, d] = dict(item_id=part.ids[d], passage=passage, score=score, question=question, answer=answer)
            found = [(old or []) + list(new.values()) for old, new in zip(b["hits"].to_pylist(), hits)]
            yield pa.RecordBatch.from_arrays([b["row"], b["text"], pa.array(found, pa.list_(_HIT))], names=["row", "text", "hits"])

    return run


def find_items(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.5, slack: float = 0.3) -> DataFrame:
    """``docs`` with a column ``hits``: for every test item found in the text,
    ``item_id``, the best ``passage`` (from 0), its ``score`` and the shares of
    the ``question`` and the ``answer`` that it holds."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n_items, size, = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    slices = max(1, math.ceil(size / INDEX_BYTES))
    keep = [c for c in docs.columns if c not in ("text", "hits")]
    schema = "array<struct<item_id:long,passage:long,score:double,question:double,answer:double>>"
    out = docs.select(F.struct(F.lit(0).alias("_"), *keep).alias("row"), F.col("text").cast("string").alias("text"), F.lit(None).cast(schema).alias("hits"))
    row = out.schema["row"].dataType.simpleString()
    tokens = items.select(F.xxhash64("item_id", "text").alias("h"), "text").mapInArrow(lean(_item_words), "h long, word long, times long")
    mean = (tokens.agg(F.sum("times")).first()[0] or 0) / max(n_items, 1)
    for s in range(slices):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s)
        here = tokens.where(F.pmod("h", F.lit(slices)) == s).select("word").distinct() if slices > 1 else None
        counted = tokens.groupBy("word").agg(F.count("*").alias("df"))
        counted = counted.join(here, "word", "left_semi") if here is not None else counted
        texts = sorted(((r.item_id, r.text) for r in mine.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))  # at most about INDEX_BYTES
        frequency = {r.word: r.df for r in counted.collect()}
        index = spark.sparkContext.broadcast(indexes(texts, frequency, n_items, mean, slack))
        out = out.mapInArrow(lean(_match(index, threshold, overlap)), f"row {row}, text string, hits {schema}")
    return out.select(*[F.col("row")[c].alias(c) if c != "text" else F.col("text") for c in docs.columns if c != "hits"], "hits")


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own, words, times = [], [], []
        for h, text in zip(b["h"].to_pylist(), b["text"].to_pylist()):
            terms, counts = np.unique(_words(text), return_counts=True)
            words.append(K.signed(terms))
            times.append(counts)
            own.append(np.full(len(terms), h, np.int64))
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.concatenate(words)), pa.array(np.concatenate(times), pa.int64())], names=["h", "word", "times"])


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document and test item found in it."""
    hits = find_items(docs, benchmark, **options).select("doc_id", F.explode("hits").alias("hit"))
    return hits.select("doc_id", "hit.item_id", "hit.passage", "hit.score", F.col("hit.question").alias("question_overlap"), F.col("hit.answer").alias("answer_overlap"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no test item."""
    return find_items(docs, benchmark, **options).where("size(hits) = 0").select(*docs.columns)
