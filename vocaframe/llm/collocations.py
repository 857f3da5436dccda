"""Phrase collocation mining by direct-address tiling.

The words of each language are numbered by frequency.  Two neighbouring ids
are a pair, a cell of a square matrix that is cut into tiles.  The tiles of
the most frequent ids are dense: a task counts them with one ``bincount`` into
flat vectors.  All other tiles are sparse: a task sends sorted coordinate
lists (pairs and counts in two arrays), a list for each part of the matrix,
and the lists of a part are merged.  Pairs that are frequent enough are
numbered by frequency again, and neighbouring pairs (which share a word) are
counted in the same way: a pair of m-grams is an (m+1)-gram, up to
``max_words``.

The corpus is kept as sequences of ids, one table a level.  The frequent items
of a level are broadcast if there are ``id_limit`` at most; beyond that each
slice of the corpus gets the list of its own frequent items through a join.

Cases: a null language counts as ``und``, a null or empty text has no words;
words of every length are kept whole; repeated rows count each time.  Phrases
never cross a punctuation mark, a line end or a document.  Equal scores are
ordered by count, then by the phrase's bytes.  An empty table has no phrases.
Columns other than ``lang`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.places import with_place
from . import kernel as K
from .io import lean, prepare, table

#: Ids 1 to HEAD are frequent: their tiles (TILES * TILES of them) are dense.
HEAD, TILES = 1024, 4
SLICE_BYTES = 1 << 20
#: Partial sums of a dense tile; pairs that a task merges at a time.
SALTS, MERGE = 16, 1 << 20
#: Frequent items of a level that are broadcast at most (24 bytes each).
ID_LIMIT = 1 << 21

_BREAK = K._lut(b".,;:!?\n\x0b\x0c\r")
_APART = _BREAK | K._lut(b" \t")


# --- words ---------------------------------------------------------------------

def _distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each word, the distinct words): compared as bytes, not by hash."""
    sizes = ends - starts
    total = np.cumsum(sizes)
    raw = data[np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1])]
    offsets = np.concatenate(([0], total)).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


class Words:
    """The words of a slice of texts: ``local`` is the number of each one's
    (language, word) in ``langs`` and ``words``, which occur ``counts`` times;
    ``places`` their places in a sequence where 0 stands between pieces."""

    def __init__(self, langs: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        data = K.FOLD[data]
        starts, ends, first = K.word_spans(data, offsets, _APART)
        self.size = len(starts)
        if not self.size:
            return
        piece = np.cumsum(_BREAK[data], dtype=np.int64)[starts]
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        apart = np.concatenate(([False], (np.diff(piece) != 0) | (np.diff(doc) != 0)))
        self.places = np.arange(self.size) + np.cumsum(apart)
        number, distinct = _distinct_words(data, starts, ends)
        coded = langs.dictionary_encode()
        lang = coded.indices.to_numpy().astype(np.int64)[doc]
        keys, self.local, self.counts = np.unique(lang * len(distinct) + number, return_inverse=True, return_counts=True)
        self.words = distinct.take(pa.array(keys % len(distinct))).cast(pa.large_string()).cast(pa.string())
        self.langs = coded.dictionary.take(pa.array(keys // len(distinct)))

    def sequence(self, ids: np.ndarray) -> np.ndarray:
        """The sequence of global ids, from those of the distinct words."""
        out = np.zeros(int(self.places[-1]) + 1, np.int64)
        out[self.places] = ids[self.local]
        return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Words]]:
    number = TaskContext.get().partitionId() << 32
    for b in batches:
        for at, data, offsets in K.chunks(b["text"], SLICE_BYTES):
            words = Words(b["lang"].slice(at, len(offsets) - 1), data, offsets)
            if words.size:
                yield number, words
            number += 1


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, w in _slices(batches):
        yield pa.RecordBatch.from_arrays([w.langs, w.words, pa.array(w.counts, pa.int64())], names=["lang", "word", "n"])


def _local_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices under slice-local ids, with their distinct words."""
    for number, w in _slices(batches):
        entries = pa.StructArray.from_arrays([w.langs, w.words], names=["lang", "word"])
        lists = pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries)
        seq = w.sequence(np.arange(1, len(entries) + 1)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([seq.tobytes()], pa.binary()), lists], names=["slice", "seq", "words"])


def _keys(langs: pa.Array, words: pa.Array) -> pa.Array:
    # no word holds a tab
    return pc.binary_join_element_wise(words.cast(pa.string()), langs.cast(pa.string()), "\t")


def _word_ids(known: Broadcast):
    """Sequences of global word ids, from a broadcast list of frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = known.value
        for number, w in _slices(batches):
            at = pc.index_in(_keys(w.langs, w.words), value_set=keys)
            found = np.where(at.is_valid().to_numpy(zero_copy_only=False), ids[pc.fill_null(at, 0).to_numpy()] if len(ids) else 0, 0)
            yield _state(number, w.sequence(found))

    return run


# --- sequences and pairs -----------------------------------------------------------

def _state(number: int, ids: np.ndarray) -> pa.RecordBatch:
    """A row of a level's table.  Zeros in a row become one: only neighbours
    count, and a sequence then takes no more room than its frequent items."""
    keep = ids > 0
    keep[1:] |= ids[:-1] > 0
    ids = ids[keep]
    wide = len(ids) and ids.max() >= 1 << 32
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids.astype(np.int64 if wide else np.uint32).tobytes()], pa.binary()), pa.array([8 if wide else 4], pa.int32())], names=["slice", "seq", "width"])


_STATE_SQL = "slice long, seq binary, width int"


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch, int]]:
    for b in batches:
        for at in range(b.num_rows):
            kind = np.int64 if b["width"][at].as_py() == 8 else np.uint32
            yield b["slice"][at].as_py(), np.frombuffer(b["seq"][at].as_buffer(), kind).astype(np.int64), b, at


class Pairs:
    """Neighbouring ids of a sequence: ``near``, where both are in the head,
    with their ``cells``; ``far``, the others, as the sorted distinct pairs
    ``i, j`` with ``counts`` and the number ``local`` of each place's pair."""

    def __init__(self, ids: np.ndarray, head: int) -> None:
        a, b = ids[:-1], ids[1:]
        both = (a > 0) & (b > 0)
        self.size = len(a)
        self.near = both & (a <= head) & (b <= head)
        self.cells = (a[self.near] - 1) * head + b[self.near] - 1
        self.far = both & ~self.near
        known, number = np.unique(np.concatenate((a[self.far], b[self.far])), return_inverse=True)
        half = len(number) // 2
        keys, self.local, self.counts = np.unique(number[:half] * len(known) + number[half:], return_inverse=True, return_counts=True)
        size = max(len(known), 1)
        self.i, self.j = known[keys // size], known[keys % size]


_COUNT_SQL = "part long, tile int, i binary, j binary, counts binary"


def _count_pairs(head: int, parts: int):
    """Coordinate lists of the sparse pairs by part, and dense tiles."""
    side, names = head // TILES, ["part", "tile", "i", "j", "counts"]

    def rows(part, tile, i, j, counts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(tile, pa.int32()), *[pa.array(x, pa.binary()) for x in (i, j, counts)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(head * head, np.int64)
        salt = TaskContext.get().partitionId() % SALTS
        for _, ids, _, _ in _sequences(batches):
            p = Pairs(ids, head)
            x, y = p.cells // head, p.cells % head
            dense += np.bincount((x // side * TILES + y // side) * (side * side) + x % side * side + y % side, minlength=head * head)
            if len(p.i):
                # a part holds whole tiles of 64 * 4096 cells
                part = (K.mix((p.i >> 6 << 32 | p.j >> 12).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")  # pairs stay sorted within a part
                part = part[order]
                edges = np.flatnonzero(np.diff(part, prepend=-1, append=-2))
                width = np.uint32 if max(int(p.i.max()), int(p.j.max())) < 1 << 32 else np.int64
                lists = [p.i[order].astype(width), p.j[order].astype(width), p.counts[order].astype(np.uint32)]
                cut = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
                yield rows(part[edges[:-1]], [None] * len(cut), *[[x[s:e].tobytes() for s, e in cut] for x in lists])
        tiles = [t for t, counts in enumerate(dense.reshape(TILES * TILES, -1)) if counts.any()]
        if tiles:
            yield rows([-1 - t * SALTS - salt for t in tiles], tiles, [None] * len(tiles), [None] * len(tiles), [dense.reshape(TILES * TILES, -1)[t].tobytes() for t in tiles])

    return run


class _Merged:
    """Coordinate lists of one part, merged whenever ``MERGE`` pairs are held."""

    def __init__(self) -> None:
        self.lists: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> None:
        self.lists.append((i, j, n))
        self.held += len(i)
        if self.held > MERGE:
            self.lists = [self.sums()]
            self.held = 0  # counted anew: what is merged only shrinks

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, n = (np.concatenate(x) for x in zip(*self.lists))
        order = np.lexsort((j, i))
        i, j, n = i[order], j[order], n[order]
        first = np.flatnonzero((np.diff(i, prepend=-1) != 0) | (np.diff(j, prepend=-1) != 0))
        return i[first], j[first], np.add.reduceat(n, first)


_SUM_SQL = "tile int, counts binary, i long, j long, n long"


def _sums(tile, counts, i, j, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tile, pa.int32()), pa.array(counts, pa.binary()), *[pa.array(x, pa.int64()) for x in (i, j, n)]], names=["tile", "counts", "i", "j", "n"])


def _merge(min_count: int):
    """Frequent sparse pairs, and partial sums of dense tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[int, np.ndarray] = {}
        merged: dict[int, _Merged] = {}
        for b in batches:
            for part, tile, i, j, counts in zip(b["part"].to_pylist(), b["tile"].to_pylist(), b["i"], b["j"], b["counts"]):
                if tile is not None:
                    more = np.frombuffer(counts.as_buffer(), np.int64)
                    tiles[tile] = tiles[tile] + more if tile in tiles else more
                else:
                    n = np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64)
                    width = np.uint32 if i.as_buffer().size == 4 * len(n) else np.int64
                    merged.setdefault(part, _Merged()).add(*[np.frombuffer(x.as_buffer(), width).astype(np.int64) for x in (i, j)], n)
        for m in merged.values():
            i, j, n = m.sums()
            keep = n >= min_count
            if keep.any():
                k = int(keep.sum())
                yield _sums([None] * k, [None] * k, i[keep], j[keep], n[keep])
        for tile, counts in tiles.items():
            yield _sums([tile], [counts.tobytes()], [None], [None], [None])

    return run


def _cells(head: int):
    """The counted cells of summed tiles; pairs pass."""
    side = head // TILES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[int, np.ndarray] = {}
        for b in batches:
            sparse = b.filter(b["tile"].is_null())
            if sparse.num_rows:
                yield sparse
            for tile, counts in zip(b["tile"].to_pylist(), b["counts"]):
                if tile is not None:
                    more = np.frombuffer(counts.as_buffer(), np.int64)
                    tiles[tile] = tiles[tile] + more if tile in tiles else more
        for tile, counts in tiles.items():
            cell = np.flatnonzero(counts)
            k = len(cell)
            yield _sums([None] * k, [None] * k, tile // TILES * side + cell // side + 1, tile % TILES * side + cell % side + 1, counts[cell])

    return run


def _pair_counts(state: DataFrame, head: int, min_count: int) -> DataFrame:
    """``i, j, n``: neighbouring ids with ``min_count`` occurrences."""
    parts = 4 * int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = state.mapInArrow(lean(_count_pairs(head, parts)), _COUNT_SQL)
    merged = counted.repartition("part").mapInArrow(lean(_merge(min_count)), _SUM_SQL)
    owner = F.coalesce(F.col("tile").cast("long"), -1 - F.pmod(F.xxhash64("i", "j"), F.lit(parts)))
    summed = merged.repartition(owner).mapInArrow(lean(_cells(head)), _SUM_SQL)
    return summed.where(F.col("n") >= min_count).select("i", "j", "n")


def _pair_ids(head: int, dense: Broadcast, known: Broadcast | None):
    """From a level's sequences to the next one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, b, at in _sequences(batches):
            p = Pairs(ids, head)
            out = np.zeros(p.size, np.int64)
            out[p.near] = dense.value[p.cells]
            if len(p.i):
                found = np.zeros(len(p.i), np.int64)
                if known is None:
                    own = b["known"][at].values
                    if own is not None:
                        found[own.field(0).to_numpy(zero_copy_only=False)] = own.field(1).to_numpy(zero_copy_only=False)
                else:
                    keys, values = known.value
                    if len(keys):
                        key = p.i << 32 | p.j  # fewer than 2^32 ids are broadcast
                        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                        found = np.where(keys[place] == key, values[place], 0)
                out[p.far] = found[p.local]
            if out.any():
                yield _state(number, out)

    return run


def _local_pairs(head: int):
    """The sparse pairs of each slice under their local numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, _, _ in _sequences(batches):
            p = Pairs(ids, head)
            if len(p.i):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(p.i), number), np.arange(len(p.i)), p.i, p.j)], names=["slice", "local", "i", "j"])

    return run


def _frequent(counts: DataFrame, min_count: int, *keys: str) -> DataFrame:
    """Items that occur often enough, numbered from 1 by falling count."""
    placed = with_place(counts.where(F.col("n") >= min_count), F.desc("n"), *keys, name="id")
    return table(placed.withColumn("id", F.col("id") + 1), "frequent")


def _known(rows: DataFrame, frequent: DataFrame, keys: list[str]) -> DataFrame:
    """For each slice its own frequent items: ``known array<struct<local, id>>``
    (bounded by the slice)."""
    met = rows.select("slice", "local", *keys).join(frequent.select("id", *keys), keys)
    return met.groupBy("slice").agg(F.collect_list(F.struct("local", "id")).alias("known"))


def _relabel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences of local ids (from 1) under the ids that ``known`` gives."""
    for b in batches:
        for at in range(b.num_rows):
            seq = np.frombuffer(b["seq"][at].as_buffer(), np.int64)
            ids, own = np.zeros(int(seq.max()) + 1, np.int64), b["known"][at].values
            if own is not None:
                ids[own.field(0).to_numpy(zero_copy_only=False) + 1] = own.field(1).to_numpy(zero_copy_only=False)
            yield _state(b["slice"][at].as_py(), ids[seq])


def _word_sequences(read: DataFrame, frequent: DataFrame, id_limit: int) -> DataFrame:
    sc = read.sparkSession.sparkContext
    if frequent.count() <= id_limit:
        got = frequent.select("id", "lang", "word").toArrow().combine_chunks()
        keys = _keys(*(pa.concat_arrays(got[c].chunks) if got.num_rows else pa.array([], pa.string()) for c in ("lang", "word")))
        return table(read.mapInArrow(lean(_word_ids(sc.broadcast((keys, got["id"].to_numpy())))), _STATE_SQL), "sequences")
    slices = table(read.mapInArrow(lean(_local_words), "slice long, seq binary, words array<struct<lang:string,word:string>>"), "slices")
    entries = slices.select("slice", F.posexplode("words").alias("local", "w")).select("slice", "local", "w.*")
    met = slices.select("slice", "seq").join(_known(entries, frequent, ["lang", "word"]), "slice", "left")
    return table(met.mapInArrow(lean(_relabel), _STATE_SQL), "sequences")


def _next_sequences(state: DataFrame, frequent: DataFrame, head: int, id_limit: int) -> DataFrame:
    sc = state.sparkSession.sparkContext
    dense = _dense_ids(frequent, head)
    far = frequent.where((F.col("i") > head) | (F.col("j") > head))
    if far.count() <= id_limit:
        got = far.select((F.col("i") * (1 << 32) + F.col("j")).alias("key"), "id").toArrow().sort_by("key")
        known = sc.broadcast((got["key"].to_numpy(), got["id"].to_numpy()))
        return table(state.mapInArrow(lean(_pair_ids(head, dense, known)), _STATE_SQL), "sequences")
    rows = state.mapInArrow(lean(_local_pairs(head)), "slice long, local long, i long, j long")
    met = state.join(_known(rows, far, ["i", "j"]), "slice", "left")
    return table(met.mapInArrow(lean(_pair_ids(head, dense, None)), _STATE_SQL), "sequences")


def _dense_ids(frequent: DataFrame, head: int) -> Broadcast:
    """Id of each cell of the dense tiles, 0 if it is not frequent: 8 MB at
    every corpus size."""
    got = frequent.where((F.col("i") <= head) & (F.col("j") <= head)).select(((F.col("i") - 1) * head + F.col("j") - 1).alias("cell"), "id").toArrow()
    out = np.zeros(head * head, np.int64)
    out[got["cell"].to_numpy()] = got["id"].to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(out)


def count_phrases(docs: DataFrame, min_count: int = 100, max_words: int = 5, head: int = HEAD, id_limit: int = ID_LIMIT) -> tuple[DataFrame, list[DataFrame]]:
    """(``lang, total``: all words of each language; a table for each length m
    from 1 to ``max_words``).  The tables hold every phrase of m words with
    ``min_count`` occurrences: ``id, n``, for one word ``lang, word``, else
    ``i, j``: the ids of its first and its last m - 1 words.  ``head``: ids
    whose pairs lie in dense tiles (a multiple of ``TILES``), ``id_limit``:
    frequent items that are broadcast; neither changes a result."""
    if head < TILES or head % TILES:
        raise ValueError(f"head must be a multiple of {TILES}")
    prepare(docs.sparkSession)
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = read.mapInArrow(lean(_count_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = table(counts, "words")
    levels = [_frequent(words, min_count, "lang", "word")]
    state = _word_sequences(read, levels[0], id_limit)
    for m in range(2, max_words + 1):
        levels.append(_frequent(_pair_counts(state, head, min_count), min_count, "i", "j"))
        if m < max_words:
            state = _next_sequences(state, levels[-1], head, id_limit)
    return words.groupBy("lang").agg(F.sum("n").alias("total")), levels


def _score(a: str, n: str, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (l * r)), exact: products of 37 digits."""
    top = F.col(a).cast("decimal(16,0)") * (F.col(n).cast("decimal(17,0)") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(20,0)")
    below = left.cast("decimal(18,0)") * right.cast("decimal(18,0)")
    return F.call_function("div", top, below)


def phrases(docs: DataFrame, min_count: int = 100, max_words: int = 5, percent: int = 100, head: int = HEAD, id_limit: int = ID_LIMIT) -> DataFrame:
    """All collocations: ``lang, phrase, words, a, l, r, n, score``.

    ``a``: occurrences of the phrase; ``l`` and ``r``: those of the two parts
    at the cut of the lowest score ``floor(1000 a n / (l r))`` (the first such
    cut); ``n``: words of the language.  A phrase inside a longer one that
    occurs at least ``percent`` hundredths as often is left out; it is enough
    to look at phrases one word longer, as those between occur no less."""
    totals, levels = count_phrases(docs, min_count, max_words, head, id_limit)
    one = F.array("n")
    whole = levels[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", one.alias("pre"), one.alias("suf"))
    out = None
    for m in range(2, max_words + 1):
        left = whole.select(F.col("id").alias("i"), "lang", F.col("phrase").alias("begin"), "pre")
        right = whole.select(F.col("id").alias("j"), F.col("last"), "suf")
        both = levels[m - 1].join(left, "i").join(right, "j")
        # pre[k - 1], suf[k - 1]: occurrences of the first and the last k words
        whole = table(both.select("id", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "n", F.concat("pre", one).alias("pre"), F.concat("suf", one).alias("suf")), "phrases")
        kept = whole
        if m < max_words:
            longer = levels[m].select(F.col("i").alias("id"), "n").unionByName(levels[m].select(F.col("j").alias("id"), "n")).groupBy("id").agg(F.max("n").alias("longest"))
            kept = whole.join(longer, "id", "left").where(F.col("longest").isNull() | (F.lit(100) * F.col("longest") < F.lit(percent) * F.col("n")))
        some = kept.select("lang", "phrase", F.lit(m).cast("long").alias("words"), F.col("n").alias("a"), "pre", "suf")
        out = some if out is None else out.unionByName(some)
    scored = out.join(F.broadcast(totals.withColumnRenamed("total", "n")), "lang")  # a row a language
    cuts = F.transform(F.sequence(F.lit(1), (F.col("words") - 1).cast("int")), lambda k: F.struct(
        _score("a", "n", F.element_at("pre", k), F.element_at("suf", (F.col("words") - k).cast("int"))).alias("score"), k.alias("k"),
        F.element_at("pre", k).alias("l"), F.element_at("suf", (F.col("words") - k).cast("int")).alias("r")))
    best = scored.withColumn("cut", F.array_min(cuts))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def top_phrases(docs: DataFrame, limit: int = 2000, **options) -> DataFrame:
    """The first ``limit`` collocations of each language with their ``rank``
    (from 1).  A language's phrases are cut to ``limit`` in many tasks first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = phrases(docs, **options).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS * 16)))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= limit)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= limit).drop("_salt")
