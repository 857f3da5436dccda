"""Byte-level BPE encoding and decoding over tables.

Pre-tokenisation works without a regular expression.  Every code point has a
class (letter, number, other, space, other white space, and an apostrophe
that begins one of the contractions); a class is a transition function of a
small automaton.  Functions compose associatively, so that the states of all
characters of a slice come from a blocked scan: compose within blocks, scan
over the blocks by doubling, walk the blocks again with the state at their
start.  State and class tell where a piece starts; a document's first
character resets the automaton, so that documents are scanned together.

The byte ranges of the pieces are then encoded.  Equal pieces are encoded once
a slice and kept in a bounded cache; pieces not in the cache are merged
together, one merge of each piece at a time (the lowest rank, leftmost first),
as rows of a matrix; very long pieces go through a heap.  Each id keeps its
byte offset in the text, which is what ``decode`` needs to cut the bytes back
into pieces, and concatenated token bytes give the text.

Cases: a null or empty text has no ids and decodes to empty bytes; texts are
encoded whole.  Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .io import lean, prepare

#: Pieces in each of the two halves of a worker's cache (under 100 MB together).
CACHE = 1 << 17
MATRIX = 64
#: Bytes of text, and ids, that a task works on at a time: several workers
#: share an executor's memory.
TEXT_BYTES, IDS = 1 << 19, 1 << 18

LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE1, QUOTE2 = range(7)
#: Code points of white space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The letters after an apostrophe that make a piece of their own.
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")

# states: what the characters so far end with
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_BLANK, ONE_LEFT, TWO_LEFT, CONTRACTED = range(9)
STATES = 9


def _automaton() -> np.ndarray:
    """``next[symbol, state]``; symbols from 7 on are first characters of a text."""
    out = np.zeros((14, STATES), np.intp)
    for state in range(STATES):
        out[LETTER, state] = {TWO_LEFT: ONE_LEFT, ONE_LEFT: CONTRACTED}.get(state, IN_LETTERS)
        out[NUMBER, state] = IN_NUMBERS
        out[OTHER, state] = IN_OTHERS
        out[SPACE, state] = AFTER_SPACE
        out[BLANK, state] = AFTER_BLANK
        joined = state in (IN_OTHERS, AFTER_SPACE)  # the apostrophe continues a piece
        out[QUOTE1, state] = IN_OTHERS if joined else ONE_LEFT
        out[QUOTE2, state] = IN_OTHERS if joined else TWO_LEFT
    out[7:] = out[:7, START:START + 1]
    return out


def _starts_piece() -> np.ndarray:
    """``starts[symbol, state before]``, but for the last character of white space."""
    out = np.ones((14, STATES), bool)
    out[LETTER, [IN_LETTERS, AFTER_SPACE, ONE_LEFT, TWO_LEFT]] = False
    out[NUMBER, [IN_NUMBERS, AFTER_SPACE]] = False
    for symbol in (OTHER, QUOTE1, QUOTE2):
        out[symbol, [IN_OTHERS, AFTER_SPACE]] = False
    for symbol in (SPACE, BLANK):
        out[symbol, [AFTER_SPACE, AFTER_BLANK]] = False
    return out


NEXT, STARTS = _automaton(), _starts_piece()


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point, from the general categories."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        first = unicodedata.category(chr(c))[0]
        if first in "LN":
            out[c] = LETTER if first == "L" else NUMBER
    out[WHITE] = BLANK
    out[0x20] = SPACE
    return out


def scan(symbols: np.ndarray, block: int = 256) -> np.ndarray:
    """State before every symbol (START before the first)."""
    n = len(symbols)
    rows = -(-n // block)
    padded = np.full(rows * block, BLANK, np.intp)
    padded[:n] = symbols
    step = np.ascontiguousarray(padded.reshape(rows, block).T) * STATES
    table = NEXT.ravel()
    # the transition function of each block
    whole = np.tile(np.arange(STATES), (rows, 1))
    for s in step:
        whole = table[s[:, None] + whole]
    # inclusive scan over blocks: whole[i] becomes the function of blocks 0..i
    d = 1
    while d < rows:
        whole[d:] = np.take_along_axis(whole[d:], whole[:-d], axis=1)
        d *= 2
    state = np.empty(rows, np.intp)
    state[0] = START
    state[1:] = whole[:-1, START]
    out = np.empty((block, rows), np.uint8)
    for i, s in enumerate(step):
        out[i] = state
        state = table[s + state]
    return out.T.ravel()[:n]


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Which code points start a piece; ``firsts`` marks the first of each text."""
    n = len(points)
    symbol = classes()[points]
    blank = (symbol == SPACE) | (symbol == BLANK)
    last_blank = np.zeros(n, bool)
    last_blank[:-1] = blank[:-1] & ~blank[1:] & ~firsts[1:]
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        def at(k: int) -> np.ndarray:  # the k-th code point after the apostrophe, 0 beyond the text
            i = quote + k
            ok = i < n
            i = np.where(ok, i, 0)
            inside = ok.copy()
            for m in range(1, k + 1):
                j = np.minimum(quote + m, n - 1)
                inside &= ~firsts[j]
            return np.where(inside, points[i], 0)

        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in SHORT])
        long = np.zeros(len(quote), bool)
        for a, b in LONG:
            long |= (one == ord(a)) & (two == ord(b))
        symbol[quote[short]] = QUOTE1
        symbol[quote[long]] = QUOTE2
    symbol = symbol + np.uint8(7) * firsts
    return STARTS[symbol, scan(symbol)] | last_blank


class Vocabulary:
    """Ranks of byte strings, with merge and decoding tables."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.known = np.array([bool(t) for t in tokens])
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.none = np.int64(1 << 40)
        # ids of merged pieces: those met lately, and those of the time before
        self.cache: dict[bytes, np.ndarray] = {}
        self.older: dict[bytes, np.ndarray] = {}

    @cached_property
    def pairs(self) -> dict[int, int]:
        """Rank of the token that two ids make, by both ids (for encoding only)."""
        out, get = {}, self.ranks.get
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    out[a << 32 | b] = rank
        return out

    @cached_property
    def pair_keys(self) -> np.ndarray:
        return np.array(sorted(self.pairs), np.int64)

    @cached_property
    def pair_ranks(self) -> np.ndarray:
        return np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[i] == key) & (a >= 0) & (b >= 0), self.pair_ranks[i], self.none)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out = [self.cache.get(piece) for piece in pieces]
        missing: dict[int, list[int]] = {}
        for i, got in enumerate(out):
            if got is None:
                piece = pieces[i]
                got = self.older.get(piece)
                if got is None:
                    rank = self.ranks.get(piece)
                    if rank is None:
                        missing.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
                        continue
                    got = np.array([rank])
                self._keep(piece, got)
                out[i] = got
        for size, rows in missing.items():
            if size > MATRIX:
                for i in rows:
                    out[i] = self._heap(pieces[i])
            else:
                for s in range(0, len(rows), 1 << 14):
                    part = rows[s:s + (1 << 14)]
                    for i, ids in zip(part, self._matrix([pieces[i] for i in part], size)):
                        out[i] = ids
        for rows in missing.values():
            for i in rows:
                if len(pieces[i]) <= MATRIX:
                    self._keep(pieces[i], out[i])
        return out

    def _keep(self, piece: bytes, ids: np.ndarray) -> None:
        """Remember a piece; of a full cache the older half is forgotten."""
        if len(self.cache) >= CACHE:
            self.cache, self.older = {}, self.cache
        self.cache[piece] = ids

    def _matrix(self, pieces: list[bytes], size: int) -> list[np.ndarray]:
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(-1, size)
        ids = np.where(np.arange(size) < lengths[:, None], self.single[raw], -1)
        ranks = np.full((len(pieces), size), self.none)
        ranks[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        done: list = [None] * len(pieces)
        own, column = np.arange(len(pieces)), np.arange(size)
        while len(own):
            at = ranks.argmin(axis=1)
            row = np.arange(len(own))
            best = ranks[row, at]
            ended = best == self.none
            if ended.any():
                for r in np.flatnonzero(ended):
                    done[own[r]] = ids[r][ids[r] >= 0]
                keep = ~ended
                own, ids, ranks, at, best = own[keep], ids[keep], ranks[keep], at[keep], best[keep]
                row = np.arange(len(own))
                if not len(own):
                    break
            moved = np.minimum(column + (column > at[:, None]), size - 1)
            ids = np.take_along_axis(ids, moved, axis=1)
            ranks = np.take_along_axis(ranks, moved, axis=1)
            ids[:, -1], ranks[:, -1] = -1, self.none
            ids[row, at] = best
            right = np.minimum(at + 1, size - 1)
            ranks[row, at] = np.where(right > at, self.rank(best, ids[row, right]), self.none)
            inner = row[at > 0]
            left = at[inner] - 1
            ranks[inner, left] = self.rank(ids[inner, left], best[inner])
        return done

    def _heap(self, piece: bytes) -> np.ndarray:
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n or self.pairs.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := self.pairs.get(ids[i] << 32 | ids[after[j]])) is not None:
                    heapq.heappush(queue, (r, i))
            if before[i] >= 0 and (r := self.pairs.get(ids[before[i]] << 32 | ids[i])) is not None:
                heapq.heappush(queue, (r, before[i]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, byte offset of each id in its text, ids of each text)."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        byte = np.cumsum(size) - size
        firsts = np.zeros(len(points), bool)
        inner = offsets[:-1][offsets[:-1] < len(raw)]
        firsts[np.searchsorted(byte, inner)] = True
        starts = byte[piece_starts(points, firsts)]
        ends = np.append(starts[1:], len(raw))
        hashes = K.range_hash(data, starts, ends, np.arange(256))
        _, lead, own = np.unique(hashes, return_index=True, return_inverse=True)
        pieces = [raw[s:e] for s, e in zip(starts[lead].tolist(), ends[lead].tolist())]
        coded = self.encode_pieces(pieces)
        fan = np.array([len(c) for c in coded])
        flat = np.concatenate(coded)
        begin = (np.cumsum(fan) - fan)[own]
        count = fan[own]
        total = np.cumsum(count)
        ids = flat[np.repeat(begin - (total - count), count) + np.arange(total[-1])]
        lengths = self.lengths[ids]
        at = np.cumsum(lengths) - lengths
        first_piece = np.searchsorted(starts, offsets)
        edges = np.concatenate(([0], total))[first_piece]
        n_ids = np.diff(edges)
        return ids, at - np.repeat(offsets[:-1], n_ids), n_ids

    def decode(self, ids: np.ndarray, n_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all bytes, bytes of each text).  An id outside the vocabulary is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[ids]
        total = np.cumsum(lengths)
        size = int(total[-1]) if len(total) else 0
        out = self.bytes[np.repeat(self.starts[ids] - (total - lengths), lengths) + np.arange(size)]
        return out, np.diff(np.concatenate(([0], total))[np.concatenate(([0], np.cumsum(n_ids)))])


_LOADED: dict[int, Vocabulary] = {}


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


def _vocabulary(content) -> Vocabulary:
    """One table a worker process, made from the broadcast rank file."""
    key = hash(content.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(parse_ranks(content.value))
    return _LOADED[key]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, kind))


def _encode(content):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content)
        for b in batches:
            for at, data, offsets in K.chunks(b["text"], TEXT_BYTES):
                if len(data):
                    ids, places, counts = vocabulary.encode(data, offsets)
                else:
                    ids = places = np.zeros(0, np.int64)
                    counts = np.zeros(len(offsets) - 1, np.int64)
                rows = b["row"].slice(at, len(counts))
                yield pa.RecordBatch.from_arrays([rows, _lists(ids, counts, pa.int32()), _lists(places, counts, pa.int64())], names=["row", "tokens", "offsets"])

    return run


def _decode(content):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content)
        for b in batches:
            lists = b["tokens"].fill_null([]) if b["tokens"].null_count else b["tokens"]
            edges = lists.offsets.to_numpy().astype(np.int64)
            at = 0
            while at < b.num_rows:
                end = max(int(np.searchsorted(edges, edges[at] + IDS, "right")) - 1, at + 1)
                ids = lists.values[edges[at]:edges[end]].to_numpy(zero_copy_only=False).astype(np.int64)
                out, sizes = vocabulary.decode(ids, np.diff(edges[at:end + 1]))
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - at, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(out))])
                yield pa.RecordBatch.from_arrays([b["row"].slice(at, end - at), blobs.cast(pa.binary())], names=["row", "decoded"])
                at = end

    return run


def _ranks(df: DataFrame, path: str):
    """The rank file (a fixed vocabulary, under a few megabytes) for all tasks."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, drop_text: bool = False) -> DataFrame:
    """``docs`` with ``tokens array<int>`` and ``offsets array<long>``, the byte
    at which each id starts in the text (input columns of these names are
    replaced).  ``path``: a rank file; ``drop_text`` leaves the text out."""
    prepare(docs.sparkSession)
    content = _ranks(docs, path)
    names = [c for c in docs.columns if c not in ("tokens", "offsets") and not (drop_text and c == "text")]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *names).alias("row"), F.col("text").cast("string").alias("text"))
    row = packed.schema["row"].dataType.simpleString()
    out = packed.mapInArrow(lean(_encode(content)), f"row {row}, tokens array<int>, offsets array<bigint>")
    return out.select(*[F.col("row")[c].alias(c) for c in names], "tokens", "offsets")


def decode(df: DataFrame, path: str) -> DataFrame:
    """``df`` with ``decoded binary`` from ``tokens`` (null tokens: empty)."""
    prepare(df.sparkSession)
    content = _ranks(df, path)
    names = [c for c in df.columns if c != "decoded"]
    packed = df.select(F.struct(F.lit(0).alias("_"), *names).alias("row"), "tokens")
    row = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(lean(_decode(content)), f"row {row}, decoded binary").select(*[F.col("row")[c].alias(c) for c in names], "decoded")
