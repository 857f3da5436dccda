"""Cross-tokenizer alignment: which ids of tokenizer A stand for which of B.

Both tokenizers encode a text's bytes; where a token of each ends at the same
byte, a group of tokens ends.  Two ids are linked when they share a group, and
a pair's count is the number of documents that hold it linked.

Most groups are one A token and one B token of the same bytes.  For them an
array is made once that gives each A id the B id of the same bytes: these
identity pairs are counted in one vector of vocabulary length a task, and only
the pairs of irregular groups go through a shuffle, summed up by slice before.
The vectors (a number for each A id) are broadcast; the pair table is, too, if
it has ``pair_limit`` rows at most, else each slice gets the list of its own
pairs back through a join.

Cases: a text that is null, empty, or that a tokenizer does not give back byte
by byte (after normalisation, say) has no tokens and all zeros.  Texts are
encoded whole; special tokens' strings in a text are plain text.  Repeated
rows count each time.  An empty table gives no rows.  The input's columns but
``text`` are kept; columns called like a result are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .cached_words import LEADING, Cached
from .io import lean, prepare, table

#: Bytes of a slice (a longer text is a slice of its own), of the texts that
#: the tokenizers get at a time, and linked pairs that are expanded at a time.
SLICE_BYTES, ENCODE_BYTES, EXPAND = 1 << 19, 1 << 18, 1 << 21
SALTS = 16
#: Pairs that are broadcast at most (16 bytes each).
PAIR_LIMIT = 1 << 22
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for:
    printable bytes for themselves, the others from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Side:
    """A tokenizer: the bytes of each id, and ``encode``, which takes texts
    and their bytes with a space in front (nothing for an empty text) and
    gives all ids and the number of each text's."""

    def __init__(self, entries: list[bytes]) -> None:
        self.lengths = np.array([len(t) for t in entries], np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.entries = entries

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        total = np.cumsum(lengths)
        return self.flat[np.repeat(self.begin[ids] - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)]


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


#: Fixed value: how a byte-level file without a pattern of its own cuts texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks_of(content: dict, entries: list[bytes]) -> dict[bytes, int] | None:
    """The file as ranks of byte strings, if it says no more than those: plain
    byte-level pieces, and every merge makes the next higher id."""
    model, cut = content["model"], content.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or content.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex"):
        return None
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    if any(b <= a for a, b in zip(made, made[1:])) or len(made) + 256 != len(model["vocab"]):
        return None
    ranks = {entries[i]: i for i in model["vocab"].values()}
    single = [ranks.get(bytes([b])) for b in range(256)]
    return ranks if None not in single and max(single) < min(made, default=256) else None


class ByteLevel(Side):
    """Byte-level BPE from a ``tokenizers`` file; encodes a space and the text.
    A file that is a list of ranks runs as one, which gives the same ids."""

    def __init__(self, content: bytes) -> None:
        parsed = json.loads(content)
        vocabulary, letters = {t["content"]: t["id"] for t in parsed.get("added_tokens", [])} | parsed["model"]["vocab"], byte_letters()
        entries = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            entries[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        super().__init__(entries)
        ranks = ranks_of(parsed, entries)
        self.ranked = self.cached = None
        if ranks:
            import tiktoken

            self.ranked = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_buffer(content)
            tokenizer.encode_special_tokens = True
            self.cached = Cached(tokenizer, LEADING)

    def encode(self, texts: list[str], raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.cached:
            return self.cached.encode(raw, offsets)
        return _joined([self.ranked.encode_ordinary(" " + t) if t else [] for t in texts])


class Pieces(Side):
    """A SentencePiece model, which adds the space itself."""

    def __init__(self, content: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=content)
        entries = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            entries.append(bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        super().__init__(entries)

    def encode(self, texts: list[str], raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _joined(self.model.encode(texts, num_threads=1))


class Both:
    """The two tokenizers and the array of ids with the same bytes."""

    def __init__(self, a: bytes, b: bytes) -> None:
        self.a, self.b = ByteLevel(a), Pieces(b)

    @cached_property
    def same(self) -> np.ndarray:
        """B's id with the bytes of each A id (the last one if there are
        several: single-byte entries come first), -1 if there is none."""
        ids = {token: i for i, token in enumerate(self.b.entries)}
        return np.array([ids.get(token, -1) if token else -1 for token in self.a.entries], np.int64)


_LOADED: dict[int, Both] = {}


def _both(contents: Broadcast) -> Both:
    key = hash(contents.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Both(*contents.value)
    return _LOADED[key]


def _given_back(side: Side, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which texts (``sizes`` bytes each of ``raw``) the ids spell out."""
    ends = np.concatenate(([0], np.cumsum(side.lengths[ids])))[np.concatenate(([0], np.cumsum(counts)))]
    good = np.diff(ends) == sizes
    spelt = side.bytes_of(ids[np.repeat(good, counts)])
    wrong = spelt != raw[np.repeat(good, sizes)]
    if wrong.any():
        doc = np.repeat(np.flatnonzero(good), sizes[good])
        good[doc[wrong]] = False
    return good


def _both_ids(both: Both, texts: list[str]) -> tuple[np.ndarray, ...]:
    """(A ids, their number in each text, B ids, their number)."""
    parts = [[], [], [], []]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < ENCODE_BYTES or end == at):
            size += len(texts[end])
            end += 1
        some = texts[at:end]
        raw = [b" " + t.encode() if t else b"" for t in some]
        sizes = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        edges = np.concatenate(([0], np.cumsum(sizes)))
        (a, n_a), (b, n_b) = (side.encode(some, flat, edges) for side in (both.a, both.b))
        good = _given_back(both.a, a, n_a, flat, sizes) & _given_back(both.b, b, n_b, flat, sizes)
        for part, got in zip(parts, (a[np.repeat(good, n_a)], n_a * good, b[np.repeat(good, n_b)], n_b * good)):
            part.append(got)
        at = end
    return tuple(np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts)


def _width(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def _encode(contents: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _both(contents)
        if not all(both.a.lengths) or not all(both.b.lengths):
            raise ValueError("a vocabulary has an empty entry")
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, _, offsets in K.chunks(batch["text"], SLICE_BYTES):
                n = len(offsets) - 1
                texts = [t or "" for t in batch["text"].slice(at, n).to_pylist()]
                a, n_a, b, n_b = _both_ids(both, texts)
                end_a, end_b = np.cumsum(both.a.lengths[a]), np.cumsum(both.b.lengths[b])
                closes = [np.packbits(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).tobytes() if len(y) else b"" for x, y in ((end_b, end_a), (end_a, end_b))]
                ids = [x.astype(_width(len(side.entries))).tobytes() for x, side in ((a, both.a), (b, both.b))]
                counts = [pa.array([c], pa.list_(pa.int32())) for c in (n_a, n_b)]
                rows = batch["row"].slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows), *counts, *[pa.array([x], pa.binary()) for x in (*ids, *closes)]],
                    names=["slice", "rows", "n_a", "n_b", "a", "b", "closes_a", "closes_b"])
                number += 1

    return run


class Slice:
    """Texts of a slice with their tokens in groups."""

    def __init__(self, both: Both, batch: pa.RecordBatch, at: int) -> None:
        self.both = both
        self.n_a, self.n_b = (batch[k][at].values.to_numpy().astype(np.int64) for k in ("n_a", "n_b"))
        self.a, self.b = (np.frombuffer(batch[k][at].as_buffer(), _width(len(side.entries))).astype(np.int64) for k, side in (("a", both.a), ("b", both.b)))
        self.close_a, self.close_b = (np.unpackbits(np.frombuffer(batch[k][at].as_buffer(), np.uint8))[:len(x)].astype(bool) for k, x in (("closes_a", self.a), ("closes_b", self.b)))
        #: tokens up to the end of each group, the text of each group
        self.upto_a, self.upto_b = np.flatnonzero(self.close_a) + 1, np.flatnonzero(self.close_b) + 1
        self.size_a, self.size_b = np.diff(self.upto_a, prepend=0), np.diff(self.upto_b, prepend=0)
        self.doc = np.searchsorted(np.cumsum(self.n_a), self.upto_a - 1, "right")

    def _expanded(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text and pair as one number, links) of the groups, a bounded
        number at a time."""
        wide = len(self.both.b.entries)
        code = self.doc * len(self.both.a.entries) * wide
        single = (self.size_a == 1) & (self.size_b == 1)
        yield code[single] + self.a[self.upto_a[single] - 1] * wide + self.b[self.upto_b[single] - 1], np.ones(int(single.sum()), np.int64)
        rest = np.flatnonzero(~single)
        links = np.cumsum(self.size_a[rest] * self.size_b[rest])
        at = 0
        while at < len(rest):
            end = max(int(np.searchsorted(links, (links[at - 1] if at else 0) + EXPAND, "right")), at + 1)
            some = rest[at:end]
            at = end
            na, nb = self.size_a[some], self.size_b[some]
            begin_a, begin_b = self.upto_a[some] - na, self.upto_b[some] - nb
            if len(some) == 1 and na[0] * nb[0] > EXPAND:  # distinct ids of the one group, a block at a time
                x, cx = np.unique(self.a[begin_a[0]:begin_a[0] + na[0]], return_counts=True)
                y, cy = np.unique(self.b[begin_b[0]:begin_b[0] + nb[0]], return_counts=True)
                step = max(1, EXPAND // len(y))
                for s in range(0, len(x), step):
                    yield (code[some[0]] + x[s:s + step, None] * wide + y).ravel(), (cx[s:s + step, None] * cy).ravel()
                continue
            each = na * nb
            group = np.repeat(np.arange(len(some)), each)
            inside = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            i, j = inside // nb[group], inside % nb[group]
            yield code[some][group] + self.a[begin_a[group] + i] * wide + self.b[begin_b[group] + j], np.ones(len(group), np.int64)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, A id, B id) in order, and how many links each is."""
        codes, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, n = np.concatenate(codes), np.concatenate(counts)
            order = np.argsort(code, kind="stable")
            code, n = code[order], n[order]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            return code[first], np.add.reduceat(n, first) if len(n) else n

        for code, n in self._expanded():
            codes.append(code), counts.append(n)
            held += len(code)
            if held > 4 * EXPAND:
                code, n = merged()
                codes, counts, held = [code], [n], 0
        code, n = merged()
        size_b = len(self.both.b.entries)
        pair = code % (len(self.both.a.entries) * size_b)
        return code // (len(self.both.a.entries) * size_b), pair // size_b, pair % size_b, n

    def irregular(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which linked pairs are no identity pairs; the distinct ones, and
        the number of each among them."""
        odd = self.both.same[a] != b
        pairs, local = np.unique(a[odd] * len(self.both.b.entries) + b[odd], return_inverse=True)
        return odd, pairs, local

    def rendered(self) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` for each text."""
        groups = len(self.upto_a)
        before_b, upto_a = self.upto_b - self.size_b, self.upto_a
        group_a, group_b = np.repeat(np.arange(groups), self.size_a), np.repeat(np.arange(groups), self.size_b)
        at_a, at_b = np.arange(len(self.a)) + before_b[group_a], np.arange(len(self.b)) + upto_a[group_b]
        value, mark = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.uint8)
        value[at_a], value[at_b] = self.a, self.b
        mark[at_a], mark[at_b] = np.where(self.close_a, ord("|"), ord(",")), np.where(self.close_b, ord(";"), ord(","))
        tokens = np.cumsum(self.n_a + self.n_b)
        marked = np.ones(len(value), bool)
        marked[tokens[self.n_a + self.n_b > 0] - 1] = False  # nothing after a text's last id
        value = value.astype(np.uint32)
        digits = np.ones(len(value), np.int64)
        for k in range(1, 10):
            if not len(value) or int(value.max()) < 10 ** k:
                break
            digits += value >= 10 ** k
        ends = np.cumsum(digits + marked)
        starts = ends - digits - marked
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        for k in range(int(digits.max()) if len(digits) else 0):
            rest = value // np.uint32(10)
            last, has = (value - rest * np.uint32(10)).astype(np.uint8), digits > k
            out[(starts + digits)[has] - 1 - k] = last[has] + 48
            value = rest
        out[ends[marked] - 1] = mark[marked]
        offsets = np.concatenate(([0], np.concatenate(([0], ends))[tokens])).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(tokens), pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def _count(contents: Broadcast):
    """Documents of the irregular pairs of each slice, and one vector of
    those of the identity pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _both(contents)
        vector = np.zeros(len(both.a.entries), np.int64)
        for batch in batches:
            for at in range(batch.num_rows):
                s = Slice(both, batch, at)
                _, a, b, _ = s.links()
                odd, pairs, local = s.irregular(a, b)
                vector += np.bincount(a[~odd], minlength=len(vector))
                n, size = len(pairs), len(both.b.entries)
                if n:
                    columns = (np.full(n, batch["slice"][at].as_py()), np.arange(n), pairs // size, pairs % size, np.bincount(local, minlength=n))
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.nulls(n, pa.binary())], names=["slice", "local", "a", "b", "n", "vector"])
        if vector.any():
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 5, pa.array([vector.tobytes()], pa.binary())], names=["slice", "local", "a", "b", "n", "vector"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for v in batch["vector"]:
            more = np.frombuffer(v.as_buffer(), np.int64)
            total = more if total is None else total + more
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["vector"])


def _score(contents: Broadcast, vectors: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _both(contents)
        identity, best, all_pairs, all_counts = vectors.value
        for batch in batches:
            for at in range(batch.num_rows):
                s = Slice(both, batch, at)
                doc, a, b, n = s.links()
                odd, pairs, local = s.irregular(a, b)
                if all_pairs is not None:
                    known = all_counts[np.searchsorted(all_pairs, pairs)]
                elif len(pairs):
                    known = np.zeros(len(pairs), np.int64)
                    back = batch["known"][at].values
                    known[back.field(0).to_numpy(zero_copy_only=False)] = back.field(1).to_numpy(zero_copy_only=False)
                count = identity[a]
                if len(pairs):
                    count[odd] = known[local]

                def by_doc(values: np.ndarray) -> np.ndarray:
                    edges = np.concatenate(([0], np.cumsum(values)))
                    return np.diff(edges[np.searchsorted(doc, np.arange(len(s.n_a) + 1))])

                groups = np.bincount(s.doc, minlength=len(s.n_a))
                numbers = (s.n_a, s.n_b, groups, by_doc(n), by_doc(n * (count == best[a])), by_doc(n * count))
                yield pa.RecordBatch.from_arrays([batch["rows"][at].values, *[pa.array(x, pa.int64()) for x in numbers], s.rendered()], names=["row", *RESULTS])

    return run


class Alignment(NamedTuple):
    #: the input without ``text``; ``n_a, n_b, n_groups, n_links, n_best, count_sum long``, ``groups string``
    documents: DataFrame
    #: ``a, b, n``: linked pairs and their documents
    pairs: DataFrame


def align(docs: DataFrame, a_path: str, b_path: str, pair_limit: int = PAIR_LIMIT) -> Alignment:
    """Align the tokens of ``text`` under a byte-level ``tokenizers`` file and
    a SentencePiece model.  ``groups`` lists a text's groups as
    ``a1,a2|b1;a3|b2,b3``; ``n_best`` is the number of links whose pair has
    the highest count of its A id, ``count_sum`` the sum over the links'
    counts."""
    spark = docs.sparkSession
    prepare(spark)
    contents = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            contents.append(f.read())
    sent = spark.sparkContext.broadcast(tuple(contents))  # two vocabulary files
    names = [c for c in docs.columns if c not in (*RESULTS, "text")]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *names).alias("row"), F.col("text").cast("string").alias("text"))
    row = packed.schema["row"].dataType.simpleString()
    schema = f"slice long, rows array<{row}>, n_a array<int>, n_b array<int>, a binary, b binary, closes_a binary, closes_b binary"
    slices = table(packed.mapInArrow(lean(_encode(sent)), schema), "aligned")

    tokens = slices.select("slice", "n_a", "n_b", "a", "b", "closes_a", "closes_b")
    counted = table(tokens.mapInArrow(lean(_count(sent)), "slice long, local long, a long, b long, n long, vector binary"), "counted")
    odd = counted.where("local IS NOT NULL")
    pairs = table(odd.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")

    both = Both(*contents)
    parts = counted.where("vector IS NOT NULL").select("vector", (F.spark_partition_id() % SALTS).alias("salt"))
    summed = parts.repartition(SALTS, "salt").select("vector").mapInArrow(lean(_add), "vector binary").coalesce(1).mapInArrow(lean(_add), "vector binary").first()
    identity = np.frombuffer(summed[0], np.int64) if summed else np.zeros(len(both.a.entries), np.int64)
    best = identity.copy()
    highest = pairs.groupBy("a").agg(F.max("n").alias("n")).toArrow()  # a row for an A id at most
    ids = highest["a"].to_numpy()
    best[ids] = np.maximum(best[ids], highest["n"].to_numpy())
    if pairs.count() <= pair_limit:
        held = pairs.select((F.col("a") * len(both.b.entries) + F.col("b")).alias("pair"), "n").toArrow().sort_by("pair")
        vectors = spark.sparkContext.broadcast((identity, best, held["pair"].to_numpy(), held["n"].to_numpy()))
        met = slices
    else:
        vectors = spark.sparkContext.broadcast((identity, best, None, None))
        known = odd.select("slice", "local", "a", "b").join(pairs, ["a", "b"]).groupBy("slice").agg(F.collect_list(F.struct("local", "n")).alias("known"))
        met = slices.join(known, "slice", "left")
    kinds = ", ".join(f"{c} {'string' if c == 'groups' else 'long'}" for c in RESULTS)
    scored = met.mapInArrow(lean(_score(sent, vectors)), f"row {row}, {kinds}")
    own = np.flatnonzero(identity)
    same = spark.createDataFrame(pa.table({"a": pa.array(own, pa.int64()), "b": pa.array(both.same[own], pa.int64()), "n": pa.array(identity[own], pa.int64())}))
    return Alignment(scored.select(*[F.col("row")[c].alias(c) for c in names], *RESULTS), pairs.unionByName(same))
