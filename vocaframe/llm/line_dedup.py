"""Line dedup by an exact set-similarity join.

Lines are the pieces of a text between line feeds.  A line's tokens are its
distinct five-word shingles (words: ASCII letters folded, split at ASCII white
space); the whole word sequence of a line of fewer words than ``k`` is its one
token, so that such a line only matches lines of the same words.  Lines without
words are always kept.
Lines are ordered by (doc_id, line number).  A line is removed when a line
earlier in that order has the same tokens or a Jaccard similarity of at least
``percent`` hundredths; both are judged on the input, not on what is left.

1. Equal token sets are one vertex, known by its earliest line.
2. Tokens are ordered by rarity (``rarity``); two similar sets share a token
   in their prefixes of ``n - ceil(threshold * n) + 1`` rarest tokens.
   Vertices that meet in a prefix token and have compatible lengths form a
   group.
3. In each group every line is checked against the group's earliest one, after
   the length filter and the positional filter ``1 + min(rest_a, rest_b) >=
   overlap needed``.  One earlier match settles a line, so that copies in a
   large group take one check each.
4. Only lines not settled are checked against the other earlier lines.

All checks are exact on the token sets of the two lines.

Cases: null text has no lines and stays null; rows without a doc_id are
returned as they are and match nothing; rows with one doc_id share positions
(a line is only removed for a strictly smaller position); an empty table gives
an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import rarity
from .io import BROADCAST_ROWS, batch, binary_parts, lean, prepare, table, whole
from .verify import matching_pairs

SALT_ROWS = 1 << 16


class Lines:
    """The lines of a slice of a batch that have words, as arrays: row, line
    number, size, set hash, and all tokens line by line, sorted."""

    def __init__(self, at: int, data: np.ndarray, offsets: np.ndarray, k: int) -> None:
        starts, ends, first = K.word_spans(data, offsets)
        feeds = np.flatnonzero(data == 10)
        before = np.searchsorted(feeds, starts)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        cut = np.ones(len(starts), bool)
        cut[1:] = (row[1:] != row[:-1]) | (before[1:] != before[:-1])
        line = np.cumsum(cut) - 1
        n_words = np.bincount(line) if len(line) else np.zeros(0, np.int64)
        lead = np.flatnonzero(cut)
        self.row = row[lead] + at
        self.line = before[lead] - np.searchsorted(feeds, offsets[row[lead]])
        # shingles of all windows that stay inside their line
        size = max(len(starts) - k + 1, 0)
        hashes = K.range_hash(data, starts, ends)
        total = np.zeros(size, np.uint64)
        for i in range(k):
            total += hashes[i:size + i] * K._STEP[i]
        inside = line[:size] == line[k - 1:k - 1 + size]
        token, own = K.mix(total + np.uint64(k))[inside], line[:size][inside]
        # shorter lines: one token of all words
        brief = np.flatnonzero(n_words < k)
        if len(brief):
            at_ = np.flatnonzero((n_words < k)[line])
            parts = hashes[at_] * K._STEP[at_ - lead[line[at_]]]
            sums = np.add.reduceat(parts, np.cumsum(n_words[brief]) - n_words[brief])
            token = np.concatenate((token, K.mix(sums + n_words[brief].astype(np.uint64))))
            own = np.concatenate((own, brief))
        order = np.argsort((own.astype(np.uint64) << np.uint64(40)) | (token >> np.uint64(24)), kind="stable")
        token, own = token[order], own[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
        token, own = token[new], own[new]
        self.n = np.bincount(own, minlength=len(n_words)) if len(n_words) else np.zeros(0, np.int64)
        self.token = token
        self.start = np.concatenate(([0], np.cumsum(self.n))).astype(np.int64)
        at_ = self.start[:-1]
        if len(at_):
            self.vid = K.mix(np.add.reduceat(token, at_) * K._STEP[1] + self.n.astype(np.uint64) ^ np.bitwise_xor.reduceat(K.mix(token), at_))
        else:
            self.vid = np.zeros(0, np.uint64)


_SEEN = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("vid", pa.int64()), ("n", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = rarity.Counter()
        for b in batches:
            ids = b["doc_id"].to_numpy()
            for at, data, offsets in K.chunks(b["text"]):
                x = Lines(at, data, offsets, k)
                if len(x.n):
                    counter.add(x.token)
                    none = pa.nulls(len(x.n))
                    yield batch(_SEEN, ids[x.row], x.line.astype(np.int32), K.signed(x.vid), x.n.astype(np.int32), none.cast(pa.int32()), none.cast(pa.binary()))
        parts = counter.parts()
        none = pa.nulls(len(parts))
        yield batch(_SEEN, none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int32()), list(range(len(parts))), parts)

    return run


SEEN_SLOTS = 1 << 18  # lines that a task remembers to have routed, 2 MB

#: A prefix token of a line on its way to the other lines that have it; a part
#: of the tokens travels as one binary value a slice.
_ROUTE = np.dtype([("key", np.int64), ("vid", np.int64), ("n", np.int32), ("pos", np.int32), ("salt", np.int32)])
_SENT = pa.schema([("part", pa.int32()), ("rows", pa.binary())])


def _prefixes(k: int, percent: int, counts, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = counts.value
        seen = np.zeros(SEEN_SLOTS, np.uint64)
        for b in batches:
            for at, data, offsets in K.chunks(b["text"]):
                x = Lines(at, data, offsets, k)
                if not len(x.n):
                    continue
                # equal lines of a task are routed once, unless their place
                # in the table of the task was taken since; doubles are dropped
                # where they meet
                vids, lead = np.unique(x.vid, return_index=True)
                place = (vids >> np.uint64(20)).astype(np.int64) & (SEEN_SLOTS - 1)
                fresh = seen[place] != vids
                seen[place] = vids
                pick = np.zeros(len(x.n), bool)
                pick[lead[fresh]] = True
                own = np.repeat(np.arange(len(x.n)), x.n)
                mine = pick[own]
                own, token = own[mine], x.token[mine]
                often = common[rarity.slot(token)]
                order = np.argsort((own.astype(np.uint64) << np.uint64(32)) | often, kind="stable")
                own, token, often = own[order], token[order], often[order]
                n = np.where(pick, x.n, 0)
                rank = np.arange(len(own)) - (np.cumsum(n) - n)[own]
                take = rank < x.n[own] - (percent * x.n[own] + 99) // 100 + 1
                own, token, often, rank = own[take], token[take], often[take], rank[take]
                salts = (often // SALT_ROWS + 1).astype(np.uint64)
                salt = np.where(salts > 1, ((x.vid[own] >> np.uint64(7)) % salts).astype(np.int64), -1).astype(np.int32)
                part = (K.mix(token + salt.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
                at_ = np.argsort(part, kind="stable")
                rows = np.empty(len(part), _ROUTE)
                for name, values in (("key", K.signed(token)), ("vid", K.signed(x.vid[own])), ("n", x.n[own]), ("pos", rank), ("salt", salt)):
                    rows[name] = values[at_]
                used, begin = np.unique(part[at_], return_index=True)
                ends = np.append(begin, len(rows)).astype(np.int64) * _ROUTE.itemsize
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(used), [None, pa.py_buffer(ends), pa.py_buffer(rows)])
                yield batch(_SENT, used, blobs.cast(pa.binary()))

    return run


_GROUPS = pa.schema([("gid", pa.int64()), ("vid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def _groups(percent: int):
    """Rows of a partition that meet another vertex of compatible length in
    their key; a key is cut where lengths are too far apart.  The rows of a
    salted key are all kept: they meet rows of other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = whole(batches)
        if t is None:
            return
        data, offsets = binary_parts(t["rows"])
        sent = np.frombuffer(data[offsets[0]:offsets[-1]], _ROUTE)
        # most tokens came once
        at = np.argsort(sent["key"])
        key = sent["key"][at]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        sent = sent[at[same[1:] | same[:-1] | (sent["salt"][at] >= 0)]]
        key, salt, vid, n, pos = (sent[c] for c in ("key", "salt", "vid", "n", "pos"))
        at = np.lexsort((vid, n, key))
        key, salt, vid, n, pos = key[at], salt[at], vid[at], n[at].astype(np.int64), pos[at]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (vid[1:] != vid[:-1])
        key, salt, vid, n, pos = key[new], salt[new], vid[new], n[new], pos[new]
        cut = np.ones(len(key), bool)
        cut[1:] = (key[1:] != key[:-1]) | ((100 * n[:-1] < percent * n[1:]) & (salt[1:] < 0))
        group = np.cumsum(cut) - 1
        keep = (np.bincount(group)[group] > 1) | (salt >= 0)
        gid = np.where(salt < 0, key ^ n[cut][group], key)
        yield batch(_GROUPS, gid[keep], vid[keep], n[keep].astype(np.int32), pos[keep].astype(np.int32))

    return run


_SETS = pa.schema([("doc_id", pa.int64()), ("vid", pa.int64()), ("tokens", pa.binary())])


def _tokens(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["doc_id"].to_numpy()
            for at, data, offsets in K.chunks(b["text"]):
                x = Lines(at, data, offsets, k)
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x.n), [None, pa.py_buffer(x.start * 8), pa.py_buffer(x.token)])
                yield batch(_SETS, ids[x.row], K.signed(x.vid), blobs.cast(pa.binary()))

    return run


def _may_match(a: str, b: str, percent: int) -> Column:
    """Length and positional filter of two group rows."""
    n = lambda x: F.col(f"{x}.n")
    rest = lambda x: n(x) - F.col(f"{x}.pos")
    needed = F.ceil(percent * (n(a) + n(b)) / (100 + percent))
    return (100 * n(a) >= percent * n(b)) & (100 * n(b) >= percent * n(a)) & (F.least(rest(a), rest(b)) >= needed)


def removed_lines(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, line`` of every line that an earlier one matches."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    described = table(docs.mapInArrow(lean(_describe(k)), "doc_id long, line int, vid long, n int, part int, counts binary"), "lines")
    counts = rarity.counters(described.where("part is not null"))
    seen = described.where("part is null").select("doc_id", "line", "vid")
    first = table(seen.groupBy("vid").agg(F.min(F.struct("doc_id", "line")).alias("at"), F.count("*").alias("times")), "line_first")

    places = first.select("vid", F.col("at.doc_id").alias("doc_id"))

    def late(pairs: DataFrame, name: str) -> DataFrame:
        """Vertices with a match among the earlier ones they are paired with."""
        return matching_pairs(pairs, docs, places, _tokens(k), percent, name).select(F.col("b").alias("vid")).distinct()

    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = docs.select("text").mapInArrow(lean(_prefixes(k, percent, counts, parts)), "part int, rows binary")
    groups = table(routed.repartition("part").mapInArrow(lean(_groups(percent)), "gid long, vid long, n int, pos int"), "line_groups")
    groups = table(groups.join(first.select("vid", "at"), "vid"), "line_groups_at")

    lead = groups.groupBy("gid").agg(F.min(F.struct("at", "vid", "n", "pos")).alias("lead")).select("gid", "lead.*")
    a, b = lead.alias("a"), groups.alias("b")
    pairs = b.join(a, (F.col("a.gid") == F.col("b.gid")) & (F.col("a.at") < F.col("b.at")) & _may_match("a", "b", percent)).select(F.col("a.vid").alias("a"), F.col("b.vid").alias("b"))
    settled = table(late(pairs, "first_lines"), "settled")

    open_ = groups.join(settled, "vid", "left_anti")
    a, b = groups.alias("a"), open_.alias("b")
    pairs = b.join(a, (F.col("a.gid") == F.col("b.gid")) & (F.col("a.at") < F.col("b.at")) & _may_match("a", "b", percent)).select(F.col("a.vid").alias("a"), F.col("b.vid").alias("b"))
    settled = settled.union(late(pairs, "open_lines"))

    gone = first.join(settled.withColumn("near", F.lit(True)), "vid", "left").where("near or times > 1")
    return seen.join(gone, "vid").where(F.col("near") | (F.struct("doc_id", "line") > F.col("at"))).select("doc_id", "line").distinct()


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        gone = b["gone"]
        lines = pc.fill_null(pc.add(pc.cast(pc.count_substring(b["text"], "\n"), pa.int64()), 1), 0)
        removed = pc.cast(pc.fill_null(pc.list_value_length(gone), 0), pa.int64())
        # only texts that lose lines are taken apart
        left = []
        for text, numbers in zip(b["text"].filter(gone.is_valid()), gone.filter(gone.is_valid())):
            parts = text.as_py().split("\n")
            keep = np.ones(len(parts), bool)
            keep[numbers.values.to_numpy()] = False
            left.append("\n".join(p for p, k in zip(parts, keep) if k))
        texts = pc.replace_with_mask(b["text"], gone.is_valid(), pa.array(left, pa.string()))
        yield pa.RecordBatch.from_arrays([b[b.schema.names[0]], texts, lines, removed], names=["row", "text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """All columns of ``docs`` with the text left, and ``n_lines`` and
    ``n_removed`` (input columns of these names are replaced)."""
    lines = table(removed_lines(docs, k, percent), "removed_lines")
    gone = lines.groupBy("doc_id").agg(F.collect_list("line").alias("gone"))
    gone = F.broadcast(gone) if lines.count() <= BROADCAST_ROWS else gone
    keep = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))
    joined = packed.join(gone, "doc_id", "left").select("row", "text", "gone")
    schema = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(lean(_apply), f"row {schema}, text string, n_lines long, n_removed long")
    return out.select(*[F.col("row")[c].alias(c) if c != "text" else F.col("text") for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
