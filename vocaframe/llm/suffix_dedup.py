"""Removal of repeated byte strings by blockwise suffix sorting.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts in a
document with a smaller doc_id.  Matches never cross documents and are judged
on the input.

Suffixes are compared to ``LENGTH`` bytes only.  All of them together are far
more than the text, so that only the suffixes of a *cover sample* are sorted,
bucket by bucket: as with a difference cover, any two equal strings of
``LENGTH`` bytes have a sample position at the same offset.  The sample is
chosen by content (the position whose ``GRAM`` bytes hash lowest among the
string's), because a fixed difference cover of that period needs three times
as many positions.  The windows that share a sample position are its *zone*.

1. Every (sample, zone) goes to the bucket of its sample, as 16 packed bytes
   that name the smallest document of ``SEND_BYTES`` of text that has it.  The
   zone goes whole from the larger documents of that text, which is settled
   there and not sent to the bucket, so that a passage of very many documents
   is a few entries of its bucket.  A bucket is sorted at a time; equal samples
   are neighbours, and the rank of the zone (a hash of its bytes) settles long
   ties at once: a zone that also is in a smaller document goes whole.
2. Samples with several different zones are the ends of matches.  A window
   that reaches ``SIDE`` bytes or more beyond the sample to one side can only
   match a zone that has the same ``SIDE`` bytes there; a zone that shares
   neither side is done.  The bytes of the other zones, taken from the zone's
   smallest document, meet in the bucket of the sample, where all their
   windows are sorted; those that a smaller document has go one by one.  The
   windows of a sample with more than ``MOST_ZONES`` zones are compared one
   window a row instead, by partial aggregation, so that no bucket grows
   without bound.
3. Each document's zones and windows that go are brought to it, and its text
   is cut.  Texts that lose nothing are not shuffled.

Exact copies are known by a hash of the text and cut whole; a task sends their
zones only for the copy with the smallest doc_id so far.

Zones are compared by hashes of 40 bits within one sample (a hash of 40 bits
and more), windows and a document's own zones by 64 bits.  Cases: null counts as the empty text; texts under ``LENGTH`` bytes
lose nothing; rows with one doc_id are one document to the others and not
compared with each other; rows without a doc_id lose nothing and are not
compared; very long texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .io import BROADCAST_ROWS, batch, lean, prepare, small, table, whole

LENGTH = 50
GRAM = 20
_SPAN = LENGTH - GRAM + 1
_PLAIN = np.arange(256)
#: Text whose samples a task sorts into buckets at a time.
SEND_BYTES = 16 << 20
#: Text that zones are found in at a time (a longer text is taken whole): the
#: arrays, eight bytes for each of text, stay in the processor's cache.
TEXT_BYTES = 1 << 18
#: Zones of one sample that are compared in one task.
MOST_ZONES = 2048
SIDE = 4
#: Rows that a task sorts at a time.
RANGE_ROWS = 1 << 16
_LOW40, _LOW24, _LOW16 = (np.uint64((1 << n) - 1) for n in (40, 24, 16))
#: Packed columns of a zone: sample, rank, place of the document, both sides.
_WIDTHS = (5, 5, 2, 2, 2)


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` consecutive values."""
    width = 1
    while width * 2 <= span:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[:len(values) - (span - width)], values[span - width:]) if span > width else values


class Zones:
    """Zones of all texts of a slice: row, start, number of windows, ``part``
    and ``key`` (bucket and hash of the sample), ``rank`` (hash of the zone's
    bytes) and ``id`` (64 bits of both)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, parts: int) -> None:
        n = len(data)
        if n < LENGTH:
            self.row = self.start = self.count = self.at = self.part = np.zeros(0, np.int64)
            self.key = self.rank = self.id = np.zeros(0, np.uint64)
            return
        begin = np.arange(n - GRAM + 1)
        self.sums = K.prefix_sums(data, _PLAIN)
        grams = K.ranges_hash(self.sums, begin, begin + GRAM)
        least = _least(grams, _SPAN)
        # windows inside one text
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n - LENGTH + 1]
        starts = np.flatnonzero(np.arange(LENGTH, n + 1) <= offsets[row + 1])
        row = row[starts]
        # the first position of a window whose hash is the window's least:
        # next occurrence of that value, found from the right, block by block
        anchor = self._anchors(grams, least, starts)
        cut = np.ones(len(starts), bool)
        cut[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (starts[1:] != starts[:-1] + 1)
        lead = np.flatnonzero(cut)
        self.row, self.start, self.at = row[lead], starts[lead], anchor[lead]
        self.count = np.diff(np.append(lead, len(starts)))
        sample = grams[self.at]
        self.part = (sample % np.uint64(parts)).astype(np.int64)
        self.key = sample // np.uint64(parts) & _LOW40
        rank = K.ranges_hash(self.sums, self.start, self.start + self.count + LENGTH - 1)
        self.rank = K.mix(rank + (self.at - self.start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & _LOW40
        self.id = self.rank << np.uint64(24) | self.key & _LOW24
        self.offsets = offsets

    def sides(self, pick: np.ndarray) -> list[np.ndarray]:
        """16-bit hashes of the bytes left and right of the samples."""
        at, row = self.at[pick], self.row[pick]
        left = K.ranges_hash(self.sums, np.maximum(at - SIDE, self.offsets[row]), at)
        right = K.ranges_hash(self.sums, at + GRAM, np.minimum(at + GRAM + SIDE, self.offsets[row + 1]))
        return [left & _LOW16, right & _LOW16]

    @staticmethod
    def _anchors(grams: np.ndarray, least: np.ndarray, starts: np.ndarray) -> np.ndarray:
        wanted = least[starts]
        anchor = np.full(len(starts), -1, np.int64)
        left = np.arange(len(starts))
        # a window's sample is mostly that of the window before it
        if len(starts):
            new = np.ones(len(starts), bool)
            new[1:] = (wanted[1:] != wanted[:-1]) | (starts[1:] != starts[:-1] + 1)
            heads = np.flatnonzero(new)
            # a value below the least of the window before it has just come in
            found = starts[heads] + _SPAN - 1
            fell = np.zeros(len(heads), bool)
            fell[1:] = (starts[heads[1:]] == starts[heads[1:] - 1] + 1) & (wanted[heads[1:]] < wanted[heads[1:] - 1])
            todo = np.flatnonzero(~fell)
            for d in range(_SPAN):
                if not len(todo):
                    break
                hit = grams[starts[heads[todo]] + d] == wanted[heads[todo]]
                found[todo[hit]] = starts[heads[todo[hit]]] + d
                todo = todo[~hit]
            anchor = found[np.cumsum(new) - 1]
            # windows that have moved past it hold the same value once more
            left = np.flatnonzero(anchor < starts)
            while len(left):
                for d in range(_SPAN):
                    if not len(left):
                        break
                    hit = grams[starts[left] + d] == wanted[left]
                    anchor[left[hit]] = starts[left[hit]] + d
                    left = left[~hit]
        return anchor


class _Pieces:
    """Columns that come in pieces and are given back a range of the first
    column (unsigned, below ``top``) at a time, so that a task copies and sorts
    some ``RANGE_ROWS`` rows at once, whatever it holds.  Rows with one value
    of the first column, or of its multiples of ``unit``, stay together and in
    the order they came."""

    def __init__(self, top: int, unit: int = 1) -> None:
        self.top, self.unit, self.rows = top, unit, 0
        self.pieces: list[list[np.ndarray]] = []

    def add(self, *columns: np.ndarray) -> None:
        order = np.argsort(columns[0], kind="stable")
        self.pieces.append([c[order] for c in columns])
        self.rows += len(order)

    def ranges(self) -> Iterator[list[np.ndarray]]:
        n = -(-self.rows // RANGE_ROWS)
        edges = np.array([self.top * k // n // self.unit * self.unit for k in range(1, n)], np.uint64)
        cuts = [[0, *np.searchsorted(p[0], edges).tolist(), len(p[0])] for p in self.pieces]
        for k in range(n):
            held = [[c[cut[k]:cut[k + 1]] for c in p] for p, cut in zip(self.pieces, cuts) if cut[k] < cut[k + 1]]
            if held:
                yield [np.concatenate(x) for x in zip(*held)]


def _pack(columns: list[np.ndarray]) -> bytes:
    return np.hstack([c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w] for c, w in zip(columns, _WIDTHS)]).tobytes()


def _unpack(raw: np.ndarray) -> list[np.ndarray]:
    rows, out, at = raw.reshape(-1, sum(_WIDTHS)), [], 0
    for w in _WIDTHS:
        wide = np.zeros((len(rows), 8), np.uint8)
        wide[:, :w] = rows[:, at:at + w]
        out.append(wide.view("<u8").ravel())
        at += w
    return out


#: ``zones`` are packed; a row without has in ``ids`` documents and, after
#: them, as many ids of zones that go whole from them.
_SENT = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("zones", pa.binary())])
#: Settled zones of a row.
SETTLED = 1 << 14


def _send(parts: int):
    """Samples of a task, one row for each bucket and ``SEND_BYTES`` of text:
    the documents, and the packed zones that name them by their place.  Zones
    settled within that text follow, dealt over all buckets."""

    def pack(ids: list[int], held: _Pieces) -> Iterator[pa.RecordBatch]:
        all_ids = np.array(ids, np.int64)
        for sample, rank, own, left, right in held.ranges():
            doc = all_ids[own]
            order = np.lexsort((doc, rank, sample))
            sample, rank, own, left, right, doc = (x[order] for x in (sample, rank, own, left, right, doc))
            new = np.ones(len(sample), bool)
            new[1:] = (sample[1:] != sample[:-1]) | (rank[1:] != rank[:-1])
            goes = np.flatnonzero(doc > doc[new][np.cumsum(new) - 1])
            settled = doc[goes], K.signed(rank[goes] << np.uint64(24) | sample[goes] & _LOW24)
            sample, rank, own, left, right = (x[new] for x in (sample, rank, own, left, right))
            part, key = (sample >> np.uint64(40)).astype(np.int64), sample & _LOW40
            rows, docs, zones = [], [], []
            edges = np.flatnonzero(np.diff(part, prepend=-1))
            for s, e in zip(edges, np.append(edges[1:], len(part))):
                here, place = np.unique(own[s:e], return_inverse=True)
                rows.append(int(part[s]))
                docs.append(all_ids[here].tobytes())
                zones.append(_pack([key[s:e], rank[s:e], place, left[s:e], right[s:e]]))
            for s in range(0, len(goes), SETTLED):
                own_docs, own_zones = (x[s:s + SETTLED] for x in settled)
                rows.append(int(own_zones[0] % parts))
                docs.append(own_docs.tobytes() + own_zones.tobytes())
                zones.append(b"")
            yield batch(_SENT, rows, docs, zones)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        # the first column is the bucket, then 40 bits of the sample
        held = _Pieces(parts << 40, 1 << 40)
        size, known = 0, {}
        for b in batches:
            own_ids = b["doc_id"].to_numpy()
            for at, data, offsets in K.chunks(b["text"], TEXT_BYTES):
                n = len(offsets) - 1
                if held.rows and (size >= SEND_BYTES or len(ids) + n > 1 << 16):
                    yield from pack(ids, held)
                    ids, held, size = [], _Pieces(parts << 40, 1 << 40), 0
                zones = Zones(data, offsets, parts)
                keep = np.ones(n, bool)
                hashes = K.range_hash(data, offsets[:-1], offsets[1:], _PLAIN) if len(data) else np.zeros(0, np.uint64)
                for r, h in enumerate(hashes.tolist()):  # copies of a smaller document of the task
                    doc = int(own_ids[at + r])
                    if known.get(h, doc + 1) <= doc:
                        keep[r] = False
                    else:
                        known[h] = doc
                pick = np.flatnonzero(keep[zones.row])
                if len(pick):
                    sample = zones.part[pick].astype(np.uint64) << np.uint64(40) | zones.key[pick]
                    held.add(sample, zones.rank[pick], *(x.astype(np.uint16) for x in (zones.row[pick] + len(ids), *zones.sides(pick))))
                ids += own_ids[at:at + n].tolist()
                size += len(data)
        yield from pack(ids, held)

    return run


WHOLE, ENDS, MANY = range(3)
#: doc_id, zone id, what it is (a zone that goes whole, or one of several zones
#: of a sample whose windows have to be compared, or one of very many), and the
#: sides that it shares with another zone (1 left, 2 right, 3 both).
_FOUND = pa.schema([("doc_id", pa.int64()), ("zone", pa.int64()), ("kind", pa.int32()), ("sides", pa.int32())])


def _sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buckets: dict[int, _Pieces] = {}
    for b in batches:
        for part, ids, zones in zip(b["part"].to_pylist(), b["ids"], b["zones"]):
            held = np.frombuffer(ids.as_buffer(), np.int64)
            packed = np.frombuffer(zones.as_buffer(), np.uint8)
            if not len(packed):
                n = len(held) // 2
                yield batch(_FOUND, held[:n], held[n:], np.full(n, WHOLE, np.int32), np.zeros(n, np.int32))
                continue
            key, rank, place, left, right = _unpack(packed)
            pieces = buckets.setdefault(part, _Pieces(1 << 40))
            pieces.add(key, rank, held[place.astype(np.int64)], left.astype(np.uint16), right.astype(np.uint16))
    for pieces in buckets.values():
        for columns in pieces.ranges():
            yield from _sort_samples(*columns)


def _sort_samples(key: np.ndarray, rank: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What becomes of the zones of some samples of a bucket."""
    # most samples are in one document only
    order = np.argsort(key, kind="stable")
    twin = np.zeros(len(order), bool)
    same = key[order][1:] == key[order][:-1]
    twin[1:] |= same
    twin[:-1] |= same
    order = order[twin]
    order = order[np.lexsort((doc[order], rank[order], key[order]))]
    key, rank, doc, left, right = (x[order] for x in (key, rank, doc, left, right))
    if not len(key):
        return
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    new_zone = new_key.copy()
    new_zone[1:] |= rank[1:] != rank[:-1]
    zone = np.cumsum(new_zone) - 1
    goes = doc > doc[new_zone][zone]
    first = np.flatnonzero(new_zone)
    sample = (np.cumsum(new_key) - 1)[first]
    sides = np.zeros(len(first), np.int32)
    for bit, side in ((1, left[first]), (2, right[first])):
        by = np.lexsort((side, sample))
        same = (sample[by][1:] == sample[by][:-1]) & (side[by][1:] == side[by][:-1])
        shared = np.zeros(len(first), bool)
        shared[by[1:]] |= same
        shared[by[:-1]] |= same
        sides[shared] |= bit
    # those that share no side are compared with nothing
    zones = np.bincount(sample, sides > 0)[sample]
    ids = K.signed(rank << np.uint64(24) | key & _LOW24)
    groups = [np.flatnonzero(goes), *(first[(sides > 0) & many] for many in (zones <= MOST_ZONES, zones > MOST_ZONES))]
    rows = np.concatenate(groups)
    kind = np.repeat(np.arange(3, dtype=np.int32), [len(g) for g in groups])
    every = np.zeros(len(key), np.int32)
    every[first] = sides
    for s in range(0, len(rows), 1 << 18):
        r = rows[s:s + (1 << 18)]
        yield batch(_FOUND, doc[r], ids[r], kind[s:s + (1 << 18)], every[r])


_WINDOWS = pa.schema([("doc_id", pa.int64()), ("zone", pa.int64()), ("j", pa.int32()), ("window", pa.int64())])


def _wanted(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, Zones, np.ndarray, np.ndarray]]:
    """(doc_id of each zone, bytes, all zones, rows of the zones that the
    column ``zones`` asks for, each once, and their sides)."""
    for b in batches:
        ids = b["doc_id"].to_numpy()
        for at, data, offsets in K.chunks(b["text"], TEXT_BYTES):
            z = Zones(data, offsets, parts)
            sides = np.zeros(len(z.row), np.int32)
            edges = np.searchsorted(z.row, np.arange(len(offsets)))
            for r in range(len(offsets) - 1):
                s, e = edges[r], edges[r + 1]
                if s < e:
                    want, side = (b["zones"][at + r].values.field(k).to_numpy() for k in ("zone", "sides"))
                    order = np.argsort(want, kind="stable")
                    mine = K.signed(z.id[s:e])
                    place = order[np.minimum(np.searchsorted(want[order], mine), len(want) - 1)]
                    sides[s:e] = np.where(want[place] == mine, side[place], 0)
            i = np.flatnonzero(sides)
            if len(i):
                _, once = np.unique(np.stack([z.row[i], K.signed(z.id[i])]), axis=1, return_index=True)
                yield ids[at + z.row], data, z, i[once], sides[i[once]]


def _each(count: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _windows(parts: int):
    """Hashes of the windows of the wanted zones, one a row, but for those that
    reach ``SIDE`` bytes into a side that no other zone shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, _, z, i, sides in _wanted(batches, parts):
            zone, j, side = np.repeat(i, z.count[i]), _each(z.count[i]), np.repeat(sides, z.count[i])
            before = z.at[zone] - z.start[zone] - j
            may = ((side & 1 > 0) | (before < SIDE)) & ((side & 2 > 0) | (LENGTH - GRAM - before < SIDE))
            zone, j = zone[may], j[may]
            start = z.start[zone] + j
            hashes = K.mix(K.ranges_hash(z.sums, start, start + LENGTH) + (z.at[zone] - start).astype(np.uint64))
            yield batch(_WINDOWS, doc[zone], K.signed(z.id[zone]), j.astype(np.int32), K.signed(hashes))

    return run


_BYTES = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("zone", pa.int64()), ("before", pa.int32()), ("bytes", pa.binary())])


def _bytes_of_zones(parts: int):
    """The wanted zones: bucket of the sample, bytes, and how many of them
    stand before the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, data, z, i, _ in _wanted(batches, parts):
            raw = data.tobytes()
            ends = z.start[i] + z.count[i] + LENGTH - 1
            bucket = K.mix(z.key[i] * np.uint64(parts) + z.part[i].astype(np.uint64))
            yield batch(_BYTES, K.signed(bucket), doc[i], K.signed(z.id[i]), (z.at[i] - z.start[i]).astype(np.int32), [raw[s:e] for s, e in zip(z.start[i].tolist(), ends.tolist())])

    return run


_OWNERS = pa.schema([("doc_id", pa.int64()), ("zone", pa.int64())])
_MASKS = pa.schema([("doc_id", pa.int64()), ("zone", pa.int64()), ("mask", pa.int64())])


def _sort_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the zones of a partition's buckets that a smaller document
    has, as bits of each zone."""
    held, n = [], 0
    windows = _Pieces(1 << 64)
    for b in batches:
        bucket = K.unsigned(b["bucket"].to_numpy())
        before = b["before"].to_numpy()
        for at, data, offsets in K.chunks(b["bytes"], TEXT_BYTES):
            count = np.diff(offsets) - LENGTH + 1
            own, j = np.repeat(np.arange(len(count)), count), _each(count)
            start = offsets[own] + j
            own += at
            window = K.mix(K.range_hash(data, start, start + LENGTH, _PLAIN) + (before[own] - j).astype(np.uint64)) ^ bucket[own]
            windows.add(window, (own + n).astype(np.uint32), j.astype(np.uint8))
        # copies, so that the bytes of the batch go
        held.append(batch(_OWNERS, b["doc_id"].to_numpy().copy(), b["zone"].to_numpy().copy()))
        n += b.num_rows
    t = whole(iter(held))
    if t is None:
        return
    doc, zone = t["doc_id"].to_numpy(), t["zone"].to_numpy()
    mask = np.zeros(n, np.int64)
    for window, own, j in windows.ranges():
        order = np.argsort(window)
        window, own, j = window[order], own[order], j[order]
        first = np.ones(len(window), bool)
        first[1:] = window[1:] != window[:-1]
        least = np.minimum.reduceat(doc[own], np.flatnonzero(first))[np.cumsum(first) - 1]
        gone = np.flatnonzero(doc[own] > least)
        np.bitwise_or.at(mask, own[gone], np.int64(1) << j[gone].astype(np.int64))
    some = np.flatnonzero(mask)
    yield batch(_MASKS, doc[some], zone[some], mask[some])


def _cut(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            copies = b["copy"].to_numpy(zero_copy_only=False)
            for at, data, offsets in K.chunks(b["text"], TEXT_BYTES):
                z = Zones(data, offsets, parts)
                edges = np.searchsorted(z.row, np.arange(len(offsets)))
                spans, kept = [], []
                for r in range(len(offsets) - 1):
                    text = data[offsets[r]:offsets[r + 1]]
                    own, s, e = b["gone"][at + r], edges[r], edges[r + 1]
                    gone = np.zeros(0, np.int64)
                    if copies[at + r] and len(text) >= LENGTH:
                        gone = np.arange(len(text) - LENGTH + 1)
                    elif own.is_valid and s < e:
                        zones, masks = (own.values.field(k).to_numpy() for k in ("zone", "mask"))
                        order = np.argsort(zones, kind="stable")
                        zones, masks = zones[order], masks[order]
                        mine = K.signed(z.id[s:e])
                        place = np.minimum(np.searchsorted(zones, mine), len(zones) - 1)
                        mask = np.where(zones[place] == mine, masks[place], 0)
                        count = z.count[s:e]
                        j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                        gone = (np.repeat(z.start[s:e] - offsets[r], count) + j)[np.repeat(mask, count) >> j & 1 == 1]
                    step = np.zeros(len(text) + 1, np.int64)
                    np.add.at(step, gone, 1)
                    np.add.at(step, gone + LENGTH, -1)
                    covered = np.cumsum(step[:-1]) > 0
                    edge = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
                    spans.append([dict(start=int(x), end=int(y)) for x, y in zip(edge[::2], edge[1::2])])
                    kept.append(text[~covered].tobytes())
                rows = b["row"].slice(at, len(kept))
                yield pa.RecordBatch.from_arrays([rows, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), pa.array(np.diff(offsets), pa.int64())], names=["row", "spans", "kept", "n_bytes"])

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with ``spans`` (the byte runs removed), the
    bytes ``kept`` and ``n_bytes`` of the input (a cut may part a character;
    input columns of these names are replaced)."""
    spark = docs.sparkSession
    prepare(spark)
    names = [c for c in docs.columns if c not in ("text", "spans", "kept", "n_bytes")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    live = texts.where("doc_id is not null and octet_length(text) >= 50")

    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = live.mapInArrow(lean(_send(parts)), "part int, ids binary, zones binary").repartition(parts, "part")
    found = table(sent.mapInArrow(lean(_sort_bucket), "doc_id long, zone long, kind int, sides int"), "zones")

    def holding(kind: int) -> DataFrame:
        """Texts with the zones of a kind that are to be read from them."""
        zones = found.where(F.col("kind") == kind)
        lists = zones.groupBy("doc_id").agg(F.collect_list(F.struct("zone", "sides")).alias("zones"))
        return live.join(F.broadcast(lists) if zones.count() <= BROADCAST_ROWS else lists, "doc_id")

    ends = holding(ENDS).mapInArrow(lean(_bytes_of_zones(parts)), "bucket long, doc_id long, zone long, before int, bytes binary")
    ends = ends.repartition("bucket").mapInArrow(lean(_sort_windows), "doc_id long, zone long, mask long")
    windows = table(holding(MANY).mapInArrow(lean(_windows(parts)), "doc_id long, zone long, j int, window long"), "windows")
    least = windows.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    many = windows.join(least, "window").where("doc_id > first").groupBy("doc_id", "zone").agg(F.expr("bit_or(shiftleft(1L, j))").alias("mask"))
    gone = found.where(F.col("kind") == WHOLE).select("doc_id", "zone", F.lit(-1).cast("long").alias("mask")).unionByName(ends).unionByName(many)
    gone = gone.groupBy("doc_id", "zone").agg(F.expr("bit_or(mask)").alias("mask")).groupBy("doc_id").agg(F.collect_list(F.struct("zone", "mask")).alias("gone"))

    marks = table(live.select("doc_id", F.xxhash64("text").alias("a"), F.hash("text").alias("b")), "marks")
    firsts = marks.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = marks.join(firsts, ["a", "b"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_set("a").alias("copies"))
    info = table(gone.join(copies, "doc_id", "full").select("doc_id", "gone", "copies"), "gone")

    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.lit(0).alias("_"), *names).alias("row"), F.col("text").cast("string").alias("text"))
    hit = small(info.select("doc_id"))
    copy = F.coalesce(F.array_contains("copies", F.xxhash64("text")), F.lit(False))
    losing = packed.join(hit, "doc_id", "left_semi").join(info, "doc_id").select("row", "text", "gone", copy.alias("copy"))
    # texts that lose nothing are not taken apart
    spans = F.array().cast("array<struct<start:long,end:long>>")
    text = F.coalesce("text", F.lit(""))
    others = packed.join(hit, "doc_id", "left_anti").select("row", spans.alias("spans"), text.cast("binary").alias("kept"), F.octet_length(text).cast("long").alias("n_bytes"))
    row = losing.schema["row"].dataType.simpleString()
    shape = f"row {row}, spans array<struct<start:long,end:long>>, kept binary, n_bytes long"
    out = losing.mapInArrow(lean(_cut(parts)), shape).unionByName(others)
    return out.select(*[F.col("row")[c].alias(c) for c in names], "spans", "kept", "n_bytes")
