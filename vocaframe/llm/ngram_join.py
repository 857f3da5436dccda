"""N-gram Jaccard join by signature trees.

Two texts link when the Jaccard similarity of their sets of distinct word
shingles reaches a threshold.  The join is exact, with shingles compared by
64-bit hashes:

1. Every text gives its size, a hash of its set, and a small bitmap; equal
   sets are one vertex from here on, so exact copies cost nothing further.
2. A prefix filter routes vertices: in one global order, rare shingles first
   (``rarity``), two linked sets share a shingle among the first
   ``n - ceil(threshold * n) + 1`` of each.  Vertices that meet in one such
   shingle and whose sizes are compatible form a group; groups are stored as
   blocks of bounded size, identical groups once.
3. Each group is linked to one representative, and components of these links
   collapse groups of near copies without listing their pairs.  Narrow bitmaps
   exclude most of the pairs, the sets of the others are compared exactly.
4. Groups that still hold several components are joined by signature trees
   (``signature_tree``): first whole blocks by their OR bitmaps, size ranges
   and component ranges, then a dual traversal inside the surviving block
   pairs; what remains is checked exactly.

A shingle in so many sets that one task could not hold them is split by salt;
its blocks meet again through their block summaries.

Cases: a null or empty text, or one without words, has no shingles and links
with nothing; a text with fewer words than the shingle length is one shingle;
repeated rows link like equal texts; rows without a doc_id are returned with a
null component and link nothing; an empty table gives an empty result.  Texts
are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import rarity
from . import signature_tree as T
from .components import components
from .io import batch, lean, prepare, small, table, whole
from .verify import matching_pairs, routes

BLOCK = 256
#: Sets of one shingle that a task groups together before the shingle is salted.
SALT_ROWS = 1 << 16

_META = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("vid", pa.int64()), ("sig", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])


def _sets(b: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every text of a batch."""
    for at, data, offsets in K.chunks(b["text"]):
        hashes, first = K.words(data, offsets)
        for i in range(len(offsets) - 1):
            yield at + i, K.distinct(K.shingles(hashes[first[i]:first[i + 1]], k))


def _vid(s: np.ndarray) -> np.int64:
    return K.set_hash(s).astype(np.int64)


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = rarity.Counter()
        for b in batches:
            sets = [s for _, s in _sets(b, k)]
            if not sets:
                continue
            for s in range(0, len(sets), 512):
                counter.add(np.concatenate(sets[s:s + 512]))
            none = pa.nulls(len(sets))
            yield batch(_META, b["doc_id"], [len(s) for s in sets], [_vid(s) for s in sets], [T.bitmap(s) if len(s) else None for s in sets], none.cast(pa.int32()), none.cast(pa.binary()))
        parts = counter.parts()
        none = pa.nulls(len(parts))
        yield batch(_META, none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.binary()), list(range(len(parts))), parts)

    return run


_ROUTE = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("vid", pa.int64()), ("n", pa.int32())])


def _prefixes(k: int, percent: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = counts.value, set()
        for b in batches:
            keys, vids, sizes = [], [], []
            for _, s in _sets(b, k):
                n = len(s)
                if not n or (v := int(_vid(s))) in seen:  # copies within the task route once
                    continue
                seen.add(v)
                keys.append(s[np.argsort(common[rarity.slot(s)], kind="stable")[:n - (percent * n + 99) // 100 + 1]])
                vids.append(v)
                sizes.append(n)
            if keys:
                lengths = [len(x) for x in keys]
                key = np.concatenate(keys)
                vid = np.repeat(np.array(vids, np.int64), lengths)
                salts = common[rarity.slot(key)] // SALT_ROWS + 1
                salt = np.where(salts > 1, (K.unsigned(vid) >> np.uint64(7)) % salts.astype(np.uint64), 1 << 30).astype(np.int32)
                yield batch(_ROUTE, K.signed(key), np.where(salt < 1 << 30, salt, -1).astype(np.int32), vid, np.repeat(np.array(sizes, np.int32), lengths))

    return run


_BLOCKS = pa.schema([("gid", pa.int64()), ("block", pa.int64()), ("vids", pa.list_(pa.int64()))])


def _blocks(percent: int):
    """Groups of a partition, as blocks.  A group of one block is named by its
    members, a larger or salted one by its shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = whole(batches)
        if t is None:
            return
        key, salt, vid, n = (t[c].to_numpy() for c in ("key", "salt", "vid", "n"))
        at = np.lexsort((vid, n, salt, key))
        key, salt, vid, n = key[at], salt[at], vid[at], n[at].astype(np.int64)
        # the same vertex may come from several tasks
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (vid[1:] != vid[:-1]) | (salt[1:] != salt[:-1])
        key, salt, vid, n = key[new], salt[new], vid[new], n[new]
        cut = np.ones(len(key), bool)
        cut[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | ((100 * n[:-1] < percent * n[1:]) & (salt[1:] < 0))
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(key)))
        gid, block, vids = [], [], []
        for s, size in zip(starts, sizes):
            if size == 1 and salt[s] < 0:
                continue
            members = vid[s:s + size]
            if size <= BLOCK and salt[s] < 0:
                name = K.signed(K.mix(K.unsigned(np.sort(members)) + np.uint64(size))).sum()
                gid.append(name), block.append(name), vids.append(members)
            else:
                # chains of compatible sizes of one shingle are groups of their own
                name = key[s] if salt[s] >= 0 else key[s] ^ np.int64(n[s])
                for i in range(0, size, BLOCK):
                    gid.append(name), vids.append(members[i:i + BLOCK])
                    block.append(K.signed(K.mix(K.unsigned(members[i:i + 1]) + np.uint64(salt[s] + 2)))[0])
        if gid:
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(v) for v in vids])]).astype(np.int32), np.concatenate(vids))
            yield batch(_BLOCKS, np.array(gid, np.int64), np.array(block, np.int64), lists)

    return run


_SETS = pa.schema([("doc_id", pa.int64()), ("vid", pa.int64()), ("tokens", pa.binary())])


def _tokens(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for _, s in _sets(b, k)]
            yield batch(_SETS, b["doc_id"], [_vid(s) for s in sets], [s.tobytes() for s in sets])

    return run


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _traverse(percent: int):
    """Candidate pairs of each group of a partition: rows (pair, side, vid, n,
    sig, comp); side 2 joins a block with itself, 0 and 1 are two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = whole(batches)
        if t is None:
            return
        pair, low, side, vid, n, comp = (t[c].to_numpy() for c in ("pair", "low", "side", "vid", "n", "comp"))
        sigs = t["sig"]
        at = np.lexsort((side, low, pair))
        edge = np.ones(len(at), bool)
        edge[1:] = (pair[at][1:] != pair[at][:-1]) | (low[at][1:] != low[at][:-1]) | (side[at][1:] != side[at][:-1])
        runs = np.split(at, np.flatnonzero(edge)[1:])
        out: set[tuple[int, int]] = set()

        def emit() -> pa.RecordBatch:
            got = np.array(list(out), np.int64)
            out.clear()
            return batch(_PAIRS, got[:, 0], got[:, 1])

        def tree(rows: np.ndarray, bits: int) -> T.Tree:
            return T.Tree(n[rows].astype(np.int64), [sigs[int(r)].as_buffer() for r in rows], comp[rows], bits)

        r = 0
        while r < len(runs):
            rows = runs[r]
            two = side[rows[0]] == 0 and r + 1 < len(runs) and pair[runs[r + 1][0]] == pair[rows[0]] and low[runs[r + 1][0]] == low[rows[0]]
            other = runs[r + 1] if two else None
            # as wide as the narrowest bitmap, so that all can be folded to it
            bits = T.width(int(min(n[rows].min(), n[other].min()) if two else n[rows].min()))
            if two or side[rows[0]] == 2:
                i, j = T.dual_traversal(tree(rows, bits), tree(other, bits) if two else None, percent)
                x, y = vid[rows[i]], vid[(other if two else rows)[j]]
                out.update(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))
            r += 2 if two else 1
            if len(out) > 1 << 18:
                yield emit()
        if out:
            yield emit()

    return run


_NARROW = pa.schema([("a", pa.int64()), ("salt", pa.int64()), ("vid", pa.int64()), ("n", pa.int32()), ("sig", pa.binary())])


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield batch(_NARROW, b["a"], b["salt"], b["vid"], b["n"], [T.narrow(s.as_buffer()) for s in b["sig"]])


def _plausible(percent: int):
    """Pairs of a partition that bitmaps do not exclude: rows (a, salt, vid, n,
    sig), a's own among those of each salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = whole(batches)
        if t is None:
            return
        a, salt, vid, n = (t[c].to_numpy() for c in ("a", "salt", "vid", "n"))
        sigs, out, own, at = t["sig"], [], None, None
        first = vid == a
        for r in np.lexsort((~first, salt, a)).tolist():
            sig = sigs[r].as_buffer()
            if first[r]:
                own, at = (sig, int(n[r])), (a[r], salt[r])
            elif at == (a[r], salt[r]) and T.may_match(*own, sig, int(n[r]), percent):
                out.append((a[r], vid[r]))
        if out:
            got = np.array(out, np.int64)
            yield batch(_PAIRS, got[:, 0], got[:, 1])

    return run


def link_classes(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (columns
    doc_id and text; others are ignored).  ``percent``: the Jaccard threshold
    in hundredths.  See the module's text for the method and the cases."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = table(docs.mapInArrow(lean(_describe(k)), "doc_id long, n int, vid long, sig binary, part int, counts binary"), "described")
    counts = rarity.counters(described.where("part is not null"))
    meta = described.where("part is null").select("doc_id", "n", "vid", "sig")
    live = docs.where("doc_id is not null")
    vertices = meta.where("doc_id is not null and n > 0").groupBy("vid").agg(F.min("doc_id").alias("doc_id"))
    reps = table(vertices, "vertices")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        return matching_pairs(pairs, live, reps, _tokens(k), percent, name)

    routed = live.select("text").mapInArrow(lean(_prefixes(k, percent, counts)), "key long, salt int, vid long, n int")
    grouped = routed.repartition("key", "salt").mapInArrow(lean(_blocks(percent)), "gid long, block long, vids array<long>")
    blocks = table(grouped.dropDuplicates(["gid", "block"]), "blocks")

    # links to one representative of each group: the member of most groups, for
    # the rarer a text's shingles are, the further it is from the others
    each = table(blocks.select("gid", "block", F.explode("vids").alias("vid")), "each")
    degree = each.groupBy("vid").agg(F.countDistinct("gid").alias("degree"))
    first = each.join(degree, "vid").groupBy("gid").agg(F.max_by("vid", F.struct("degree", "vid")).alias("a"))
    stars = each.join(first, "gid").select("a", F.col("vid").alias("b"))
    needs = routes(stars, reps, "near")
    held = meta.join(small(needs), ["vid", "doc_id"]).select("a", "salt", "vid", "n", "sig").mapInArrow(lean(_narrowed), "a long, salt long, vid long, n int, sig binary")
    near = held.repartition("a", "salt").mapInArrow(lean(_plausible(percent)), "a long, b long")
    links = linked(near, "stars")
    classes = table(components(links), "classes").select(F.col("node").alias("vid"), F.col("component").alias("comp"))

    # groups of several components
    members = each.join(classes, "vid", "left").withColumn("comp", F.coalesce("comp", "vid"))
    members = table(members, "members")
    mixed = members.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.countDistinct("block").alias("blocks")).where("lo != hi").select("gid", "blocks")
    sigs = meta.where("doc_id is not null and n > 0").select("vid", "n", "sig").dropDuplicates(["vid"])
    rows = table(members.join(mixed, "gid").join(sigs, "vid"), "rows")
    pairs = _block_pairs(rows, percent)
    found = pairs.repartition("pair", "low").mapInArrow(lean(_traverse(percent)), "a long, b long")
    more = linked(found, "found")

    ids = reps.select("vid", "doc_id")
    named = links.unionByName(more).join(ids.select(F.col("vid").alias("a"), F.col("doc_id").alias("u")), "a").join(ids.select(F.col("vid").alias("b"), F.col("doc_id").alias("v")), "b").select("u", "v")
    named = table(components(named, "u", "v"), "named")
    labels = reps.join(named, reps.doc_id == named.node, "left").select("vid", F.coalesce("component", "doc_id").alias("component_id"))
    out = meta.select("doc_id", "n", "vid").join(labels, "vid", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def _block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of the blocks that have to be compared, once for each pair of
    blocks: pruned on the summaries of the blocks (the top of the tree)."""
    alone = rows.where("blocks = 1").select(F.col("gid").alias("pair"), F.lit(0).cast("long").alias("low"), F.lit(2).alias("side"), "vid", "n", "sig", "comp")
    many = rows.where("blocks > 1")
    tops = many.groupBy("gid", "block").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    a, b = tops.alias("a"), tops.alias("b")
    meets = (
        (F.col("a.gid") == F.col("b.gid"))
        & (F.col("a.block") <= F.col("b.block"))
        & (100 * F.col("a.n1") >= percent * F.col("b.n0"))
        & (100 * F.col("b.n1") >= percent * F.col("a.n0"))
        & ~((F.col("a.c0") == F.col("a.c1")) & (F.col("b.c0") == F.col("b.c1")) & (F.col("a.c0") == F.col("b.c0")))
    )
    two = a.join(b, meets).select(F.col("a.gid").alias("gid"), F.col("a.block").alias("x"), F.col("b.block").alias("y"))
    sides = two.select("gid", F.col("x").alias("block"), "x", "y", F.when(F.col("x") == F.col("y"), 2).otherwise(0).alias("side")).unionByName(
        two.where("x != y").select("gid", F.col("y").alias("block"), "x", "y", F.lit(1).alias("side"))
    )
    spread = many.join(sides, ["gid", "block"]).select(F.xxhash64("gid", "x").alias("pair"), F.xxhash64("gid", "y", "x").alias("low"), "side", "vid", "n", "sig", "comp")
    return alone.unionByName(spread)


def unique_documents(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` without near duplicates: of each class the row with the
    smallest doc_id stays; rows without a doc_id stay."""
    classes = link_classes(docs, k, percent)
    drop = classes.where("component_id != doc_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"))
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
