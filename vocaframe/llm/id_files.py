"""Token ids in binary files, Simple-8b coded, as a Spark source and sink.

A file holds documents in ascending ``doc_id`` order.  Ids are packed into
64-bit words: four bits select how many ids of how many bits the other 60 bits
hold.  An id that needs more than 60 bits is an escape: its word only says so
and the id stands in a list of its own.  Ids are coded in blocks of ``BLOCK``;
the words and escapes before each block are stored, so that any block can be
decoded alone, and all blocks of a file at once: the words of each selector are
one shift of a matrix, whose results go to places known from the selectors.

File (little-endian)::

    8 bytes "S8BIDS01"; int64: documents, ids, blocks, words, escapes
    int64 doc_id of each document; int64 ids up to the end of each document
    uint32 words before each block; uint32 escapes before each block
    uint64 words; uint64 escapes

``write_ids`` range-partitions by ``doc_id``; each task writes files of at
most ``file_ids`` ids (a longer document is a file of its own).  Files are
staged and appear at the commit, which also writes ``index.json``: the files
in order with their counts, and the ids of all files before each.  From it
every document gets its ``start`` in the whole corpus.

Cases: a null or empty list of ids is a document without ids; null ids inside
a list and negative ids are errors, as is a null ``doc_id``.  Rows with the
same ``doc_id`` are ordered by their ids.  An empty table gives an index
without files.  Columns other than ``doc_id`` and the ids are not written.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from ..sources.committed import Staging, Written, fs_and_path
from . import kernel as K
from .cached_words import Cached
from .io import lean, prepare

MAGIC = b"S8BIDS01"
BLOCK = 1024
FILE_IDS = 1 << 22
#: Bytes of texts that a task encodes at a time: each distinct run of them is
#: looked up once.
TEXT_BYTES = 1 << 21
#: Ids that one selector packs, and the bits of each; the last selector is the
#: escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
WIDTHS = 60 // COUNTS
ESCAPE = len(COUNTS) - 1
_LOW = np.uint64((1 << 60) - 1)


def _selectors(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, selector) of every word: in each block the greedy choice, all
    blocks in step."""
    n = len(ids)
    rows = np.zeros((-(-n // BLOCK), BLOCK), np.uint64)
    rows.ravel()[:n] = ids  # zeros after the end fit any word
    ends = np.minimum((np.arange(n) // BLOCK + 1) * BLOCK, n)
    fits = np.full(rows.shape, ESCAPE, np.int8)
    wide = np.zeros((len(rows), BLOCK + 1), np.int16)
    clear = np.empty(rows.shape, bool)
    for s in range(ESCAPE - 1, -1, -1):
        over = rows >= np.uint64(1 << int(WIDTHS[s]))
        if not over.any():
            fits[:] = s
            continue
        # a word may be longer than what is left of its block
        np.cumsum(over, axis=1, out=wide[:, 1:])
        last = BLOCK - int(COUNTS[s]) + 1
        np.equal(wide[:, BLOCK - last + 1:], wide[:, :last], out=clear[:, :last])
        np.equal(wide[:, last:BLOCK], wide[:, -1:], out=clear[:, last:])
        np.copyto(fits, s, where=clear)
    fits = fits.ravel()
    at = np.arange(0, n, BLOCK)
    places = []
    while len(at):
        places.append(at)
        at = at + COUNTS[fits[at]]
        at = at[at < ends[np.minimum(places[-1], n - 1)]]
    place = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
    return place, fits[place]


#: Blocks that are coded and decoded at a time.
TOGETHER = 256


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, escapes, words before each block, escapes before each block)."""
    parts, words, escapes = [], 0, 0
    for at in range(0, len(ids), TOGETHER * BLOCK):
        part = _pack(ids[at:at + TOGETHER * BLOCK])
        parts.append((part[0], part[1], part[2] + np.uint32(words), part[3] + np.uint32(escapes)))
        words, escapes = words + len(part[0]), escapes + len(part[1])
    if not parts:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.uint32),) * 2
    return tuple(np.concatenate(x) for x in zip(*parts))


def _pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = ids.astype(np.uint64)
    place, selector = _selectors(ids)
    words = selector.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate((ids, np.zeros(int(COUNTS[0]), np.uint64)))
    block_end = np.minimum((place // BLOCK + 1) * BLOCK, len(ids))
    for s in range(ESCAPE):
        own = np.flatnonzero(selector == s)
        slots = place[own, None] + np.arange(COUNTS[s])
        values = np.where(slots < block_end[own, None], padded[slots], np.uint64(0))
        words[own] |= np.bitwise_or.reduce(values << (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64), axis=1, initial=np.uint64(0))
    escaped = selector == ESCAPE
    blocks = np.arange(0, len(ids), BLOCK)
    first = np.searchsorted(place, blocks)
    before = np.concatenate(([0], np.cumsum(escaped)))[first]
    return words, ids[place[escaped]], first.astype(np.uint32), before.astype(np.uint32)


def unpack(words: np.ndarray, escapes: np.ndarray, word_offsets: np.ndarray, escape_offsets: np.ndarray, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks ``first`` to ``last`` (all of them by default) of
    ``n`` ids."""
    blocks = len(word_offsets)
    last = blocks if last is None else last
    edges = np.append(word_offsets.astype(np.int64), len(words))
    inner = np.append(escape_offsets.astype(np.int64), len(escapes))
    words, escapes, edges = words[edges[first]:edges[last]], escapes[inner[first]:inner[last]], edges[first:last + 1] - edges[first]
    selector = (words >> np.uint64(60)).astype(np.int64)
    held = COUNTS[selector]
    total = np.cumsum(held)
    # a block's first word stands at the block's place, whatever the last word before it holds beyond its end
    block = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    lead = np.concatenate(([0], total))[edges[:-1]]
    place = total - held - lead[block] + block * BLOCK
    size = max(min(last * BLOCK, n) - first * BLOCK, 0)
    out = np.zeros(size, np.uint64)
    ends = np.minimum((block + 1) * BLOCK, size)
    payload = words & _LOW
    for s in range(ESCAPE):
        own = np.flatnonzero(selector == s)
        slots = place[own, None] + np.arange(COUNTS[s])
        values = payload[own, None] >> (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64) & np.uint64((1 << int(WIDTHS[s])) - 1)
        real = slots < ends[own, None]
        out[slots[real]] = values[real]
    out[place[selector == ESCAPE]] = escapes
    return out


def file_bytes(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's content."""
    words, escapes, word_offsets, escape_offsets = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(word_offsets), len(words), len(escapes)], "<i8")
    parts = (head, doc_ids.astype("<i8"), np.cumsum(counts).astype("<i8"), word_offsets.astype("<u4"), escape_offsets.astype("<u4"), words.astype("<u8"), escapes.astype("<u8"))
    return MAGIC + b"".join(p.tobytes() for p in parts)


def parse_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id of each document, ids up to the end of each, all ids)."""
    if content[:8] != MAGIC:
        raise ValueError("not an id file")
    docs, n, blocks, words, escapes = np.frombuffer(content, "<i8", 5, 8).tolist()
    at, parts = 48, []
    for kind, size in (("<i8", docs), ("<i8", docs), ("<u4", blocks), ("<u4", blocks), ("<u8", words), ("<u8", escapes)):
        parts.append(np.frombuffer(content, kind, size, at))
        at += parts[-1].nbytes
    if at != len(content):
        raise ValueError("an id file is cut off")
    doc_ids, ends, word_offsets, escape_offsets, coded, escaped = parts
    ids = np.empty(n, np.uint64)
    for first in range(0, blocks, TOGETHER):
        last = min(first + TOGETHER, blocks)
        ids[first * BLOCK:last * BLOCK] = unpack(coded, escaped, word_offsets, escape_offsets, n, first, last)
    return doc_ids, ends, ids


@dataclass
class IdsWritten(Written):
    #: (name, documents, ids, first doc_id) of each file of a task
    files: list


class IdWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, file_ids: int) -> None:
        self.staging, self.file_ids = Staging(folder), file_ids

    def write(self, iterator: Iterator[pa.RecordBatch]) -> IdsWritten:
        attempt, made, files = self.staging.attempt(), set(), []
        part = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> None:
            nonlocal held, size
            docs, counts, ids = (np.concatenate(x) for x in zip(*held))
            name = f"part-{part:06d}-{len(files):06d}.ids"
            self.staging.put(attempt, name, file_bytes(docs, counts, ids), made)
            files.append((name, len(docs), len(ids), int(docs[0])))
            held, size = [], 0

        for docs, edges, values in self._documents(iterator):
            at = 0
            while at < len(docs):
                room = edges[at] + max(self.file_ids - size, 1)
                end = min(max(int(np.searchsorted(edges, room, "right")) - 1, at + 1), len(docs))
                ids = values[edges[at]:edges[end]]
                if size and size + len(ids) > self.file_ids:
                    flush()
                    continue
                if len(ids) and ids.min() < 0:
                    raise ValueError("an id is negative")
                held.append((docs[at:end], np.diff(edges[at:end + 1]), ids))
                size += len(ids)
                at = end
                if size >= self.file_ids:
                    flush()
        if held:
            flush()
        return IdsWritten(attempt, files)

    def _documents(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(doc_ids, where each one's ids begin and the end, ids)."""
        for batch in iterator:
            if not batch.num_rows:
                continue
            lists = batch["ids"]
            edges = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values
            if batch["doc_id"].null_count or values.slice(edges[0], edges[-1] - edges[0]).null_count:
                raise ValueError("doc_id and ids must not be null")
            yield batch["doc_id"].to_numpy(), edges, values.to_numpy(zero_copy_only=False).astype(np.int64)

    def commit(self, messages: list) -> None:
        self.staging.commit([m.attempt for m in messages if m])
        # parts are ranges of doc_id in order, files of a part are numbered
        files, start = [], 0
        for name, docs, ids, first in sorted(f for m in messages if m for f in m.files):
            files.append({"file": name, "documents": docs, "ids": ids, "first_doc_id": first, "start": start})
            start += ids
        index = Staging(self.staging.folder)
        attempt = index.attempt()
        index.put(attempt, "index.json", json.dumps({"ids": start, "files": files}).encode())
        index.commit([attempt])

    def abort(self, messages: list) -> None:
        self.staging.abort()


class TextWriter(IdWriter):
    """Takes ``doc_id, text`` and encodes the texts itself: a task runs one
    Python worker, and ids are neither shuffled nor written twice."""

    def __init__(self, folder: str, file_ids: int, tokenizer: bytes, end_id: int | None) -> None:
        super().__init__(folder, file_ids)
        self.tokenizer, self.end_id = tokenizer, end_id

    def _documents(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        words = _words(self.tokenizer)
        for batch in iterator:
            if batch["doc_id"].null_count:
                raise ValueError("doc_id must not be null")
            for at, ids, counts in _encoded(words, batch["text"], self.end_id):
                yield batch["doc_id"].slice(at, len(counts)).to_numpy(), np.concatenate(([0], np.cumsum(counts))), ids


@dataclass
class IdFile(InputPartition):
    path: str
    start: int


class IdReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def partitions(self) -> list[IdFile]:
        fs, path = fs_and_path(f"{self.folder}/index.json")
        with fs.open_input_stream(path) as f:
            index = json.loads(f.read())
        return [IdFile(f"{self.folder}/{x['file']}", x["start"]) for x in index["files"]] or [IdFile("", 0)]

    def read(self, partition: IdFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, path = fs_and_path(partition.path)
        with fs.open_input_file(path) as f:
            docs, ends, ids = parse_file(f.read())
        edges = np.concatenate(([0], ends)).astype(np.int64)
        step = 1 << 12
        for at in range(0, len(docs), step):
            end = min(at + step, len(docs))
            offsets = pa.array(edges[at:end + 1] - edges[at], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids[edges[at]:edges[end]].view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(docs[at:end], pa.int64()), pa.array(partition.start + edges[at:end], pa.int64()), lists], names=["doc_id", "start", "ids"])


class IdFiles(DataSource):
    """``format("simple8b_ids")``: writes ``doc_id long, ids array<long>``
    (rows of a partition in order, partitions in the order of their numbers),
    or ``doc_id long, text string`` with the option ``tokenizer``; reads them with ``start``, the ids of all documents before."""

    @classmethod
    def name(cls) -> str:
        return "simple8b_ids"

    def schema(self) -> str:
        return "doc_id long, start long, ids array<long>"

    def writer(self, schema, overwrite: bool) -> IdWriter:
        if overwrite:
            raise ValueError("an id folder is written once: use mode('append') and a new folder")
        folder, file_ids = self.options["path"], int(self.options.get("file_ids", FILE_IDS))
        if "tokenizer" not in self.options:
            return IdWriter(folder, file_ids)
        with open(self.options["tokenizer"], "rb") as f:  # on the driver; tasks get the content
            content = f.read()
        end_id = self.options.get("end_id")
        return TextWriter(folder, file_ids, content, int(end_id) if end_id is not None else None)

    def reader(self, schema) -> IdReader:
        return IdReader(self.options["path"])


def write_ids(df: DataFrame, folder: str, ids: str = "ids", file_ids: int = FILE_IDS) -> None:
    """Write ``df``'s ids to ``folder`` in ascending ``doc_id`` order, in files
    of ``file_ids`` ids at most.

    ``df`` should be a written table: the range partitioning samples it first."""
    spark = df.sparkSession
    prepare(spark)
    spark.dataSource.register(IdFiles)
    kind = dict(df.dtypes)[ids]
    filled = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(ids), F.array().cast(kind)).alias("ids"))
    ordered = filled.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.select("doc_id", F.col("ids").cast("array<long>").alias("ids")).write.format("simple8b_ids").option("file_ids", file_ids).mode("append").save(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start long, ids array<long>`` of a folder; a task reads a file."""
    prepare(spark)
    spark.dataSource.register(IdFiles)
    return spark.read.format("simple8b_ids").load(folder)


def little_endian(df: DataFrame, ids: str = "ids", name: str = "bytes") -> DataFrame:
    """``df`` with ``name binary``: the ids as unsigned 32-bit little-endian
    numbers (an id beyond 32 bits is an error)."""
    names = [c for c in df.columns if c != name]
    packed = df.select(F.struct(F.lit(0).alias("_"), *names).alias("row"), F.col(ids).cast("array<long>").alias("ids"))
    row = packed.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["ids"]
            edges = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)
            if len(values) and (values.min() < 0 or values.max() >= 1 << 32):
                raise ValueError("an id does not fit 32 bits")
            raw = values.astype("<u4")
            ends = (edges - edges[0]) * 4
            flat = pa.py_buffer(np.ascontiguousarray(raw[edges[0]:edges[-1]]))
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), flat])
            yield pa.RecordBatch.from_arrays([b["row"], blobs.cast(pa.binary())], names=["row", name])

    return packed.mapInArrow(lean(run), f"row {row}, {name} binary").select(*[F.col("row")[c].alias(c) for c in names], name)


# --- ids of texts -------------------------------------------------------------

_LOADED: dict[int, Cached] = {}


def _words(content: bytes) -> Cached:
    """One tokenizer a worker process."""
    key = hash(content)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Cached.dropping_space(content)
    return _LOADED[key]


def _encoded(words: Cached, texts: pa.Array, end_id: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, ids of each text) of a batch, a slice at a time."""
    for at, data, offsets in K.chunks(texts, TEXT_BYTES):
        ids, counts = words.encode(data, offsets)
        if end_id is not None:
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
        yield at, ids, counts


def _encode(content, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(content.value)
        for b in batches:
            for at, ids, counts in _encoded(words, b["text"], end_id):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(at, len(counts)), lists], names=["doc_id", "ids"])

    return run


def encode_words(docs: DataFrame, path: str, end_id: int | None = None) -> DataFrame:
    """``doc_id long, ids array<int>`` of every whole ``text`` (null: empty) by
    the ``tokenizers`` file ``path``, without added special tokens; ``end_id``
    is put after each document.  The file's pre-tokenizer must split at white
    space and drop it, and its normalizer must not join what white space
    separates."""
    spark = docs.sparkSession
    prepare(spark)
    with open(path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())  # one vocabulary file
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lean(_encode(content, end_id)), "doc_id long, ids array<int>")


def save_texts(docs: DataFrame, path: str, folder: str, end_id: int | None = None, file_ids: int = FILE_IDS) -> None:
    """Encode ``docs`` as :func:`encode_words` does and write the ids to
    ``folder`` in ascending ``doc_id`` order.  The texts are range-partitioned;
    each task encodes and packs its range.  Rows with the same ``doc_id`` are
    ordered by their texts."""
    spark = docs.sparkSession
    prepare(spark)
    spark.dataSource.register(IdFiles)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    writer = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").write.format("simple8b_ids").mode("append")
    writer = writer.option("file_ids", file_ids).option("tokenizer", path)
    (writer if end_id is None else writer.option("end_id", end_id)).save(folder)
