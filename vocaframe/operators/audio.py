"""WAV audio: header inspection, decoding, resampling, channel mixing, encoding.

The only Python in the library.  Spark partitions the files and ships them in
Arrow batches to ``mapInArrow``; inside a task each file is a few NumPy
calls.  Headers are read by walking the chunk list, whatever stands before
the audio.
"""

from __future__ import annotations

import math
import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .. import constants as K
from ..session import ship_package

WAVE_FORMAT_PCM = 1
WAVE_FORMAT_FLOAT = 3
WAVE_FORMAT_EXTENSIBLE = 0xFFFE


class WavError(ValueError):
    pass


def walk_header(read_at, total: int) -> dict:
    """Fields of a RIFF/WAVE header: format, channels, rate, bits, data
    offset, data size and frame count.

    ``read_at(offset, n)`` gives up to ``n`` bytes of a file of ``total``
    bytes; only the chunk heads and the ``fmt`` chunk are read.  A header
    that no audio can have (no channels, rate 0 or beyond 31 bits, a frame
    size that its fields contradict) is an error; a frame size of 0 is
    derived from channels and bits."""
    head = read_at(0, 12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise WavError("not a RIFF/WAVE file")
    pos, fmt = 12, None
    while pos + 8 <= total:
        chunk = read_at(pos, 8)
        if len(chunk) < 8:
            break
        cid, size = chunk[:4], struct.unpack("<I", chunk[4:])[0]
        body = pos + 8
        if cid == b"fmt ":
            raw = read_at(body, min(size, 40))
            if len(raw) < 16:
                raise WavError("truncated fmt chunk")
            tag, ch, rate, _, align, bits = struct.unpack_from("<HHIIHH", raw, 0)
            if tag == WAVE_FORMAT_EXTENSIBLE and size >= 40 and len(raw) >= 26:
                tag = struct.unpack_from("<H", raw, 24)[0]
            if ch < 1:
                raise WavError("no channels")
            if not 0 < rate < 1 << 31:
                raise WavError(f"bad sample rate {rate}")
            if bits < 8 or bits % 8:
                raise WavError(f"unsupported width {bits}")
            frame = ch * bits // 8
            if align not in (0, frame):
                raise WavError(f"frame size {align} does not fit {ch} channels of {bits} bits")
            fmt = dict(format=tag, channels=ch, sample_rate=rate, block_align=frame, bits=bits)
        elif cid == b"data":
            if fmt is None:
                raise WavError("data chunk before fmt chunk")
            size = min(size, max(total - body, 0))  # streams announce more than they hold
            return dict(fmt, data_offset=body, data_size=size, n_frames=size // fmt["block_align"])
        pos = body + size + (size & 1)
    raise WavError("no data chunk in header")


def parse_header(buf: bytes, total_length: int | None = None) -> dict:
    """:func:`walk_header` of bytes in memory; ``total_length``: of the file
    that they begin."""
    return walk_header(lambda at, n: bytes(buf[at:at + n]), len(buf) if total_length is None else total_length)


#: Columns of a header row and their Spark types.
HEADER_FIELDS = {"sample_rate": "int", "n_channels": "int", "bits": "int", "n_frames": "bigint", "seconds": "double", "error": "string"}


def header_type():
    import pyarrow as pa

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    return pa.struct([(k, kinds[t]) for k, t in HEADER_FIELDS.items()])


def header_row(read_at, total: int) -> dict:
    """One row of ``HEADER_FIELDS``; a bad header gives an ``error``."""
    try:
        h = walk_header(read_at, total)
    except (WavError, struct.error) as e:
        return dict.fromkeys(HEADER_FIELDS) | {"error": str(e)}
    return dict(sample_rate=h["sample_rate"], n_channels=h["channels"], bits=h["bits"], n_frames=h["n_frames"],
                seconds=h["n_frames"] / h["sample_rate"], error=None)


def decode(content: bytes) -> tuple[int, np.ndarray]:
    """``(sample_rate, float32 array channels x frames)`` scaled to [-1, 1)."""
    h = parse_header(content, len(content))
    return h["sample_rate"], scaled(memoryview(content)[h["data_offset"]:h["data_offset"] + h["n_frames"] * h["block_align"]], h)


def scaled(raw, h: dict) -> np.ndarray:
    """Whole frames of a file with header ``h`` as float32 channels x frames."""
    ch, bits, fmt = h["channels"], h["bits"], h["format"]
    if fmt == WAVE_FORMAT_FLOAT and bits == 32:
        x = np.frombuffer(raw, dtype="<f4").astype(np.float32)
    elif fmt == WAVE_FORMAT_FLOAT and bits == 64:
        x = np.frombuffer(raw, dtype="<f8").astype(np.float32)
    elif fmt == WAVE_FORMAT_PCM and bits == 8:
        x = (np.frombuffer(raw, dtype=np.uint8).astype(np.float32) - 128.0) / 128.0
    elif fmt == WAVE_FORMAT_PCM and bits == 16:
        x = np.frombuffer(raw, dtype="<i2").astype(np.float32) / 32768.0
    elif fmt == WAVE_FORMAT_PCM and bits == 24:
        b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)
        v = np.where(v >= 1 << 23, v - (1 << 24), v)
        x = v.astype(np.float32) / float(1 << 23)
    elif fmt == WAVE_FORMAT_PCM and bits == 32:
        x = (np.frombuffer(raw, dtype="<i4").astype(np.float64) / float(1 << 31)).astype(np.float32)
    else:
        raise WavError(f"unsupported WAV encoding: format {fmt}, {bits} bit")
    return x.reshape(-1, ch).T


def mono(x: np.ndarray) -> np.ndarray:
    """The mean over channels."""
    return x.mean(axis=0, dtype=np.float64).astype(np.float32) if x.shape[0] > 1 else x[0]


def encode_pcm(channels: np.ndarray, sample_rate: int, bits: int = 16) -> bytes:
    """WAV bytes from integer samples at 16-bit scale (channels x frames).

    8-bit keeps the high byte (unsigned), 24 and 32-bit shift left."""
    a = np.asarray(channels, dtype=np.int64)
    if a.ndim == 1:
        a = a[None, :]
    inter = a.T.reshape(-1)
    if bits == 8:
        data = ((inter >> 8) + 128).astype(np.uint8).tobytes()
    elif bits == 16:
        data = inter.astype("<i2").tobytes()
    elif bits == 24:
        v = (inter << 8).astype(np.int64) & 0xFFFFFF
        data = np.stack([v & 0xFF, (v >> 8) & 0xFF, (v >> 16) & 0xFF], axis=1).astype(np.uint8).tobytes()
    elif bits == 32:
        data = (inter << 16).astype("<i4").tobytes()
    else:
        raise WavError(f"unsupported width {bits}")
    return _wav_bytes(data, a.shape[0], sample_rate, bits, WAVE_FORMAT_PCM)


def encode_float(wave: np.ndarray, sample_rate: int) -> bytes:
    """16-bit PCM WAV bytes from a float waveform in [-1, 1) (clipped), at the
    scale of :func:`decode`, so that 16-bit samples survive a round trip."""
    a = np.atleast_2d(np.asarray(wave, dtype=np.float64))
    ints = np.clip(np.rint(a * 32768.0), -32768, 32767).astype(np.int64)
    return encode_pcm(ints, sample_rate, 16)


def _wav_bytes(data: bytes, n_ch: int, rate: int, bits: int, tag: int) -> bytes:
    align = n_ch * bits // 8
    fmt = struct.pack("<HHIIHH", tag, n_ch, rate, rate * align, align, bits)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    if len(data) & 1:
        body += b"\x00"
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _kernel(t: np.ndarray, cutoff: float, zeros: int) -> np.ndarray:
    """Low-pass impulse response at times ``t`` (in input samples): a sinc of
    the cut-off frequency, faded out by a squared cosine over ``zeros`` zero
    crossings on either side."""
    u = t * cutoff
    fade = np.where(np.abs(u) < zeros, np.cos(np.pi * u / (2 * zeros)), 0.0)
    return cutoff * np.sinc(u) * fade * fade


#: Zero crossings on either side of the filter, and its cut-off as a share of
#: the lower of the two Nyquist frequencies.
ZEROS, ROLLOFF = 6, 0.99


def reach_of(orig: int, new: int, zeros: int = ZEROS, rolloff: float = ROLLOFF) -> int:
    """Input frames that an output frame needs on either side."""
    return int(zeros / (rolloff * min(1.0, new / orig))) + 1


def resample(x: np.ndarray, orig: int, new: int, zeros: int = ZEROS, rolloff: float = ROLLOFF) -> np.ndarray:
    """Band-limited resampling of ``x`` (..., frames); the result has
    ``ceil(frames * new / orig)`` frames and counts the signal as 0 outside.

    Output frame m lies at input time ``m * orig / new`` and is the sum of
    the input frames around it, weighted by :func:`_kernel`.  Frames are made
    in blocks of bounded size, whatever the two rates are."""
    if orig == new:
        return x.astype(np.float32, copy=False)
    frames = x.shape[-1]
    if frames == 0:
        return np.zeros(x.shape, dtype=np.float32)
    reach = reach_of(orig, new, zeros, rolloff)
    padded = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(reach, reach)])
    return _weighted(padded, 0, 0, -(-frames * new // orig), orig, new, zeros, rolloff)


def resample_part(x: np.ndarray, start: int, left: np.ndarray, right: np.ndarray, orig: int, new: int) -> tuple[int, np.ndarray]:
    """The output frames of :func:`resample` that lie in the input frames
    ``start`` to ``start + len(x)`` of a longer signal, and the number of the
    first: ``left`` and ``right`` are the frames beside ``x`` (``reach_of`` of
    them, fewer only where the signal ends)."""
    if orig == new:
        return start, x.astype(np.float32, copy=False)
    first, last = -(-start * new // orig), -(-(start + len(x)) * new // orig)
    reach = reach_of(orig, new)
    left, right = left[max(len(left) - reach, 0):], right[:reach]
    padded = np.concatenate((np.zeros(reach - len(left), x.dtype), left, x, right, np.zeros(reach - len(right), x.dtype)))
    return first, _weighted(padded, start, first, last, orig, new, ZEROS, ROLLOFF)


def _weighted(padded: np.ndarray, origin: int, first: int, last: int, orig: int, new: int, zeros: int, rolloff: float) -> np.ndarray:
    """Output frames ``first`` to ``last``; ``padded`` begins ``reach`` frames
    before the input frame ``origin``."""
    cutoff = rolloff * min(1.0, new / orig)
    reach = reach_of(orig, new, zeros, rolloff)
    taps = np.arange(2 * reach + 1)
    table = _phases(orig, new, cutoff, zeros, reach)
    out = np.empty((*padded.shape[:-1], last - first), dtype=np.float32)
    step = max(1, (1 << 18) // len(taps))
    for begin in range(first, last, step):
        at = np.arange(begin, min(begin + step, last), dtype=np.int64) * orig
        nearest, rest = at // new - origin, at % new
        if table is None:
            weight = _kernel(taps - reach - (rest / new)[:, None], cutoff, zeros)
        else:
            weight = table[rest // math.gcd(orig, new)]
        out[..., begin - first:begin - first + len(at)] = np.einsum("...mt,mt->...m", padded[..., nearest[:, None] + taps], weight)
    return out


@lru_cache(16)
def _phases(orig: int, new: int, cutoff: float, zeros: int, reach: int) -> np.ndarray | None:
    """Weights of the few places between input frames that output frames can
    have; None if there are too many to keep."""
    n = new // math.gcd(orig, new)
    if n * (2 * reach + 1) > 1 << 18:
        return None
    return _kernel(np.arange(-reach, reach + 1) - (np.arange(n) / n)[:, None], cutoff, zeros)


def preprocess(content: bytes, target_rate: int = K.SAMPLE_RATE) -> np.ndarray:
    """Mono float32 waveform at ``target_rate``.  Channels are averaged
    before resampling: both steps are linear, so the result equals
    resample-then-average up to rounding, at 1/channels of the cost."""
    rate, x = decode(content)
    return resample(mono(x), rate, target_rate)


# --- DataFrame operators ----------------------------------------------------
# Each runs as mapInArrow: Arrow record batches in and out, no pandas
# conversion of the binary or list columns.

#: Clips that a step holds decoded at a time; an Arrow batch may bring more.
ROWS = 64


def _slices(batches):
    """The batches in slices of ``ROWS`` rows, which share their memory."""
    for rb in batches:
        for at in range(0, rb.num_rows, ROWS):
            yield rb.slice(at, ROWS)


def _offsets(lists) -> np.ndarray:
    """Where each list begins in ``lists.flatten()``; the offsets of a slice
    count from the start of its batch."""
    at = lists.offsets.to_numpy()
    return at - at[:1]


def _float_lists(parts: list, valid: list[bool]):
    import pyarrow as pa

    offsets = np.zeros(len(valid) + 1, dtype=np.int32)
    lengths = [len(p) if ok else 0 for p, ok in zip(parts, valid)]
    np.cumsum(lengths, out=offsets[1:])
    kept = [p for p, ok in zip(parts, valid) if ok]
    values = np.concatenate(kept).astype(np.float32) if kept else np.zeros(0, np.float32)
    mask = pa.array([not ok for ok in valid], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask)


def _map(slim: DataFrame, run, made: str, id_col: str, kept: list[str]) -> DataFrame:
    """``run`` on the Arrow batches of ``slim`` (``id`` first): the id, the
    columns ``made`` by ``run`` and the ``kept`` ones, which are the last of
    ``slim``.  Rows stay in their task and in their order."""
    fields = list(StructType.fromDDL(made))
    extra = slim.schema.fields[len(slim.columns) - len(kept):]
    inner = [StructField("id", slim.schema["id"].dataType), *fields, *(StructField(f"kept_{i}", f.dataType) for i, f in enumerate(extra))]
    names = [f.name for f in inner]

    def batches(stream):
        import pyarrow as pa

        for rb in _slices(stream):
            last = rb.columns[rb.num_columns - len(kept):]
            yield pa.RecordBatch.from_arrays([rb.column(0), *run(rb), *last], names=names)

    return slim.mapInArrow(batches, StructType(inner)).withColumnsRenamed({"id": id_col} | {f"kept_{i}": c for i, c in enumerate(kept)})


def inspect_headers(df: DataFrame, id_col: str, content_col: str = "content",
                    length_col: str | None = None) -> DataFrame:
    """``id, sample_rate, n_channels, bits, n_frames, seconds, error`` of WAV
    bytes in a column (:func:`vocaframe.sources.audio.read_headers` reads the
    headers of files without their audio).  ``length_col``: the length of the
    whole file if the column holds only its beginning."""
    ship_package(df.sparkSession)
    length = F.col(length_col) if length_col else F.length(content_col)
    slim = df.select(F.col(id_col).alias("id"), F.col(content_col).alias("head"), length.cast("bigint").alias("total"))

    def run(batches):
        import pyarrow as pa

        for rb in _slices(batches):
            rows = []
            for head, total in zip(rb.column(1), rb.column(2).to_pylist()):
                if head.is_valid:
                    buf = memoryview(head.as_buffer())
                    rows.append(header_row(lambda at, n: bytes(buf[at:at + n]), total or 0))
                else:
                    rows.append(dict.fromkeys(HEADER_FIELDS) | {"error": "no content"})
            header = pa.array(rows, header_type())
            yield pa.RecordBatch.from_arrays([rb.column(0), *header.flatten()], names=["id", *HEADER_FIELDS])

    fields = ", ".join(f"{k} {t}" for k, t in HEADER_FIELDS.items())
    return slim.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, {fields}").withColumnRenamed("id", id_col)


def lint(headers: DataFrame, min_rate: int = K.SAMPLE_RATE, max_seconds: float = 10.0) -> DataFrame:
    """Corpus advice as flags: sample rate below 16 kHz, clips over 10 s,
    unreadable headers.  Native expressions on the header table."""
    flags = F.array(
        F.when(F.col("error").isNotNull(), F.lit("unreadable")),
        F.when(F.col("sample_rate") < min_rate, F.lit("low_sample_rate")),
        F.when(F.col("seconds") > max_seconds, F.lit("too_long")),
    )
    return headers.withColumn("flags", F.filter(flags, lambda x: x.isNotNull()))


def preprocess_audio(df: DataFrame, id_col: str, content_col: str = "content",
                     target_rate: int = K.SAMPLE_RATE, keep: list[str] | None = None) -> DataFrame:
    """``id, sample_rate, n_samples, samples array<float>, error``: decoded,
    channel-averaged, resampled to 16 kHz; the columns of ``keep`` come along
    unchanged.  A bad file gives an ``error`` row instead of failing the job."""
    ship_package(df.sparkSession)
    kept = list(keep or ())
    slim = df.select(F.col(id_col).alias("id"), F.col(content_col).alias("content"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(kept)))

    def run(rb):
        import pyarrow as pa

        rows, last = [], None
        for content in rb.column(1).to_pylist():
            if not rows or content != last:  # a clip that comes once for each of its blocks is decoded once
                try:
                    row = preprocess(content, target_rate), None
                except (WavError, struct.error, ValueError, TypeError, MemoryError) as e:
                    row = None, str(e)
                last = content
            rows.append(row)
        parts, errs = zip(*rows) if rows else ((), ())
        valid, ns = [p is not None for p in parts], [None if p is None else len(p) for p in parts]
        return [pa.array(np.full(rb.num_rows, target_rate, np.int32)), pa.array(ns, pa.int64()), _float_lists(parts, valid), pa.array(list(errs), pa.string())]

    return _map(slim, run, "sample_rate int, n_samples bigint, samples array<float>, error string", id_col, kept)


def resample_blocks(df: DataFrame, id_col: str, target_rate: int = K.SAMPLE_RATE, beside: DataFrame | None = None) -> DataFrame:
    """Resample recordings that are spread over blocks, each block in its own
    task: ``id, block, start, total, sample_rate, samples`` -> the same columns
    at ``target_rate``, ``start`` and ``total`` counted in output frames.

    ``block`` numbers a recording's blocks one after the other, ``start`` is a
    block's first frame, ``total`` the frames of the recording, ``samples`` one
    channel.  An output frame needs some input frames on either side: each
    block sends its edges to the places of its neighbours, and a window over
    (id, block) hands them to the blocks, which are never put together.  Rows
    that are dealt by the id already stay where they are; others are shuffled
    once.  The samples equal those of :func:`preprocess_audio` on the whole file.

    ``beside``: rows that are joined to the blocks of their id (inner), for
    steps that need both; their other columns come along unchanged.  They meet
    before the samples go through Python, where Spark loses sight of how rows
    are dealt, so that rows dealt by the id are not shuffled for it.

    A block that is no longer than the filter's reach (some dozen frames) and
    is not the last, or a missing neighbour, fails the job: its neighbours
    could not be made.  Null samples give null samples; other columns are
    dropped."""
    ship_package(df.sparkSession)
    slim = df.select(F.col(id_col).alias("id"), F.col("block").cast("bigint").alias("block"), F.col("start").cast("bigint").alias("start"),
                     F.col("total").cast("bigint").alias("total"), F.col("sample_rate").cast("int").alias("rate"), F.col("samples").cast("array<float>").alias("x"))
    # one frame more than reach_of(), so that rounding cannot matter
    reach = (F.floor(F.lit(float(ZEROS)) / (F.lit(ROLLOFF) * F.least(F.lit(1.0), F.lit(float(target_rate)) / F.col("rate")))) + 2).cast("int")
    tail = F.slice("x", F.greatest(F.array_size("x") - reach + 1, F.lit(1)), reach)
    to = F.col("to")  # 0: the block itself; 1 and -1: an edge for the block after or before it
    sent = slim.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(-1))).alias("to")).where((to == 0) | (F.array_size("x") > 0)).select(
        "id", (F.col("block") + to).alias("block"), "start", "total", "rate", F.when(to == 0, F.col("x")).alias("x"),
        F.when(to == 1, tail).alias("tail"), F.when(to == -1, F.slice("x", F.lit(1), reach)).alias("head"), "to")
    place = Window.partitionBy("id", "block")
    known = F.col("id").isNotNull() & F.col("block").isNotNull()  # nulls are nobody's neighbours
    met = sent.select("id", "block", "start", "total", "rate", "x", F.when(known, F.max("tail").over(place)).alias("before"),
                      F.when(known, F.max("head").over(place)).alias("after"), "to").where(to == 0).drop("to")
    kept = [c for c in beside.columns if c != id_col] if beside is not None else []
    if beside is not None:
        # merged: arrays count as a few bytes in the plan's estimate, so that
        # rows of any size would be broadcast through the driver
        near = beside.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(kept)))
        met = met.join(near.hint("merge"), "id")

    def run(rb):
        import pyarrow as pa

        def floats(column):
            off = _offsets(column)
            vals = column.flatten().to_numpy(zero_copy_only=False)
            ok = column.is_valid().to_numpy(zero_copy_only=False)
            return [vals[off[i]:off[i + 1]] if ok[i] else None for i in range(len(column))]

        nothing = np.zeros(0, np.float32)
        starts, totals, rates = (rb.column(c).to_pylist() for c in (2, 3, 4))
        parts, firsts, ends = [], [], []
        for x, before, after, start, total, rate in zip(*(floats(rb.column(c)) for c in (5, 6, 7)), starts, totals, rates):
            if x is None or not rate:
                parts.append(None), firsts.append(None), ends.append(None)
                continue
            left, right = (nothing if h is None else h for h in (before, after))
            need = 0 if rate == target_rate else reach_of(rate, target_rate)
            if len(left) < min(need, start) or len(right) < min(need, total - start - len(x)):
                raise ValueError(f"block at frame {start}: a neighbour is missing or shorter than {need} frames")
            first, y = resample_part(x, start, left, right, rate, target_rate)
            parts.append(y), firsts.append(first), ends.append(-(-total * target_rate // rate))
        valid = [p is not None for p in parts]
        return [rb.column(1), pa.array(firsts, pa.int64()), pa.array(ends, pa.int64()), pa.array(np.full(rb.num_rows, target_rate, np.int32)), _float_lists(parts, valid)]

    return _map(met, run, "block bigint, start bigint, total bigint, sample_rate int, samples array<float>", id_col, kept)


def encode_wav(df: DataFrame, id_col: str, channels_col: str = "channels", rate_col: str = "sample_rate",
               bits_col: str = "bits", keep: list[str] | None = None) -> DataFrame:
    """``id, content`` WAV bytes from integer channels at 16-bit scale
    (``array<array<int>>``), per-row rate and width; the columns of ``keep``
    come along unchanged.  The WAV sink: write the result as Parquet, or hand
    it to :func:`vocaframe.sources.audio.write_wav_files`."""
    ship_package(df.sparkSession)
    kept = list(keep or ())
    slim = df.select(F.col(id_col).alias("id"), F.col(channels_col).alias("ch"), F.col(rate_col).alias("rate"), F.col(bits_col).alias("bits"),
                     *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(kept)))

    def run(rb):
        import pyarrow as pa

        chans = rb.column(1).flatten()  # list<list<int>>: rows -> channels -> samples
        row_off, ch_off = _offsets(rb.column(1)), _offsets(chans)
        values = chans.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        out = []
        for i, (rate, bits) in enumerate(zip(rb.column(2).to_pylist(), rb.column(3).to_pylist())):
            c0, c1 = row_off[i], row_off[i + 1]
            if c1 == c0:
                arr = np.zeros((1, 0), np.int64)
            else:
                arr = np.stack([values[ch_off[c]:ch_off[c + 1]] for c in range(c0, c1)])
            out.append(encode_pcm(arr, int(rate), int(bits)))
        return [pa.array(out, pa.binary())]

    return _map(slim, run, "content binary", id_col, kept)


def waveform_to_wav(df: DataFrame, id_col: str, samples_col: str = "samples",
                    rate_col: str = "sample_rate") -> DataFrame:
    """``id, content``: 16-bit PCM WAV bytes of a mono float waveform
    (``array<float>`` in [-1, 1], clipped), as the synthesis route returns
    for every requested format."""
    ship_package(df.sparkSession)
    slim = df.select(F.col(id_col).alias("id"), F.col(samples_col).alias("x"), F.col(rate_col).alias("rate"))

    def run(batches):
        import pyarrow as pa

        for rb in _slices(batches):
            xs = rb.column(1)
            off = _offsets(xs)
            vals = xs.flatten().to_numpy(zero_copy_only=False)
            out = []
            for i, rate in enumerate(rb.column(2).to_pylist()):
                if xs[i].is_valid and rate:
                    out.append(encode_float(vals[off[i]:off[i + 1]], int(rate)))
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(out, pa.binary())], names=["id", "content"])

    schema = "id {t}, content binary".format(t=dict(df.dtypes)[id_col])
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)
