import io
import math
import os
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vocaframe.operators import audio as A
from vocaframe.sources.audio import read_audio, write_wav_files


def make_wav(samples: np.ndarray, rate: int, width: int) -> bytes:
    """``samples``: float (channels, frames) in [-1, 1), written with stdlib wave."""
    ch = samples.shape[0]
    inter = samples.T.reshape(-1)
    if width == 1:
        data = np.clip(np.round(inter * 128 + 128), 0, 255).astype(np.uint8).tobytes()
    elif width == 2:
        data = np.clip(np.round(inter * 32768), -32768, 32767).astype("<i2").tobytes()
    elif width == 3:
        v = np.clip(np.round(inter * (1 << 23)), -(1 << 23), (1 << 23) - 1).astype(np.int64) & 0xFFFFFF
        data = np.stack([v & 0xFF, (v >> 8) & 0xFF, (v >> 16) & 0xFF], 1).astype(np.uint8).tobytes()
    else:
        data = np.clip(np.round(inter * (1 << 31)), -(1 << 31), (1 << 31) - 1).astype("<i4").tobytes()
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(ch)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(data)
    return buf.getvalue()


def tone(freq, rate, seconds, ch=1, dc=0.0):
    t = np.arange(int(rate * seconds)) / rate
    x = 0.5 * np.sin(2 * math.pi * freq * t) + dc
    return np.stack([x] * ch)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
@pytest.mark.parametrize("ch", [1, 2])
def test_decode_widths(width, ch):
    x = tone(440, 16000, 0.05, ch)
    rate, y = A.decode(make_wav(x, 16000, width))
    assert rate == 16000 and y.shape == x.shape
    assert np.max(np.abs(y - x)) < (2.0 / 2 ** (8 * width - 1) + 1e-6)


@pytest.mark.parametrize("rate", [8000, 22050, 44100])
def test_resample_keeps_tone_and_length(rate):
    x = tone(440, rate, 1.0, 2, dc=0.1)
    y = A.preprocess(make_wav(x, rate, 2))
    assert len(y) == math.ceil(x.shape[1] * 16000 / rate)
    spec = np.abs(np.fft.rfft(y - y.mean()))
    peak = np.argmax(spec) * 16000 / len(y)
    assert abs(peak - 440) < 2
    assert abs(y[2000:-2000].mean() - 0.1) < 0.01
    assert 0.45 < np.max(np.abs(y[2000:-2000] - 0.1)) < 0.55


def test_same_rate_is_channel_mean():
    x = np.stack([tone(300, 16000, 0.1)[0], tone(500, 16000, 0.1)[0]])
    y = A.preprocess(make_wav(x, 16000, 2))
    rate, d = A.decode(make_wav(x, 16000, 2))
    assert np.allclose(y, d.mean(axis=0), atol=1e-7)


def test_header_chunks_and_errors():
    w = make_wav(tone(100, 8000, 0.01), 8000, 2)
    # insert a LIST chunk before data
    fmt_end = 12 + 8 + 16
    lst = b"LIST" + (4).to_bytes(4, "little") + b"INFO"
    body = w[:fmt_end] + lst + w[fmt_end:]
    body = body[:4] + (len(body) - 8).to_bytes(4, "little") + body[8:]
    h = A.parse_header(body, len(body))
    assert h["n_frames"] == 80 and h["sample_rate"] == 8000
    with pytest.raises(A.WavError):
        A.parse_header(b"RIFF\x00\x00\x00\x00WAVEfmt ")
    with pytest.raises(A.WavError):
        A.parse_header(b"not a wav at all")


def test_dataframe_pipeline_from_files(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "wavs")
    os.makedirs(d)
    specs = {"a": (16000, 2, 1), "b": (8000, 1, 2), "c": (44100, 3, 2), "d": (22050, 4, 1)}
    for name, (rate, width, ch) in specs.items():
        with open(os.path.join(d, name + ".wav"), "wb") as f:
            f.write(make_wav(tone(440, rate, 0.2, ch), rate, width))
    with open(os.path.join(d, "bad.wav"), "wb") as f:
        f.write(b"RIFF\x10\x00\x00\x00WAVE")
    files = read_audio(spark, d).withColumn("file_id", F.regexp_extract("path", "([^/]+)\\.wav$", 1))
    heads = {r.file_id: r for r in A.lint(A.inspect_headers(files, "file_id", length_col="length")).collect()}
    assert heads["b"].sample_rate == 8000 and list(heads["b"].flags) == ["low_sample_rate"]
    assert heads["c"].n_channels == 2 and heads["c"].bits == 24 and list(heads["c"].flags) == []
    assert heads["a"].n_frames == 3200 and heads["a"].seconds == pytest.approx(0.2)
    assert list(heads["bad"].flags) == ["unreadable"]
    pre = {r.file_id: r for r in A.preprocess_audio(files, "file_id").collect()}
    for name in specs:
        assert pre[name].sample_rate == 16000 and pre[name].n_samples == 3200
        assert pre[name].error is None
    assert pre["bad"].samples is None and pre["bad"].error


def test_encode_and_write_files(spark, tmpdir_path):
    df = spark.createDataFrame([(1, 16000, 16, [[0, 100, -100], [0, 50, -50]])],
                               "id long, sample_rate int, bits int, channels array<array<int>>")
    wav = A.encode_wav(df, "id")
    out = os.path.join(tmpdir_path, "out")
    paths = write_wav_files(wav, out, "id").collect()
    with wave.open(paths[0].path) as w:
        assert w.getnchannels() == 2 and w.getframerate() == 16000 and w.getnframes() == 3


def test_zero_frames():
    w = make_wav(np.zeros((2, 0)), 16000, 2)
    assert A.parse_header(w, len(w))["n_frames"] == 0
    assert len(A.preprocess(w)) == 0
    w8 = make_wav(np.zeros((1, 0)), 8000, 2)
    assert len(A.preprocess(w8)) == 0


def test_header_lint_of_files(spark, tmpdir_path):
    from vocaframe.sources.audio import list_audio, read_headers

    d = os.path.join(tmpdir_path, "long")
    os.makedirs(d)
    with open(os.path.join(d, "long.wav"), "wb") as f:
        f.write(make_wav(tone(220, 8000, 12.0), 8000, 2))  # 12 s: too long, low rate
    r = A.lint(read_headers(list_audio(spark, d))).first()
    assert r.n_frames == 96000 and r.seconds == pytest.approx(12.0)
    assert list(r.flags) == ["low_sample_rate", "too_long"]


def _steps(spark, monkeypatch):
    """The Arrow functions of the audio steps, by name, and their input types."""
    caught = {}

    def catch(self, run, schema):
        caught["run"] = run
        return self.select("id").withColumn("content", F.lit(b"")).withColumn("samples", F.lit(None).cast("array<float>"))

    df = spark.createDataFrame([], "id long, content binary, channels array<array<int>>, sample_rate int, bits int, samples array<float>")
    monkeypatch.setattr(type(df), "mapInArrow", catch)
    out = {}
    for name, step in {"encode": A.encode_wav, "preprocess": A.preprocess_audio, "to_wav": A.waveform_to_wav, "headers": A.inspect_headers}.items():
        step(df, "id")
        out[name] = caught["run"]
    return out


def test_large_batches_are_taken_in_small_parts(spark, monkeypatch):
    steps = _steps(spark, monkeypatch)
    n = 301
    ids = pa.array(range(n), pa.int64())
    chans = [None if i % 50 == 7 else [] if i % 50 == 8 else [[(i * 31 + j) % 2000 - 1000 for j in range(1 + i % 9)]] * (1 + i % 3) for i in range(n)]
    batch = pa.RecordBatch.from_arrays([ids, pa.array(chans, pa.list_(pa.list_(pa.int32()))), pa.array([16000] * n, pa.int32()), pa.array([16] * n, pa.int32())], names=["id", "ch", "rate", "bits"])
    wavs = list(steps["encode"](iter([batch.slice(0, 3), batch.slice(3)])))
    content = [c for b in wavs for c in b.column(1).to_pylist()]
    assert content == [A.encode_pcm(np.array(c, np.int64) if c else np.zeros((1, 0), np.int64), 16000) for c in chans]
    whole = pa.RecordBatch.from_arrays([ids, pa.array([None if i == 100 else c for i, c in enumerate(content)], pa.binary())], names=["id", "content"])
    made = list(steps["preprocess"](iter([whole])))
    samples = [x for b in made for x in b.column(3).to_pylist()]
    assert samples == [None if i == 100 else A.preprocess(c).tolist() for i, c in enumerate(content)]
    floats = pa.RecordBatch.from_arrays([ids, pa.array(samples, pa.list_(pa.float32())), pa.array([16000] * n, pa.int32())], names=["id", "x", "rate"])
    back = list(steps["to_wav"](iter([floats])))
    assert [c for b in back for c in b.column(1).to_pylist()] == [None if x is None else A.encode_float(np.array(x, np.float32), 16000) for x in samples]
    heads = list(steps["headers"](iter([pa.RecordBatch.from_arrays([ids, whole.column(1), pa.array([len(c) for c in content], pa.int64())], names=["id", "head", "total"])])))
    for got in (wavs, made, back, heads):
        assert [i for b in got for i in b.column(0).to_pylist()] == list(range(n))
        assert max(b.num_rows for b in got) <= 64
