"""Inputs nobody controls: odd files, odd headers, odd rows, repeated ids."""

import json
import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocaframe.functions.tokens import extract_speech_ids
from vocaframe.jobs import build_corpus_job, training_table_job
from vocaframe.operators import audio as A
from vocaframe.operators import corpus as C
from vocaframe.operators.requests import parse_responses, validate_requests
from vocaframe.operators.similarity import score_references
from vocaframe.sources.audio import read_headers, with_existence, write_wav_files

IDS = ["a", "_b", ".c", "sub/d", "with space", "per%20cent", "missing", "x.y", "日本"]


@pytest.fixture()
def wavs(tmpdir_path):
    folder = os.path.join(tmpdir_path, "wavs")
    for name in IDS:
        if name != "missing":
            path = os.path.join(folder, name + ".wav")
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(A.encode_pcm(np.zeros((1, 10)), 16000))
    return folder


@pytest.mark.parametrize("form", ["{0}", "{0}/", "file:{0}", "file://{0}", "{0}/../wavs"])
def test_existence_is_tested_by_id(spark, wavs, form):
    ids = spark.createDataFrame([(i,) for i in [*IDS, None]], "file_id string")
    got = {r.file_id: r.has_audio for r in with_existence(ids, form.format(wavs)).collect()}
    assert got == {i: i not in ("missing", None) for i in [*IDS, None]}


def test_relative_audio_folder_and_first_seen_order(spark, wavs, tmpdir_path, monkeypatch):
    monkeypatch.chdir(os.path.dirname(wavs))
    with open("text.txt", "w", encoding="utf-8") as f:
        f.write("sub/d:one\n_b:two\n.c:three\nmissing:four\nnothing\n_b:last two\na:five\n")
    codes = spark.createDataFrame([("a", [1]), ("a", [1]), ("a", None), ("_b", [2]), (".c", [9]), (".c", [3]), ("sub/d", []), ("missing", [4])], "file_id string, code array<int>")
    out = os.path.join(tmpdir_path, "out")
    got = build_corpus_job(spark, "./wavs", os.path.abspath("text.txt"), out, codes)
    assert got == {"lines": 7, "valid_lines": 6, "texts": 5, "texts_without_audio": 1, "samples": 4}
    lines = [json.loads(x) for p in sorted(os.listdir(out)) if p.startswith("part") for x in open(os.path.join(out, p), encoding="utf-8")]
    assert lines == [{"text": "one", "code": []}, {"text": "last two", "code": [2]}, {"text": "three", "code": [3]}, {"text": "five", "code": [1]}]


def test_missing_audio_folder_raises(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError):
        with_existence(spark.createDataFrame([("a",)], "file_id string"), os.path.join(tmpdir_path, "nowhere"))


def test_one_row_per_id(spark):
    texts = spark.createDataFrame([("a", "x"), ("b", "y")], "file_id string, text string")
    audio = spark.createDataFrame([("a",), ("a",), ("b",)], "file_id string")
    codes = spark.createDataFrame([("a", [1]), ("a", [1]), ("a", [0, 5]), ("b", None)], "file_id string, code array<int>")
    assert [tuple(r) for r in C.build_corpus(texts, audio, codes).collect()] == [("a", "x", [0, 5])]
    lines = spark.createDataFrame([("a", "x", True), ("b", "y", True), (None, None, False)], "file_id string, text string, valid boolean")
    report = {r.metric: r.value for r in C.corpus_report(lines, audio).collect()}
    assert report == {"lines": 3, "valid_lines": 2, "texts": 2, "texts_without_audio": 0, "samples": 2}


def test_equal_samples_are_spread(spark, tmpdir_path):
    src, out = os.path.join(tmpdir_path, "c"), os.path.join(tmpdir_path, "t")
    os.makedirs(src)
    with open(os.path.join(src, "c.jsonl"), "w") as f:
        for i in range(30):
            f.write(json.dumps({"text": "same" if i % 3 == 0 else f"t{i}", "code": [1]}) + "\n")
    assert training_table_job(spark, src, out, seed=3) == 30
    order = [("same" in r.text) for r in spark.read.parquet(out).withColumn("i", F.monotonically_increasing_id()).orderBy("_metadata.file_path", "i").collect()]
    assert sum(order) == 10 and max(len(run) for run in "".join("xo"[o] for o in order).split("x")) < 6


def wav(chunks, rate=16000, channels=1, bits=16, align=None, tag=1, frames=b"\1\0\2\0"):
    align = channels * bits // 8 if align is None else align
    fmt = struct.pack("<HHIIHH", tag, channels, rate, (rate * align) & 0xFFFFFFFF, align, bits)
    body = b"WAVE"
    for name, data in [*chunks, (b"fmt ", fmt), (b"data", frames)]:
        body += name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("size", [5_000, 5_001, 1 << 20])
def test_chunks_of_any_size_before_the_audio(spark, tmpdir_path, size):
    raw = wav([(b"LIST", b"x" * size), (b"JUNK", b"y" * 3)])
    df = spark.createDataFrame([(1, bytearray(raw))], "id long, content binary")
    assert [tuple(r) for r in A.inspect_headers(df, "id").collect()] == [(1, 16000, 1, 16, 2, 2 / 16000, None)]
    files = write_wav_files(df, tmpdir_path, "id").collect()
    heads = read_headers(spark.createDataFrame([(r.path,) for r in files] + [(tmpdir_path + "/none.wav",), (None,)], "path string")).collect()
    assert (heads[0].n_frames, heads[0].error) == (2, None) and heads[1].error and heads[2].error


def test_headers_that_no_audio_can_have(spark):
    rows = {
        "rate 0": wav([], rate=0), "rate 2^31": wav([], rate=1 << 31), "rate max": wav([], rate=0xFFFFFFFF), "no channels": wav([], channels=0, align=2),
        "bits": wav([], bits=12), "align": wav([], align=3), "cut": wav([])[:30], "empty": b"", "text": b"hello world, this is no audio at all",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in rows.items()] + [("null", None), ("good", bytearray(wav([]))), ("align 0", bytearray(wav([], align=0)))], "id string, content binary")
    for out in (A.inspect_headers(df, "id"), A.preprocess_audio(df, "id")):
        got = {r.id: r for r in out.collect()}
        assert {k for k, r in got.items() if r.error is None} == {"good", "align 0"}
    assert {r.id: r.n_samples for r in A.preprocess_audio(df, "id").where("error is null").collect()} == {"good": 2, "align 0": 2}


def test_random_headers_never_end_a_job(spark):
    draw = random.Random(1)
    rows = []
    for i in range(400):
        raw = bytearray(wav([], rate=draw.choice([8000, 44100, 65537, 3_000_001]), channels=draw.choice([1, 2]), frames=b"\1\0" * draw.randint(0, 40)))
        for _ in range(draw.randint(0, 4)):
            raw[draw.randrange(len(raw))] = draw.randrange(256)
        rows.append((i, raw[:draw.choice([len(raw), draw.randrange(len(raw))])]))
    df = spark.createDataFrame(rows, "id long, content binary")
    assert A.preprocess_audio(df, "id").count() == 400 and A.inspect_headers(df, "id").count() == 400


def test_16_bit_samples_survive_a_round_trip():
    samples = np.array([[-32768, -32767, -20000, -1, 0, 1, 16384, 20000, 32766, 32767]])
    rate, wave = A.decode(A.encode_pcm(samples, 16000))
    assert A.decode(A.encode_float(wave, rate))[1].tolist() == wave.tolist()
    assert (np.rint(wave * 32768) == samples).all()


@pytest.mark.parametrize("orig,new", [(8000, 16000), (22050, 16000), (44100, 16000), (44101, 16000), (48000, 44100)])
def test_resampled_tone_length_and_level(orig, new):
    t = np.arange(orig) / orig
    out = A.resample(np.sin(2 * np.pi * 440 * t), orig, new)
    assert len(out) == new
    inner = slice(200, new - 200)
    assert np.abs(out - np.sin(2 * np.pi * 440 * np.arange(new) / new))[inner].max() < 5e-3
    level = A.resample(np.full((2, orig), 0.5), orig, new)
    assert level.shape == (2, new) and np.abs(level[:, inner] - 0.5).max() < 5e-3


def test_untrusted_rows(spark):
    df = spark.createDataFrame([("<|s_5|><|s_12345678901234567890|>",), ("<|s_7|>",)], "t string")
    assert [r[0] for r in df.select(extract_speech_ids("t")).collect()] == [[5, None], [7]]
    body = '{"choices":[{"text":"%s"}]}'
    rows = [(1, 200, body % "<|s_1|>"), (2, None, body % "<|s_1|>"), (3, 200, body % "<|s_99999999999999999999|>"), (4, 200, "no json"), (5, 404, None)]
    got = {r.id: (r.error, r.speech_ids) for r in parse_responses(spark.createDataFrame(rows, "id long, status int, body string")).collect()}
    assert got == {1: (None, [1]), 2: ("api_error", None), 3: ("bad_speech_id", None), 4: ("empty_response", None), 5: ("api_error", None)}


def test_request_values_that_are_no_numbers(spark):
    rows = [("テスト", "abc", "0.5", "12"), ("テスト", None, "1", "x"), ("テスト", "1.0", "9", None)]
    out = validate_requests(spark.createDataFrame(rows, "input string, speed string, top_p string, max_tokens string"))
    got = [(r.violations, r.is_valid) for r in out.collect()]
    assert got == [(["speed"], False), (["max_tokens"], False), (["top_p"], False)]


def test_no_target_no_rows(spark):
    refs = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert score_references(refs, refs.where("vec_id = 5")).count() == 0
    assert score_references(refs, refs).first().similarity == 1.0
