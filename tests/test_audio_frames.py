"""Recordings in blocks: byte-range reading and block-wise resampling."""

import contextlib
import io
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocaframe.operators import audio as A
from vocaframe.sources.audio_frames import FramesReader, read_audio_frames


def tone(rate, frames, channels=2):
    t = np.arange(frames)
    return np.stack([(8000 * np.sin(t * (0.05 + 0.01 * c)) + (t * 7919) % 501 - 250).astype(int) for c in range(channels)])


@pytest.fixture()
def folder(tmpdir_path):
    files = {"long": (44100, 5000, 2, 16), "sub/b.c": (8000, 700, 1, 24), "_x": (22050, 129, 2, 8), "empty": (16000, 0, 1, 16), "日本": (16000, 128, 1, 32)}
    for name, (rate, frames, channels, bits) in files.items():
        path = os.path.join(tmpdir_path, name + ".wav")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(A.encode_pcm(tone(rate, frames, channels), rate, bits))
    for name, content in {"bad.wav": b"RIFF no audio", "other.txt": b"x"}.items():
        with open(os.path.join(tmpdir_path, name), "wb") as f:
            f.write(content)
    return tmpdir_path, files


@pytest.mark.parametrize("split", [1, 100, 1000, 1 << 20])
def test_blocks_of_any_byte_ranges_are_the_whole_file(spark, folder, split):
    path, files = folder
    rows = read_audio_frames(spark, path, block_frames=128, split_bytes=max(split, 60)).collect()
    for name, (rate, frames, channels, _) in files.items():
        own = sorted((r for r in rows if r.file_id == name), key=lambda r: r.block)
        with open(os.path.join(path, name + ".wav"), "rb") as f:
            whole = A.mono(A.decode(f.read())[1])
        assert [r.start for r in own] == [128 * i for i in range(max(1, math.ceil(frames / 128)))]
        assert np.array_equal(np.concatenate([np.array(r.samples, np.float32) for r in own]), whole)
        assert {(r.total, r.sample_rate, r.n_channels, r.error) for r in own} == {(frames, rate, channels, None)}
    bad = [r for r in rows if r.file_id == "bad"]
    assert len(bad) == 1 and bad[0].error and bad[0].samples is None
    assert {r.file_id for r in rows} == {*files, "bad"}


def test_conditions_on_the_id_reach_the_source(spark, folder):
    path, _ = folder
    df = read_audio_frames(spark, path, block_frames=64).where(F.col("file_id").isin("long", "none", "x" * 400) & (F.col("block") > 2))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    assert "PushedFilters" in out.getvalue() and "In" in out.getvalue().split("PushedFilters")[1].split("\n")[0]
    assert {r.file_id for r in df.collect()} == {"long"} and df.count() == math.ceil(5000 / 64) - 3
    reader = FramesReader({"path": path})
    reader.ids = {"long"}
    assert [f[0] for p in reader.partitions() for f in p.files] == ["long"]


@pytest.mark.parametrize("block", [64, 128, 1000, 5000])
def test_blocks_resample_as_the_whole_does(spark, folder, block):
    path, files = folder
    frames = read_audio_frames(spark, path, block_frames=block, split_bytes=500).where("error IS NULL")
    rows = A.resample_blocks(frames, "file_id").collect()
    for name, (rate, n, _, _) in files.items():
        own = sorted((r for r in rows if r.file_id == name), key=lambda r: r.block)
        with open(os.path.join(path, name + ".wav"), "rb") as f:
            whole = A.preprocess(f.read())
        assert np.array_equal(np.concatenate([np.array(r.samples, np.float32) for r in own]), whole)
        assert {r.total for r in own} == {len(whole)} and own[-1].start + len(own[-1].samples) == len(whole)


def test_a_missing_neighbour_fails(spark, folder):
    path, _ = folder
    frames = read_audio_frames(spark, path, block_frames=128).where("file_id = 'long' AND block != 3")
    with pytest.raises(Exception, match="neighbour"):
        A.resample_blocks(frames, "file_id").collect()


def test_null_samples_and_nothing(spark):
    schema = "id string, block long, start long, total long, sample_rate int, samples array<float>"
    df = spark.createDataFrame([("a", 0, 0, 0, 8000, None), ("b", 0, 0, 0, 8000, []), ("c", 0, 0, 1, 8000, [0.5])], schema)
    got = {r.id: r.samples for r in A.resample_blocks(df, "id").collect()}
    assert got["a"] is None and got["b"] == [] and len(got["c"]) == 2
    assert A.resample_blocks(df.where("false"), "id").collect() == []


def test_many_small_files_are_few_tasks(tmpdir_path):
    names = [f"{n % 3}/f{n:05d}" for n in range(3000)]
    for sub in "012":
        os.makedirs(os.path.join(tmpdir_path, sub))
    for n, name in enumerate(names):
        with open(os.path.join(tmpdir_path, name + ".wav"), "wb") as f:
            f.write(A.encode_pcm(tone(16000, 30 + n % 40), 16000, 16))
    reader = FramesReader({"path": tmpdir_path, "block_frames": "16", "split_bytes": "100"})
    tasks = reader.partitions()
    ranges = [r for t in tasks for r in t.files]
    assert len(tasks) <= 300 < 6000 <= len(ranges) and all(0 < end - begin <= 100 for _, begin, end in ranges)
    assert sorted({r[0] for r in ranges}) == sorted(names)
    rows = [r for t in tasks[:10] for r in reader.read(t)]
    whole = [n for n in {r[0] for r in rows} if n not in {r[0] for t in tasks[9:11] for r in t.files}]
    assert whole and all(sum(len(r[6]) for r in rows if r[0] == n) == 30 + names.index(n) % 40 for n in whole)


def test_clips_are_joined_without_a_broadcast(spark, tmpdir_path):
    from conftest import plan_text
    from vocaframe.plans.queries import QUERIES

    spark.range(50).withColumnRenamed("id", "event_id").write.parquet(os.path.join(tmpdir_path, "events.parquet"))
    made = QUERIES["audio_resample_blocks"](spark, tmpdir_path)
    assert "Broadcast" not in plan_text(made)
    assert all(r.n_equal == r.n_whole == r.n_samples for r in made.collect())


def test_no_sample_is_shuffled(spark, tmpdir_path):
    from conftest import plan_text
    from vocaframe.plans.queries import QUERIES

    spark.range(50).withColumnRenamed("id", "event_id").write.parquet(os.path.join(tmpdir_path, "events.parquet"))
    lines = plan_text(QUERIES["audio_resample_blocks"](spark, tmpdir_path)).splitlines()
    moved = [(line, lines[i + 1]) for i, line in enumerate(lines) if "Exchange" in line]
    assert "hashpartitioning(utt_id" in moved[0][0] and "partial_count" in moved[0][1]  # the sums of each id
    assert moved[1:] and all("REPARTITION_BY_NUM" in line and any(x in below for x in ("Filter", "FileScan")) for line, below in moved[1:])


def test_blocks_dealt_by_id_stay_where_they_are(spark, folder):
    from conftest import plan_text

    path, _ = folder
    frames = read_audio_frames(spark, path, block_frames=128).where("error IS NULL")
    dealt, other = frames.repartition(3, "file_id"), frames.select("file_id", F.lit(1).alias("n")).distinct().repartition(3, "file_id")
    for made in (A.resample_blocks(dealt, "file_id"), A.resample_blocks(dealt, "file_id", beside=other)):
        below = plan_text(made).split("MapInArrow", 1)[1].split("REPARTITION_BY_NUM")[0]
        assert "Window" in below and "ENSURE_REQUIREMENTS" not in below and "Broadcast" not in below
    made, loose = A.resample_blocks(dealt, "file_id"), A.resample_blocks(frames, "file_id")
    assert sorted(map(str, made.collect())) == sorted(map(str, loose.collect()))


def test_rows_beside_the_blocks_are_joined_by_id(spark):
    ramp = [float(i) / 512 for i in range(300)]
    blocks = [("a", 0, 0, 300, 8000, ramp[:128]), ("a", 1, 128, 300, 8000, ramp[128:256]), ("a", 2, 256, 300, 8000, ramp[256:]),
              ("twice", 0, 0, 128, 44100, ramp[:128]), ("twice", 0, 0, 128, 44100, ramp[:128]), ("alone", 0, 0, 3, 8000, ramp[:3]), (None, 0, 0, 3, 16000, ramp[:3])]
    df = spark.createDataFrame(blocks, "id string, block long, start long, total long, sample_rate int, samples array<float>")
    beside = spark.createDataFrame([("a", [[1]], 5), ("twice", None, None), ("twice", [[2], []], 7), ("none", [], 8), (None, [], 9)], "id string, x array<array<int>>, sample int")
    got = A.resample_blocks(df, "id", beside=beside)
    assert got.columns == ["id", "block", "start", "total", "sample_rate", "samples", "x", "sample"]
    assert sorted(map(str, got.collect())) == sorted(map(str, A.resample_blocks(df, "id").join(beside, "id").collect()))
    assert {r.id for r in got.collect()} == {"a", "twice"} and got.count() == 3 + 2 * 2


def test_nulls_are_nobodys_neighbours(spark):
    rows = [(None, b, 128 * b, 256, 8000, [0.5] * 128) for b in (0, 1)]
    df = spark.createDataFrame(rows, "id string, block long, start long, total long, sample_rate int, samples array<float>")
    with pytest.raises(Exception, match="neighbour"):
        A.resample_blocks(df, "id").collect()
    assert A.resample_blocks(df.withColumn("sample_rate", F.lit(16000)), "id").count() == 2


def test_columns_that_are_kept_come_along(spark):
    rows = [(i, [tone(8000, 40 + i % 3, 1)[0].tolist()], 8000, 16, [[i], None], f"n{i}" if i % 5 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "utt long, channels array<array<int>>, sample_rate int, bits int, deep array<array<int>>, name string")
    wav = A.encode_wav(df, "utt", keep=["deep", "name"])
    assert wav.columns == ["utt", "content", "deep", "name"]
    # the same bytes in a row, a bad one and null between them
    wav = wav.coalesce(1).withColumn("content", F.expr("CASE WHEN utt % 50 IN (7, 8) THEN X'00' WHEN utt % 50 IN (9, 10) THEN NULL ELSE content END"))
    pre = A.preprocess_audio(wav.unionByName(wav).coalesce(1).sortWithinPartitions("utt"), "utt", keep=["name", "deep"])
    assert pre.columns == ["utt", "sample_rate", "n_samples", "samples", "error", "name", "deep"]
    content = {r.utt: r.content for r in wav.collect()}
    found = pre.collect()
    assert sorted(r.utt for r in found) == sorted([*range(150)] * 2)
    for r in found:
        assert (r.deep, r.name) == rows[r.utt][4:]
        if r.utt % 50 in (7, 8, 9, 10):
            assert r.samples is None and r.n_samples is None and r.error
        else:
            assert r.error is None and r.samples == A.preprocess(bytes(content[r.utt])).tolist() and r.n_samples == len(r.samples)
