import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from vocaframe.operators.corpus import audio_file_ids, build_corpus, corpus_report
from vocaframe.operators.manifest import last_text_per_id, parse_manifest
from vocaframe.sources.audio import list_audio, read_contents
from vocaframe.sources.corpus import read_corpus, write_corpus, write_training_table


def _touch(path, data=b"RIFF"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_inventory_listing_and_ids(spark, tmpdir_path):
    audio = os.path.join(tmpdir_path, "wavs")
    for name in ["a.wav", "b.wav", "sub/c.wav", "d.flac", "E.wav"]:
        _touch(os.path.join(audio, name), b"x" * 10)
    inv = list_audio(spark, audio, ".wav")
    assert "content" not in inv.columns
    ids = sorted(r.file_id for r in audio_file_ids(inv, audio, ".wav").collect())
    assert ids == ["E", "a", "b", "sub/c"]
    # the listing plan reads no file content
    plan = plan_text(inv)
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_build_corpus_semantics(spark):
    lines = ["a:text a", "b:text b", "c:text c", "a:text a2", "e:no audio"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_key long, line string")
    texts = last_text_per_id(parse_manifest(df)).select("file_id", "text")
    audio = spark.createDataFrame([("a", "/w/a.wav"), ("b", "/w/b.wav"), ("c", "/w/c.wav"), ("z", "/w/z.wav")],
                                  "file_id string, path string")
    codes = spark.createDataFrame([("a", [1, 2]), ("b", []), ("c", None), ("z", [9])],
                                  "file_id string, code array<int>")
    got = {r.file_id: (r.text, r.code) for r in build_corpus(texts, audio, codes).collect()}
    # e: no audio; c: codes missing; z: no transcript; b: empty list kept; a: last text
    assert got == {"a": ("text a2", [1, 2]), "b": ("text b", [])}


def test_report(spark):
    lines = spark.createDataFrame(list(enumerate(["a:x", "b:y", "bad", "a:z", "c:w", ""])),
                                  "line_key long, line string")
    flagged = parse_manifest(lines, keep_invalid=True)
    audio = spark.createDataFrame([("a", [1]), ("c", None)], "file_id string, code array<int>")
    rep = {r.metric: r.value for r in corpus_report(flagged, audio).collect()}
    assert rep == {"lines": 6, "valid_lines": 4, "texts": 3, "texts_without_audio": 1, "samples": 1}


def test_jsonl_roundtrip(spark, tmpdir_path):
    rows = [("こんにちは", [1, 2]), ("empty", []), ("none", None)]
    df = spark.createDataFrame(rows, "text string, code array<int>")
    out = os.path.join(tmpdir_path, "corpus")
    write_corpus(df, out)
    raw = []
    for name in sorted(os.listdir(out)):
        if name.endswith(".json"):
            with open(os.path.join(out, name), encoding="utf-8") as f:
                raw += [json.loads(line) for line in f if line.strip()]
    assert {r["text"]: r.get("code") for r in raw} == {t: c for t, c in rows}
    back = {r.text: r.code for r in read_corpus(spark, out).collect()}
    assert back == {t: c for t, c in rows}


def test_jsonl_reader_rules(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "c.jsonl")
    with open(p, "w", encoding="utf-8") as f:
        f.write('{"text": "a", "code": [1], "extra": 5}\n\n{"text": "b"}\n')
    got = sorted((r.text, r.code) for r in read_corpus(spark, p).collect())
    assert got == [("a", [1]), ("b", None)]
    with open(p, "w", encoding="utf-8") as f:
        f.write('{"code": [1]}\n')
    with pytest.raises(Exception):
        read_corpus(spark, p).collect()
    with open(p, "w", encoding="utf-8") as f:
        f.write('{"text": "a", "code": [1]}\n{not json\n')
    with pytest.raises(Exception):
        read_corpus(spark, p).collect()


def test_training_table(spark, tmpdir_path):
    df = spark.createDataFrame([("p1",), ("p2",)], "prompt string")
    out = os.path.join(tmpdir_path, "train")
    write_training_table(df, out, "prompt")
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["p1", "p2"]


def test_read_contents_of_matched_files(spark, tmpdir_path):
    audio = os.path.join(tmpdir_path, "w")
    _touch(os.path.join(audio, "a.wav"), b"AAA")
    _touch(os.path.join(audio, "b.wav"), b"BB")
    inv = list_audio(spark, audio)
    ids = audio_file_ids(inv, audio).where(F.col("file_id") == "b")
    got = read_contents(ids).collect()
    assert [(r.file_id, bytes(r.content)) for r in got] == [("b", b"BB")]


def test_write_counts_observed(spark, tmpdir_path):
    df = spark.createDataFrame([("a", [1, 2]), ("b", []), ("c", None)], "text string, code array<int>")
    counts = write_corpus(df, os.path.join(tmpdir_path, "c"))
    assert counts == {"samples": 3, "empty_codes": 1, "codes": 2}


def test_codes_with_inventory_one_join(spark):
    texts = spark.createDataFrame([("a", "ta"), ("b", "tb"), ("c", "tc")], "file_id string, text string")
    audio = spark.createDataFrame([("a", "/w/a.wav", [1]), ("b", "/w/b.wav", None)],
                                  "file_id string, path string, code array<int>")
    got = build_corpus(texts, audio)
    assert [(r.file_id, r.code) for r in got.collect()] == [("a", [1])]
    plan = plan_text(got)
    assert "LeftSemi" not in plan


def test_invalid_utf8_flagged(spark, tmpdir_path):
    from vocaframe.sources.manifest import read_lines

    p = os.path.join(tmpdir_path, "m.txt")
    with open(p, "wb") as f:
        f.write(b"a:ok\nb:\xff\xfe bad\n")
    got = {r.line.split(":")[0]: r.utf8_ok for r in read_lines(spark, p).collect()}
    assert got == {"a": True, "b": False}
