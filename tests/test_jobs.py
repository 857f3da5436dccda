"""End to end over real files: manifest + WAV folder -> corpus -> training table."""

import os

from vocaframe import constants as K
from vocaframe.jobs import build_corpus_job, training_table_job


def test_corpus_and_training_jobs(spark, tmpdir_path):
    audio = os.path.join(tmpdir_path, "wavs")
    os.makedirs(os.path.join(audio, "sub"))
    for name in ["a.wav", "b.wav", "sub/c.wav", "d.flac"]:
        with open(os.path.join(audio, name), "wb") as f:
            f.write(b"RIFF")
    manifest = os.path.join(tmpdir_path, "list.txt")
    with open(manifest, "w", encoding="utf-8") as f:
        f.write("a:こんにちは\nb:ありがとう！\nsub/c:元気？\nd:flac only\nx:no audio\nbad line\na:さようなら\n")
    codes = spark.createDataFrame([("a", [1, 2]), ("b", []), ("sub/c", [5]), ("d", [9])],
                                  "file_id string, code array<int>")
    out = os.path.join(tmpdir_path, "corpus.jsonl")
    report = build_corpus_job(spark, audio, manifest, out, codes)
    assert report == {"lines": 7, "valid_lines": 6, "texts": 5, "texts_without_audio": 2, "samples": 3}
    table = os.path.join(tmpdir_path, "train")
    assert training_table_job(spark, out, table, seed=1) == 3
    prompts = sorted(r.text for r in spark.read.parquet(table).collect())
    assert all(p.startswith(K.BOS_TOKEN) and p.endswith(K.SPEECH_END_TOKEN) for p in prompts)
    assert any("さようなら" in p and "<|s_1|><|s_2|>" in p for p in prompts)  # last text wins
    assert any("ありがとう!" in p for p in prompts)  # normalized
