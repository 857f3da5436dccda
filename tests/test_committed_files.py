"""Files that appear at the commit of their job."""

import os

import pytest
from pyspark.sql import functions as F

from vocaframe.operators import audio as A
from vocaframe.session import ship_package
from vocaframe.sources.audio import with_existence, write_wav_files
from vocaframe.sources.committed import CommittedFiles, Staging, inner_name


def files_below(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def wavs(spark, ids):
    df = spark.createDataFrame([(i, 16000, 16, [[1, 2, 3]]) for i in ids], "id string, rate int, bits int, ch array<array<int>>")
    return A.encode_wav(df, "id", "ch", "rate", "bits")


def test_written_under_their_ids(spark, tmpdir_path):
    ids = ["a", "sub/b", ".c", "_d", "日本", "with space"]
    paths = write_wav_files(wavs(spark, ids).repartition(4), tmpdir_path, "id").collect()
    assert sorted(r.id for r in paths) == sorted(ids) and all(os.path.isfile(r.path) for r in paths)
    assert files_below(tmpdir_path) == sorted(i + ".wav" for i in ids)


def test_a_failed_job_leaves_no_file(spark, tmpdir_path):
    ship_package(spark)
    spark.dataSource.register(CommittedFiles)
    rows = spark.range(0, 200, 1, 4).select(
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"),
        F.when(F.col("id") == 190, F.raise_error(F.lit("half way"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    folder = os.path.join(tmpdir_path, "out")
    os.makedirs(folder)
    with open(os.path.join(folder, "f1"), "w") as f:
        f.write("old")
    with pytest.raises(Exception):
        rows.write.format("committed_files").mode("append").save(folder)
    assert files_below(folder) == ["f1"]
    with open(os.path.join(folder, "f1")) as f:
        assert f.read() == "old"
    rows.where("id < 190").write.format("committed_files").mode("append").save(folder)
    assert len(files_below(folder)) == 190  # a file of the same name is replaced


@pytest.mark.parametrize("bad", ["../out", "/etc/x", "", ".", "a/../../b", "a\0b"])
def test_names_stay_inside_the_folder(spark, tmpdir_path, bad):
    with pytest.raises(ValueError):
        inner_name(bad)
    assert inner_name("a/./b") == "a/b" and inner_name("a/../b") == "b"


def test_null_content_and_overwrite_are_errors(spark, tmpdir_path):
    ship_package(spark)
    spark.dataSource.register(CommittedFiles)
    with pytest.raises(Exception):
        spark.createDataFrame([("a", None)], "name string, content binary").write.format("committed_files").mode("append").save(tmpdir_path)
    with pytest.raises(Exception):
        spark.createDataFrame([("a", b"x")], "name string, content binary").write.format("committed_files").mode("overwrite").save(tmpdir_path)
    assert files_below(tmpdir_path) == []


def test_ids_that_no_file_can_have(spark, tmpdir_path):
    write_wav_files(wavs(spark, ["good"]), tmpdir_path, "id")
    ids = ["x" * 300, "a\0b", "good", None, "y" * 5000, "none", "good"]
    df = spark.createDataFrame([(n, i) for n, i in enumerate(ids)], "n int, file_id string").coalesce(1)
    assert [r.has_audio for r in with_existence(df, tmpdir_path).orderBy("n").collect()] == [False, False, True, False, False, False, True]


def test_a_task_that_goes_on_after_the_abort_writes_nothing(tmpdir_path):
    staging = Staging(os.path.join(tmpdir_path, "out"))
    early, late, made = staging.attempt(), staging.attempt(), set()
    staging.put(early, "a/b/c", b"x", made)
    staging.put(early, "a/b/d", b"x", made)
    staging.put(early, "a/e", b"x")
    staging.abort()
    for attempt, known in ((early, made), (early, None), (late, set())):
        with pytest.raises(OSError):
            staging.put(attempt, "a/b/f", b"x", known)
    assert files_below(tmpdir_path) == [] and os.listdir(os.path.join(tmpdir_path, "out")) == []
