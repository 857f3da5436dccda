"""Global row numbers, line numbers over files, exact shards."""

import os

from pyspark.sql import functions as F

from conftest import plan_text
from vocaframe.jobs import training_table_job
from vocaframe.operators.places import number_rows, with_place
from vocaframe.operators.shuffle import shuffle_places, shuffle_samples
from vocaframe.sources.corpus import write_corpus
from vocaframe.sources.manifest import read_lines


def test_places_are_a_numbering_in_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), (F.col("id") % 3).alias("place"))
    rows = with_place(df, F.desc("k")).collect()
    assert with_place(df, "k").columns == ["k", "place"]  # a column of that name is replaced
    assert sorted(r.place for r in rows) == list(range(5000))
    by_place = [r.k for r in sorted(rows, key=lambda r: r.place)]
    assert by_place == sorted(by_place, reverse=True)


def test_places_of_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None,), (1,), (1,), (1,), (None,)], "k int")
    rows = sorted(with_place(df, "k").collect(), key=lambda r: r.place)
    assert [(r.place, r.k) for r in rows] == [(0, None), (1, None), (2, 1), (3, 1), (4, 1)]
    assert with_place(df.where("false"), "k").collect() == []


def test_no_window_over_the_rows(spark):
    # the one window runs over a row a partition, below a broadcast
    plan = plan_text(with_place(spark.range(100).withColumnRenamed("id", "k"), "k"))
    assert "BroadcastHashJoin" in plan and plan.index("BroadcastExchange") < plan.index("Window")


def test_lines_are_numbered_over_files_and_splits(spark, tmpdir_path):
    lines = [f"line {i} {'x' * (i % 50)}" for i in range(3000)]
    for n, (a, b) in enumerate([(0, 10), (10, 2000), (2000, 2000), (2000, 3000)]):
        with open(os.path.join(tmpdir_path, f"f{n}.txt"), "w") as f:
            f.writelines(line + "\n" for line in lines[a:b])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = number_rows(read_lines(spark, tmpdir_path), "line_key")
        assert got.rdd.getNumPartitions() > 4
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in sorted(rows, key=lambda r: r.line_number)] == lines
    assert sorted(r.line_number for r in rows) == list(range(3000))


def test_shards_hold_the_permutation_in_order(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "k")
    places = {r.k: r.place for r in shuffle_places(df.repartition(5), 42, "k").collect()}
    assert places == {r.k: r.place for r in shuffle_places(df, 42, "k").collect()}
    order = sorted(places, key=places.get)
    assert order == [r.k for r in shuffle_samples(df, 42, "k").collect()]
    for shards in (1, 4, 10, 1003, 1500):
        parts = shuffle_samples(df, 42, "k", shards=shards).rdd.glom().collect()
        size = -(-1003 // shards)
        assert len(parts) == shards
        assert [r.k for p in parts for r in p] == order
        assert [len(p) for p in parts] == [max(0, min(size, 1003 - i * size)) for i in range(shards)]


def test_shard_files_of_the_job(spark, tmpdir_path):
    src, out = tmpdir_path + "/corpus", tmpdir_path + "/table"
    write_corpus(spark.createDataFrame([(f"t{i % 5}", [i]) for i in range(25)], "text string, code array<int>"), src)
    assert training_table_job(spark, src, out, seed=1, shards=4) == 25
    sizes = spark.read.parquet(out).groupBy(F.col("_metadata.file_name").alias("f")).count().orderBy("f").collect()
    assert [r["count"] for r in sizes] == [7, 7, 7, 4]
