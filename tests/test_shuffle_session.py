from pyspark.sql import functions as F

from vocaframe.operators.shuffle import shuffle_samples
from vocaframe.session import fresh_dir, shared_dir


def test_shuffle_keeps_multiset_and_ignores_partitioning(spark):
    df = spark.range(0, 2000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    a = [r.k for r in shuffle_samples(df.repartition(3), 42, "k").collect()]
    b = [r.k for r in shuffle_samples(df.repartition(11), 42, "k").collect()]
    c = [r.k for r in shuffle_samples(df, 7, "k").collect()]
    assert sorted(a) == list(range(2000))
    assert a == b  # same seed, other partitioning: same order
    assert a != c and a != sorted(a)
    sharded = shuffle_samples(df, 42, "k", shards=4)
    assert sharded.rdd.getNumPartitions() == 4
    assert sorted(r.k for r in sharded.collect()) == list(range(2000))


def test_shared_dir_comes_from_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark, "x").startswith(root.rstrip("/"))
    assert fresh_dir(spark, "y") != fresh_dir(spark, "y")

