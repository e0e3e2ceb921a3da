"""The skew-safe keyed prefix count against a plain window."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators.scan import earlier_count


def _data(spark, n, hot_share, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = 0 if rnd.random() < hot_share else rnd.choice([None, 1, 2, 3] + list(range(10, 60)))
        rows.append((k, rnd.choice(["a", "b", None]), (i * 7919) % 100003, rnd.random() < 0.6))
    return spark.createDataFrame(rows, "k int, k2 string, s int, f boolean").repartition(3)


def test_matches_window_with_hot_key(spark):
    df = _data(spark, 5000, 0.4, 1)
    got = earlier_count(df, ["k", "k2"], ["s"], flag="f", out="e")
    w = W.partitionBy("k", "k2").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    exp = df.withColumn("x", F.coalesce(F.sum(F.col("f").cast("int")).over(w), F.lit(0)))
    assert got.count() == 5000
    assert got.join(exp, ["s"]).filter(F.col("e") != F.col("x")).count() == 0


def test_single_key_spans_every_partition(spark):
    df = _data(spark, 3000, 1.0, 2)
    got = earlier_count(df, ["k"], ["s"], out="e", inclusive=True)
    assert sorted(r.e for r in got.collect()) == list(range(1, 3001))


def test_global_sequence_and_empty(spark):
    df = _data(spark, 2000, 0.1, 3)
    got = earlier_count(df, [], ["s"], out="e")
    exp = df.withColumn("x", F.row_number().over(W.orderBy("s")) - 1)
    assert got.join(exp, ["s"]).filter(F.col("e") != F.col("x")).count() == 0
    assert earlier_count(df.limit(0), ["k"], ["s"]).count() == 0


def test_single_key_with_many_nulls(spark):
    rnd = random.Random(5)
    rows = [(None if rnd.random() < 0.5 else rnd.randrange(3), i, rnd.random() < 0.5) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, s int, f boolean").repartition(4)
    got = earlier_count(df, ["k"], ["s"], flag="f", out="e")
    w = W.partitionBy("k").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    exp = df.withColumn("x", F.coalesce(F.sum(F.col("f").cast("int")).over(w), F.lit(0)))
    assert got.join(exp, ["s"]).filter(F.col("e") != F.col("x")).count() == 0
