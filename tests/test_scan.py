"""Prefix scans agree with windows, also where one key holds all rows and where keys, orders and values are null or repeated."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriframe.operators import scan


@pytest.mark.parametrize("n_keys", [1, 3, 400])
@pytest.mark.parametrize("partitions", [1, 7, 23])
def test_running_is_a_window(spark, n_keys, partitions):
    rng = random.Random(n_keys * 100 + partitions)
    rows = [(None if rng.random() < 0.1 else rng.randrange(n_keys), None if i == 5 else i, None if rng.random() < 0.3 else rng.randrange(100)) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, o int, v long")
    b = scan.blocks(df, ["k"], ["o"], partitions)
    assert b.select("block").distinct().count() > partitions // 2
    got = scan.running(b, ["k"], ["o"], n=("sum", F.lit(1)), s=("sum_before", F.col("v")), x=("xor", F.col("v")), m=("max", F.col("v")), last=("last", F.col("v")), prior=("prior", F.col("v")))
    w = W.partitionBy("k").orderBy("o")
    up = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    want = df.select("*", F.count("*").over(up).alias("n"), F.coalesce(F.sum("v").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("s"), F.coalesce(F.bit_xor("v").over(up), F.lit(0)).alias("x"),
                     F.max("v").over(up).alias("m"), F.last("v", True).over(up).alias("last"), F.lag("v").over(w).alias("prior"))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_one_key_of_equal_rows_fills_all_blocks(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), F.lit(1).alias("o"), F.col("id").alias("v"))
    b = scan.blocks(df, ["k"], ["o"], 8)
    assert max(r["count"] for r in b.groupBy("block").count().collect()) < 1000
    got = scan.running(b, ["k"], ["o"], n=("sum", F.lit(1)))
    assert sorted(r.n for r in got.collect()) == list(range(1, 4001))


def test_empty(spark):
    df = spark.createDataFrame([], "k int, o int, v long")
    assert scan.running(scan.blocks(df, ["k"], ["o"]), ["k"], ["o"], n=("sum", F.col("v"))).collect() == []
