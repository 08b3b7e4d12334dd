"""Percentiles by nearest rank: against a sort, with outliers, ties, nulls and one group of all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veriframe.operators import latest, ranks

Q = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}


@pytest.mark.parametrize("kind", ["spread", "ties", "heavy"])
def test_rank_values(spark, kind):
    rng = random.Random(kind)
    value = {"spread": lambda: rng.random() * 1e6, "ties": lambda: float(rng.randrange(3)), "heavy": lambda: rng.random() ** -12}[kind]
    rows = [(rng.choice([None, 1, 1, 1, 1, 2]), None if rng.random() < 0.1 else value()) for _ in range(3000)] + [(9, None), (8, float("nan")), (1, 1e15), (7, -3.5)]
    df = spark.createDataFrame(rows, "k int, v double")
    by = {}
    for k, v in rows:
        if v is not None and v == v:
            by.setdefault(k, []).append(v)
    want = {k: tuple(sorted(vs)[max(1, math.ceil(len(vs) * q - 1e-9)) - 1] for q in Q.values()) for k, vs in by.items()}
    assert {r[0]: tuple(r)[1:] for r in ranks.rank_values(df, ["k"], "v", Q).collect()} == want
    every = sorted(v for vs in by.values() for v in vs)
    assert tuple(ranks.rank_values(df, [], "v", Q).first()) == tuple(every[max(1, math.ceil(len(every) * q - 1e-9)) - 1] for q in Q.values())


def test_blocks_stay_small_with_an_outlier(spark):
    """One value far off does not gather the others: the blocks that hold a rank have a share of the values."""
    df = spark.range(40_000).select((F.col("id") % 20_000).cast("double").alias("v")).union(spark.range(1).select(F.lit(1e15)))
    assert ranks.rank_values(df, [], "v", {"p50": 0.5}).first().p50 == 10_000.0
    counted = df.groupBy("v").count()
    sizes = [r["count"] for r in ranks.scan.blocks(counted, [], ["v"], 16).groupBy("block").count().collect()]
    assert max(sizes) < 4 * 20_000 / 16


def test_distribution_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "k int, v double")
    assert tuple(latest.distribution(df, ["k"], "v").first()) == (1, 0, None, None, None, None, None)
    assert latest.distribution(df.limit(0), ["k"], "v").collect() == []
    none = latest.run_summary(df.limit(0), F.lit(True), "v", 10, True).first()
    assert (none.successes, none.failures, none.target_met) == (0, 0, None)
