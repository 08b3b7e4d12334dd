"""Exact nearest-rank percentiles of groups of any size, without a buffer of values.

Equal values are counted before the shuffle. The distinct values are range-partitioned by group and value, by sampled splitters, so blocks
hold about as many values whatever their spread; the sums of blocks show which block holds a rank, and only those blocks are run through in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriframe.operators import scan


def join_same(a: DataFrame, b: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """a join b on equal columns, null equal to null; b's key columns are dropped."""
    if not on:  # b has one row
        return a.crossJoin(F.broadcast(b)) if how == "inner" else a.join(F.broadcast(b), F.lit(True), how)
    b = b.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = None
    for c in on:
        one = F.col(c).eqNullSafe(F.col(f"_on_{c}"))
        same = one if same is None else same & one
    return a.join(b.hint("merge"), same, how).drop(*[f"_on_{c}" for c in on])


def rank_values(df: DataFrame, keys: Sequence[str], value_col: str, quantiles: dict[str, float]) -> DataFrame:
    """keys and one column for each quantile: the value of rank ceil(n * q). Nulls and NaN do not count; a group without values has no row."""
    keys = list(keys)
    v = F.col(value_col).cast("double")
    counted = df.select(*keys, v.alias("_v")).filter("_v is not null and not isnan(_v)").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    b = scan.blocks(counted, keys, ["_v"])
    # one row for each group and block, so at most as many of a group as there are blocks
    along, group = W.partitionBy(*keys).orderBy("block"), W.partitionBy(*keys)
    sums = b.groupBy(*keys, "block").agg(F.sum("_n").alias("_s"))
    sums = sums.select("*", (F.sum("_s").over(along) - F.col("_s")).alias("_before"), F.sum("_s").over(group).alias("_all"))
    wanted = F.array(*[F.struct(F.lit(n).alias("q"), F.greatest(F.ceil(F.col("_all") * q), F.lit(1)).cast("long").alias("rank")) for n, q in quantiles.items()])
    held = F.filter(wanted, lambda x: (x["rank"] > F.col("_before")) & (x["rank"] <= F.col("_before") + F.col("_s")))
    sums = sums.select(*keys, "block", "_before", held.alias("_held")).filter(F.size("_held") > 0)
    rows = join_same(b, sums, [*keys, "block"], "inner")
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "block").orderBy("_v"))
    rows = rows.withColumn("_upto", upto).withColumn("_q", F.explode("_held")).filter((F.col("_q.rank") <= F.col("_upto")) & (F.col("_q.rank") > F.col("_upto") - F.col("_n")))
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("_q.q") == n, F.col("_v"))).alias(n) for n in quantiles])


def distribution(df: DataFrame, keys: Sequence[str], value_col: str, digits: int = 2, empty: bool = True) -> DataFrame:
    """count, min, p50, p95, max, avg of each group; groups of nulls alone have a row of count 0 if empty."""
    v = F.col(value_col).cast("double")
    g = (df if empty else df.filter(v.isNotNull())).groupBy(*keys).agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg"))
    j = join_same(g, rank_values(df, keys, value_col, {"p50": 0.5, "p95": 0.95}), list(keys), "left")
    return j.select(*keys, "count", *[F.round(c, digits).alias(c) for c in ("min", "p50", "p95", "max", "avg")])
