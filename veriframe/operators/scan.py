"""Distributed prefix scans: running values along an order within a key, where one key may hold all rows.

A window on the key would send a hot key to one task. Here rows are range-partitioned by key and order and
each partition is a block: windows run within (key, block), and what earlier blocks of the same key add is
carried in. Only the first key of a block can go on from an earlier block, so there is at most one carried row per block."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriframe.tables import materialize


def blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """df with column block, written to the shared folder: blocks follow each other in the order of keys, then order (nulls first).

    Rows that agree in all of these are dealt out at random, so that no number of repeated rows makes a block large."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_tie", F.rand(42)).repartitionByRange(n, *keys, *order, "_tie").drop("_tie")
    return materialize(dealt.withColumn("block", F.spark_partition_id()))


@dataclass(frozen=True)
class Kind:
    """How a value runs: total of a block, the value within a block, and how a carried value joins it."""

    total: Callable[[Column, Column], Column]
    local: Callable[[Column, WindowSpec], Column]
    carry: Callable[[Column, WindowSpec], Column]
    join: Callable[[Column, Column], Column]
    exclusive: bool = False


def _sum(exclusive: bool) -> Kind:
    add = lambda x, carried: F.coalesce(x, F.lit(0)) + F.coalesce(carried, F.lit(0))
    return Kind(lambda v, _: F.sum(v), lambda v, w: F.sum(v).over(w), lambda t, w: F.sum(t).over(w), add, exclusive)


def _xor() -> Kind:
    both = lambda x, carried: F.coalesce(x, F.lit(0)).bitwiseXOR(F.coalesce(carried, F.lit(0)))
    return Kind(lambda v, _: F.bit_xor(v), lambda v, w: F.bit_xor(v).over(w), lambda t, w: F.bit_xor(t).over(w), both)


KINDS = {
    "sum": _sum(False),
    "sum_before": _sum(True),
    "xor": _xor(),
    "max": Kind(lambda v, _: F.max(v), lambda v, w: F.max(v).over(w), lambda t, w: F.max(t).over(w), F.greatest),
    # the newest value that is not null, the row's own included
    "last": Kind(lambda v, o: F.max_by(v, F.when(v.isNotNull(), o)), lambda v, w: F.last(v, True).over(w), lambda t, w: F.last(t, True).over(w), F.coalesce),
    # the value of the row before, null or not; in a struct, so that a null value is told from no row
    "prior": Kind(lambda v, o: F.max_by(F.struct(v.alias("v")), o), lambda v, w: F.last(F.struct(v.alias("v"))).over(w), lambda t, w: F.last(t).over(w), lambda x, c: F.coalesce(x, c)["v"], True),
}


def running(blocked: DataFrame, keys: Sequence[str], order: Sequence[str], **values: tuple[str, Column]) -> DataFrame:
    """The rows of blocks() with a column for each of values: name=(kind of KINDS, column). Null keys are keys like any other.

    order must settle the order of the rows of a key where the kind depends on it (last, prior)."""
    keys, order = list(keys), list(order)
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    ends = blocked.groupBy("block").agg(F.min(key).alias("_first"), F.max(key).alias("_final"))
    # of a block's keys only its first and its last can stand in other blocks too
    edge = blocked.join(F.broadcast(ends), "block").filter(key.eqNullSafe(F.col("_first")) | key.eqNullSafe(F.col("_final")))
    along = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    totals = edge.groupBy(key.alias("_key"), "block").agg(*[KINDS[kind].total(v, along).alias(f"_{n}") for n, (kind, v) in values.items()])
    earlier = W.partitionBy("_key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select("_key", F.col("block").alias("_block"), F.row_number().over(W.partitionBy("_key").orderBy("block")).alias("_nth"),
                            *[KINDS[kind].carry(F.col(f"_{n}"), earlier).alias(f"_{n}") for n, (kind, _) in values.items()])
    carried = carried.filter("_nth > 1").drop("_nth")  # at most one row per block
    own = W.partitionBy(*keys, "block").orderBy(*order)
    frame = {False: own.rowsBetween(W.unboundedPreceding, W.currentRow), True: own.rowsBetween(W.unboundedPreceding, -1)}
    local = blocked.select("*", *[KINDS[kind].local(v, frame[KINDS[kind].exclusive]).alias(f"_local_{n}") for n, (kind, v) in values.items()])
    joined = local.join(F.broadcast(carried), (F.col("block") == F.col("_block")) & key.eqNullSafe(F.col("_key")), "left")
    return joined.select(*blocked.columns, *[KINDS[kind].join(F.col(f"_local_{n}"), F.col(f"_{n}")).alias(n) for n, (kind, _) in values.items()])
