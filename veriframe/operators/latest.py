"""Latest rows, severity rollups, tallies, distributions and ordered lists.

All of them are map-side-combined aggregates, so a hot key is reduced before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriframe.operators import ranks, scan

#: Severity of verdicts, mildest first (a fixed order).
SEVERITY = {"not_applicable": 0, "not_required": 1, "pass": 2, "pass_with_note": 3, "needs_review": 4, "fail": 5}
#: Verdicts that a rollup names; anything milder is a pass.
NAMED = ("fail", "needs_review", "pass_with_note")


def _map(c: Column, table: dict, otherwise=None) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(otherwise))


def severity(c: Column) -> Column:
    return _map(c, SEVERITY)


def verdict_of(level: Column) -> Column:
    names = [v for v in SEVERITY if v in NAMED]
    out = F.lit("pass")
    for name in names:
        out = F.when(level == SEVERITY[name], name).otherwise(out)
    return out


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest order columns (compared left to right)."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], where: Column | None = None) -> DataFrame:
    """The earliest row of each key among those of where; the observation cache never keeps others."""
    df = df if where is None else df.filter(where)
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*").select(*df.columns)


def worst_of(df: DataFrame, keys: Sequence[str], verdict_col: str) -> DataFrame:
    return df.groupBy(*keys).agg(verdict_of(F.max(severity(F.col(verdict_col)))).alias("overall"))


def worst_of_array(findings: Column) -> Column:
    return verdict_of(F.array_max(F.transform(findings, lambda f: severity(f["verdict"]))))


def worst_row(df: DataFrame, keys: Sequence[str], verdict_col: str, tie: Sequence[str]) -> DataFrame:
    """The worst row of each key; of equals the one with the smallest tie columns."""
    rest = F.struct(*[c for c in df.columns if c not in keys])
    best = df.groupBy(*keys).agg(F.min_by(rest, F.struct((-severity(F.col(verdict_col))).alias("s"), *tie)).alias("r"))
    return best.select(*keys, "r.*").select(*df.columns)


def tally(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def tally_elements(df: DataFrame, array_col: str) -> DataFrame:
    return df.select(F.explode(array_col).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def distribution(df: DataFrame, keys: Sequence[str], value_col: str, digits: int = 2) -> DataFrame:
    """count, min, p50, p95, max, avg; percentiles by nearest rank (index ceil(n * q) - 1), over groups of any size."""
    return ranks.distribution(df, keys, value_col, digits)


def map_distribution(df: DataFrame, keys: Sequence[str], map_col: str) -> DataFrame:
    """distribution of every key of a map column; null values are dropped."""
    long = df.select(*keys, F.explode(map_col).alias("stage", "value")).filter("value is not null")
    return distribution(long, [*keys, "stage"], "value")


def conditional_counts(df: DataFrame, keys: Sequence[str], preds: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(p).alias(n) for n, p in preds.items()])


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total == 0, 0).otherwise(F.round(done * 100 / total)).cast("int")


def batch_progress(df: DataFrame, batch: str, state: str, terminal: Sequence[str]) -> DataFrame:
    """Counts, percent and status (processing while any row is not terminal) of each batch."""
    g = df.groupBy(F.col(batch).alias("batch")).agg(F.count("*").alias("total"), F.count_if(F.col(state).isin(*terminal)).alias("done"))
    return g.withColumn("percent", progress_percent(F.col("done"), F.col("total"))).withColumn("status", F.when(F.col("done") < F.col("total"), "processing").otherwise("completed"))


def run_summary(df: DataFrame, ok: Column, ms_col: str, target_ms: int, cold: bool) -> DataFrame:
    """Successes, failures, records a second, and whether the median of a cold run meets the target (null else)."""
    g = df.agg(F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.sum(ms_col).alias("total_ms"))
    g = ranks.join_same(g, ranks.rank_values(df, [], ms_col, {"p50": 0.5}).withColumn("p50", F.col("p50").cast(df.schema[ms_col].dataType)), [], "left")
    rate = F.when(F.col("total_ms") > 0, F.round((F.col("successes") + F.col("failures")) * 1000 / F.col("total_ms"), 4))
    return g.withColumn("per_second", rate).withColumn("target_met", F.col("p50") <= target_ms if cold else F.lit(None).cast("boolean"))


def ordered_list(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct(order, value)))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda x: x[value]).alias("list"))


def shared_keys(df: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys that more than one owner has, with the number of owners; no self-join."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(owner).alias("owners")).filter("owners > 1")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key (Spark limits the groups before the shuffle)."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def running_offset(df: DataFrame, key: str, order: str, size_col: str) -> DataFrame:
    """The sum of size_col over the earlier rows of the key, by a prefix scan: a key of any size is split between tasks."""
    return scan.running(scan.blocks(df, [key], [order]), [key], [order], offset=("sum_before", F.col(size_col))).drop("block")


def reuse_asof(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The newest earlier value under the same keys, null for the first, by a prefix scan."""
    return scan.running(scan.blocks(df, keys, order), keys, order, reused=("prior", F.col(value))).drop("block")


def reuse_with_owner(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, owner: str) -> DataFrame:
    """reuse_asof that also names, as duplicate_of, the owner of the reused value where it is another's."""
    old = scan.running(scan.blocks(df, keys, order), keys, order, _old=("prior", F.struct(F.col(value).alias("v"), F.col(owner).alias("o"))))
    return old.withColumns({"reused": F.col("_old.v"), "duplicate_of": F.when(F.col("_old.o") != F.col(owner), F.col("_old.o"))}).drop("_old", "block")


def union_box(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The smallest box around x, y, width, height of each key."""
    g = df.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.expr("x + width")).alias("r"), F.max(F.expr("y + height")).alias("b"))
    return g.selectExpr(*keys, "x", "y", "r - x width", "b - y height")


def stratified_sample(df: DataFrame, stratum: str, order: Sequence[str], limit: int) -> DataFrame:
    """limit rows in proportion to the strata by largest remainders (ties by stratum), in order within each: the same every time."""
    n = df.groupBy(stratum).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    q = n.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") * limit / F.col("total")).withColumn("floor", F.floor("share"))
    all_ = W.partitionBy(F.lit(0))
    q = q.withColumn("place", F.row_number().over(all_.orderBy((F.col("floor") - F.col("share")), stratum))).withColumn("left", F.lit(limit) - F.sum("floor").over(all_))
    q = q.select(stratum, F.least("n", F.col("floor") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).alias("quota"))
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(stratum).orderBy(*order))).filter(F.col("rank") <= limit)
    return ranked.join(q.hint("merge"), stratum).filter("rank <= quota").drop("quota", "rank")
