"""Reports over attempts and verdicts, with exact nearest-rank percentiles that need no buffer of a group's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.operators import ranks
from veriframe.operators.latest import latest_per_key
from veriframe.operators.ranks import rank_values


def rank_distribution(df: DataFrame, keys: Sequence[str], value_col: str, digits: int = 2) -> DataFrame:
    """count, min, p50, p95, max, avg of each key that has a value, percentiles by nearest rank, over groups of any size."""
    return ranks.distribution(df, keys, value_col, digits, empty=False)


def _long(metric: Column | str, d: DataFrame) -> DataFrame:
    d = d.withColumn("metric", F.lit(metric) if isinstance(metric, str) else metric)
    return d.select("metric", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in ("count", "min", "p50", "p95", "max", "avg")])).alias("x")).select("metric", "x.name", "x.value")


def _tally(metric: str, df: DataFrame, c: str) -> DataFrame:
    return df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit(metric).alias("metric"), "name", "value")


def full_attempt_report(attempts: DataFrame, state: str, verdict: str, wait: str, timings: str, reused: str, error_class: str, total_key: str = "total_ms") -> DataFrame:
    """Long metrics (metric, name, value) of attempts with their verdict (null without one): attempts, states, verdicts, queue wait, each stage of the map timings and the
    total among them, reused and fresh results, errors by class."""
    stages = attempts.select(F.explode(timings).alias("stage", "ms")).filter("ms is not null")
    per = rank_distribution(stages, ["stage"], "ms")
    with_result = attempts.filter(F.col(verdict).isNotNull())
    split = with_result.agg(F.count_if(F.col(reused)).alias("reused"), F.count_if(~F.coalesce(F.col(reused), F.lit(False))).alias("fresh"))
    count = attempts.agg(F.count("*").cast("double").alias("value")).select(F.lit("attempts").alias("metric"), F.lit("total").alias("name"), "value")
    parts = [count, _tally("state", attempts, state), _tally("verdict", attempts, verdict), _long("queue_wait_ms", rank_distribution(attempts, [], wait)), _long(F.concat(F.lit("stage:"), F.col("stage")), per),
             _long("total_ms", per.filter(F.col("stage") == total_key)), split.select(F.explode(F.array(*[F.struct(F.lit("extraction").alias("metric"), F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in ("reused", "fresh")])).alias("x")).select("x.*"),
             _tally("error", attempts.filter(F.col(state) == "error"), error_class)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def word_summary(records: DataFrame, ok: str, error_class: str, word_count: str, backpressure: str) -> DataFrame:
    """One row: successes, failures, failures for backpressure, words in all, and the distribution of words."""
    g = records.agg(F.count_if(ok).alias("successes"), F.count_if(~F.col(ok)).alias("failures"), F.count_if(F.col(error_class) == backpressure).alias("backpressure_failures"), F.coalesce(F.sum(word_count), F.lit(0)).cast("long").alias("words"))
    return g.join(F.broadcast(rank_distribution(records, [], word_count)))


def verification_stats(history: DataFrame, verdict_col: str, latency_col: str) -> DataFrame:
    """(count, average_ms, p95_ms) of completed verdicts with a latency; the mean is a whole number. No such verdict gives no row."""
    done = history.filter((F.col(verdict_col) != "error") & F.col(latency_col).isNotNull())
    g = done.agg(F.count("*").alias("count"), F.round(F.avg(latency_col)).cast("long").alias("average_ms")).filter("count > 0")
    return g.join(F.broadcast(rank_values(done, [], latency_col, {"p95_ms": 0.95})))


def calibration(history: DataFrame, keys: Sequence[str], verdict_col: str, latency_col: str) -> DataFrame:
    """Per keys: a verdict's count in each row, with the mean and 95th percentile of latency in seconds to one place."""
    done = history.filter(F.col(verdict_col) != "error")
    counts = done.groupBy(*keys, F.col(verdict_col).alias("verdict")).agg(F.count("*").alias("n"))
    g = rank_distribution(done, keys, latency_col, 10).select(*keys, F.round(F.col("avg") / 1000, 1).alias("avg_s"), F.round(F.col("p95") / 1000, 1).alias("p95_s"))
    return counts.join(g.hint("merge"), list(keys), "left")


def results_export(records: DataFrame, history: DataFrame, key: str, order: Sequence[str], verdict_col: str, decision_col: str, findings_col: str) -> DataFrame:
    """records with overall_verdict ('pending' without one), decision and findings, those that failed or need review as 'field: note (citation)' parted by bars: ready for CSV."""
    newest = latest_per_key(history.select(key, *[c for c in dict.fromkeys([*order, verdict_col, decision_col, findings_col]) if c != key]), [key], order)
    some = F.filter(findings_col, lambda f: f["verdict"].isin("fail", "needs_review"))
    text = F.array_join(F.transform(some, lambda f: F.concat(f["field"], F.lit(": "), F.coalesce(f["note"], F.lit("")), F.lit(" ("), F.coalesce(f["citation"], F.lit("")), F.lit(")"))), " | ")
    newest = newest.select(key, F.col(verdict_col).alias("_v"), F.col(decision_col).alias("_d"), text.alias("_f"))
    return records.join(newest, key, "left").select(*records.columns, F.coalesce("_v", F.lit("pending")).alias("overall_verdict"), F.col("_d").alias("decision"), F.coalesce("_f", F.lit("")).alias("findings"))
