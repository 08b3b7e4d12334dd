"""Structured Streaming: progress of batches, stage counts and deduplication of arriving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_counts(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts by keys; the state is one row per key."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))


def stream_stage_stats(stream: DataFrame, stage: str, ms: str, ts: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count, mean and greatest duration of stages by event-time window; rows later than `late` are dropped, which bounds the state."""
    s = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return s.groupBy(F.window("_ts", window), stage).agg(F.count("*").alias("n"), F.avg(ms).alias("avg_ms"), F.max(ms).alias("max_ms"))


def stream_dedupe(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(keys).drop("_ts")


def verify_stream(declared: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Arriving declared records with their labels' texts (a table), checked by the rule catalogue; no state is kept."""
    from veriframe.plans import rules

    return rules.evaluate(declared.join(labels, key))


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and gives what it wrote, as a table of the session."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
