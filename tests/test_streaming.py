"""Streams: pairs of stage events with late, repeated and missing ones, a table that a restart does not change, and the catalogue on arriving records."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from veriframe import tables
from veriframe.plans import rules
from veriframe.streaming import progress, stages

T0 = datetime(2024, 5, 1)
SCHEMA = "k string, kind string, at timestamp"


def arrive(spark, path, rows):
    spark.createDataFrame([(k, kind, None if s is None else T0 + timedelta(seconds=s)) for k, kind, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, table, checkpoint):
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    stages.to_table(stages.pair_stages(stream, ["k"], "kind", "at", timedelta(minutes=10), "1 minute"), table, checkpoint)
    return sorted(((r.k, r.status, r.ms) for r in spark.read.parquet(table).collect()), key=str)


def test_pairs(spark):
    path, table, checkpoint = (tables.new_path(spark, x) for x in ("in", "out", "cp"))
    arrive(spark, path, [("a", "started", 100), ("a", "started", 95), ("b", "started", 100), ("c", "finished", 100), ("d", "started", 100), ("e", "finished", 90), ("e", "started", 100), (None, "started", 1), ("x", "other", 100), ("y", "started", None)])
    arrive(spark, path, [(None, "finished", 3)])
    run(spark, path, table, checkpoint)
    arrive(spark, path, [("a", "finished", 110), ("b", "finished", 100), ("b", "finished", 300), ("c", "started", 80), ("e", "finished", 130)])
    second = run(spark, path, table, checkpoint)
    assert [r for r in second if r[0]] == [("a", "finished", 15000), ("b", "finished", 0), ("c", "finished", 20000), ("e", "finished", 30000)]
    assert run(spark, path, table, checkpoint) == second  # a restart without new files repeats nothing
    arrive(spark, path, [("z", "started", 10_000)])
    assert [r for r in run(spark, path, table, checkpoint) if r[0]] == [("a", "finished", 15000), ("b", "finished", 0), ("c", "finished", 20000), ("d", "unfinished", None), ("e", "finished", 30000)]
    arrive(spark, path, [("a", "finished", 120), ("late", "started", 50)])  # far behind the watermark
    assert len([r for r in run(spark, path, table, checkpoint) if r[0]]) == 5


def test_upserts_of_a_batch_that_runs_again(spark):
    path, table = tables.new_path(spark, "in"), tables.new_path(spark, "out")
    for n in range(3):
        spark.createDataFrame([("a",), ("b",)][: 1 + n % 2] * (n + 1), "k string").coalesce(1).write.mode("append").parquet(path)
    for again in range(2):  # the second run has no memory of the first, and writes the same batches once more
        stream = spark.readStream.schema("k string").option("maxFilesPerTrigger", 1).parquet(path)
        stages.to_table(progress.stream_counts(stream, ["k"]), table, tables.new_path(spark, f"cp{again}"), "update")
        got = spark.read.parquet(table)
        assert sorted(map(tuple, stages.newest_of(got, ["k"], ["n"]).collect())) == [("a", 6), ("b", 2)]
    stages.compact(got, ["k"], ["n"], small := tables.new_path(spark, "small"))
    assert sorted((r.k, r.n) for r in spark.read.parquet(small).collect()) == [("a", 6), ("b", 2)]


def test_catalogue_on_a_stream_is_that_of_the_table(spark):
    none = F.lit(None)
    declared = spark.range(6).select(F.col("id").alias("key"), F.element_at(F.array(*map(F.lit, ("wine", "malt", "spirits"))), (F.col("id") % 3 + 1).cast("int")).alias("beverage_type"), F.lit("Stone").alias("brand_name"), (F.col("id") > 3).alias("imported"),
                                     none.cast("string").alias("fanciful_name"), F.lit("Stone LLC, Austin, TX").alias("applicant_name_address"), F.lit("France").alias("country_of_origin"), F.lit("750 mL").alias("net_contents"), F.lit(12.0).alias("alcohol_content"),
                                     none.cast("double").alias("actual_alcohol_content"), none.cast("string").alias("appellation"), none.cast("int").alias("vintage_year"), none.cast("array<string>").alias("varietals"), *[none.cast("boolean").alias(k) for k in rules.DISCLOSURES])
    label = spark.range(6).select(F.col("id").alias("key"), F.lit("STONE").alias("label_brand_name"), none.cast("string").alias("label_fanciful_name"), F.lit("Bottled by Stone, Austin, TX").alias("label_name_address"), F.lit("France").alias("label_country_of_origin"),
                                  F.lit(rules.WARNING).alias("label_warning"), F.lit(True).alias("label_warning_bold"), F.lit("750 ML").alias("label_net_contents"), F.lit("12% ALC BY VOL").alias("label_alcohol"), F.lit("table wine").alias("label_class_type"),
                                  none.cast("string").alias("label_vintage"), none.cast("string").alias("label_appellation"), none.cast("array<string>").alias("label_disclosures"), F.lit(True).alias("label_legible"), F.lit(0.9).alias("label_confidence"))
    path = tables.new_path(spark, "in")
    declared.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(declared.schema).option("maxFilesPerTrigger", 1).parquet(path)
    stages.to_table(progress.verify_stream(stream, label, "key").select("key", "overall", F.to_json("findings").alias("f")), out := tables.new_path(spark, "out"), tables.new_path(spark, "cp"))
    want = rules.evaluate(declared.join(label, "key")).select("key", "overall", F.to_json("findings").alias("f"))
    assert sorted(map(tuple, spark.read.parquet(out).select("key", "overall", "f").collect())) == sorted(map(tuple, want.collect()))
