"""Operators on small tables."""

from pyspark.sql import functions as F

from veriframe.functions import text
from veriframe.operators import evidence, joins, latest, lifecycle
from veriframe.sources import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_distribution_is_nearest_rank(spark):
    df = spark.createDataFrame([(1, 50.0), (1, 150.0), (1, 20.0), (2, None)], "k int, v double")
    assert rows(latest.distribution(df, ["k"], "v"))[0] == (1, 3, 20.0, 50.0, 150.0, 150.0, 73.33)


def test_latest_and_first(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, v string")
    assert rows(latest.latest_per_key(df, ["k"], ["o"])) == [(1, 2, "b"), (2, 1, "c")]
    assert rows(latest.first_per_key(df, ["k"], ["o"], F.col("v") != "a")) == [(1, 2, "b"), (2, 1, "c")]


def test_worst_of_is_order_free(spark):
    df = spark.createDataFrame([(1, "pass"), (1, "fail"), (2, "not_required"), (3, "pass_with_note")], "k int, verdict string")
    want = [(1, "fail"), (2, "pass"), (3, "pass_with_note")]
    assert rows(latest.worst_of(df, ["k"], "verdict")) == want == rows(latest.worst_of(df.orderBy("verdict"), ["k"], "verdict"))


def test_sample_quotas_sum_to_limit(spark):
    df = spark.range(103).withColumn("s", F.col("id") % 7)
    for limit in (1, 10, 50):
        assert latest.stratified_sample(df, "s", ["id"], limit).count() == limit


def test_reconcile_is_complete(spark):
    r = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string")
    f = spark.createDataFrame([("a",), ("c",), ("c",)], "y string")
    assert rows(joins.reconcile(r, "x", f, "y")) == [("a", "duplicate_reference"), ("b", "missing"), ("c", "duplicate_upload"), ("c", "orphan")]


def test_upsert_golden_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None)], "k int, v string")
    up = joins.upsert(a, b, ["k"])
    assert rows(up.select("k")) == [(1,), (2,), (3,)]
    assert rows(joins.changed_rows(a, up, "k", ["v"]).select("k")) == [(2,)]
    assert rows(joins.compare_golden(a, up, ["k"], "v").select("k")) == [(2,)]


def test_lines(spark):
    w = spark.createDataFrame([(1, 0, 0, 10, 10, "a"), (1, 20, 2, 10, 10, "b"), (1, 0, 40, 10, 10, "c")], "p int, x int, y int, width int, height int, text string")
    assert [r.text for r in evidence.build_lines(w, ["p"]).orderBy("line").collect()] == ["a b", "c"]


def test_lines_at_the_share(spark):
    # centres are 31.5 apart, which is 0.7 of the height 45 and no more
    w = spark.createDataFrame([(1, 0, 0, 10, 45, "a"), (1, 20, 49, 10, 10, "b"), (2, 0, 0, 10, 45, "a"), (2, 20, 50, 10, 10, "b")], "p int, x int, y int, width int, height int, text string")
    assert sorted((r.p, r.text) for r in evidence.build_lines(w, ["p"]).collect()) == [(1, "a b"), (2, "a"), (2, "b")]


def test_locate(spark):
    df = spark.createDataFrame([("noise OLD TOM noise".split(), "OLD TQM"), (["x"], "OLD TOM"), ([], "A")], "t array<string>, g string")
    got = [r.match and r.match.text for r in evidence.locate(df, "t", "g").collect()]
    assert got == ["OLD TOM", None, None]


def test_locate_long_text(spark):
    said = " ".join(f"WORD{k}" for k in range(20))
    df = spark.createDataFrame([(["x", *said.split(), "y"], said)], "t array<string>, g string")
    assert [(r.match.n, r.match.score) for r in evidence.locate(df, "t", "g").collect()] == [(20, 1.0)]


def test_first_window(spark):
    df = spark.createDataFrame([(["net", "750", "mL", "x"],), ([],)], "t array<string>")
    assert [r.w for r in df.select(evidence.first_window(F.col("t"), 3, r"^\d+ mL$").alias("w")).collect()] == ["750 mL", None]


def test_ingest_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,n,y\n1,5,2019\n,x,19\n2,NaN,2019\n3,100,1900\n")
    df = ingest.read_declared_csv(spark, str(tmp_path / "a.csv"), ["a", "n", "y"])
    good, bad = ingest.split_valid(df, ingest.row_errors(ingest.err_required("a"), ingest.err_percent("n"), ingest.err_year("y")))
    assert [r.a for r in good.collect()] == ["1"]
    assert bad.count() == 6
    assert ingest.column_errors(["a", "z"], ["a", "b"], []) == [("missing_column", "b"), ("unknown_column", "z")]


def test_word_tsv(spark):
    lines = spark.createDataFrame([("5\t1\t1\t1\t1\t2\t10\t20\t30\t8\t-1\tTom",), ("1\t1\t0\t0\t0\t0\t0\t0\t900\t1200\t-1\t",), ("short",)], "value string")
    assert rows(ingest.parse_word_tsv(lines)) == [(1, 2, "Tom", 10, 20, 30, 8, None)]


def test_mutants_and_rates(spark):
    m = lifecycle.mutate(spark.range(3), "id", {"ODD": (F.col("id") % 2 == 1, F.col("id"))})
    assert rows(lifecycle.pair_mutants(m, "serial").select("parent", "kind")) == [("1", "ODD")]
    df = spark.createDataFrame([(1, 3), (0, 0)], "a int, b int")
    assert [r.r for r in df.select(lifecycle.rate(F.col("a"), F.col("b")).alias("r")).collect()] == ["33.3", "n/a"]


def test_redact_whole_documents(spark):
    df = spark.createDataFrame([("x" * 600 + " api_key=abc end",)], "t string")
    assert [r.t for r in df.select(text.redact(F.col("t"), None).alias("t")).collect()] == ["x" * 600 + " api_key=[REDACTED] end"]
