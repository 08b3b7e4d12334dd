"""Vocabulary joins against a plain search; lines against a plain fold and in linear time."""

import random
import time

from pyspark.sql import functions as F

from veriframe.operators import evidence, geometry, joins


def plain(texts, names):
    out = {}
    for k, x in texts:
        hits = [(1 if x == n else 2, p, n) for n, p in names if x and n and f" {n} " in f" {x} "]
        if hits:
            tier, p, n = min(hits)
            out[k] = (n, tier, p)
    return out


def test_vocab_join(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"W{i}" for i in range(60)] + ["THE"] * 40
    names = [(" ".join(rng.choices(words, k=rng.choice([1, 2, 2, 3]))), i) for i in range(400)] + [("THE", 1000), ("THE THE", 1001), ("", 0), (None, 1), ("W1 NEVER", 2)]
    texts = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 5, 30])))) for i in range(500)] + [(900, None), (901, ""), (902, "THE"), (903, "THE THE"), (904, "NONE OF IT")]
    rows, vocab = spark.createDataFrame(texts, "k int, x string"), spark.createDataFrame(names, "name string, place int")
    want = plain(texts, [(n, p) for n, p in names if n])
    for most in (joins.MOST_POSTINGS, 3):  # also where every token is split
        monkeypatch.setattr(joins, "MOST_POSTINGS", most)
        monkeypatch.setattr(joins, "HOT_TOKENS", 10**6)
        assert {r.k: (r.entry, r.tier, r.place) for r in joins.vocab_join(rows, "k", "x", vocab).collect()} == want
    assert joins.vocab_join(rows, "k", "x", vocab.limit(0)).count() == joins.vocab_join(rows.limit(0), "k", "x", vocab).count() == 0


def test_vocab_join_of_many_entries(spark):
    vocab = spark.range(100_000).select(F.concat(F.lit("NAME "), F.col("id").cast("string")).alias("name"), F.col("id").alias("place"))
    rows = spark.range(200).select("id", F.concat(F.lit("A NAME "), (F.col("id") * 601).cast("string"), F.lit(" B")).alias("x"))
    got = {r.id: r.place for r in joins.vocab_join(rows, "id", "x", vocab).collect()}
    assert got == {i: i * 601 for i in range(200) if i * 601 < 100_000}


def test_lines_take_linear_time(spark):
    rng = random.Random(1)
    boxes = [(i // 50 * 60 + rng.randrange(6), rng.randrange(16, 24)) for i in range(10_000)]
    boxes.sort()
    began = time.process_time()
    lines = evidence.line_numbers([y for y, _ in boxes], [h for _, h in boxes], 0.7)
    assert time.process_time() - began < 0.5 and lines[-1] == 199
    words = spark.createDataFrame([(1, y, i % 700, 5, h, str(i)) for i, (y, h) in enumerate(boxes)], "page int, y int, x int, width int, height int, text string")
    got = evidence.build_lines(words, ["page"]).collect()
    assert sum(len(r.text.split()) for r in got) == 10_000
    assert evidence.build_lines(words.limit(0), ["page"]).count() == 0


def test_regions_by_tiles(spark):
    rng = random.Random(6)
    box = lambda: (rng.randrange(-50, 900), rng.randrange(-50, 900), rng.choice([0, 1, 30, 256, 700]), rng.choice([0, 5, 12, 300]))
    words, regions = [(rng.randrange(3), i, box()) for i in range(300)] + [(0, 999, None)], [(rng.randrange(3), i, box()) for i in range(60)]
    kind = "struct<x: int, y: int, width: int, height: int>"
    got = geometry.in_region(spark.createDataFrame(words, f"page int, w int, bbox {kind}"), spark.createDataFrame(regions, f"page int, r int, region {kind}"), ["page"])
    meet = lambda a, b: a and a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3]
    want = sorted((p, i, j) for p, i, a in words for q, j, b in regions if p == q and meet(a, b))
    assert sorted((r.page, r.w, r.r) for r in got.collect()) == want and len(want) > 200
