"""Grounding of declared texts on a page's words: windows by size in characters, fused and gapped matches.

A page's words are one array column (a sheet of paper bounds it), so records stay rows and nothing is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.text import match_norm, similarity

# Fixed values.
SIZE_SLACK, THRESHOLD = 0.3, 0.8
PREFILTER_TOKENS, PREFILTER_OVERLAP = 8, 0.5
FUSED_LEAST_LENGTH, FUSED_LEAST_SHARE = 3, 0.3
GAP_FACTOR = 3

MATCH = "struct<start:int,stop:int,text:string,score:double,words:array<int>,fused:boolean>"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(match_norm(text), " "), lambda x: x != "")


def _overlap(window: Column, goal: Column) -> Column:
    """Share of goal's tokens in window, both as multisets."""
    times = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    common = F.aggregate(F.array_distinct(goal), F.lit(0), lambda n, w: n + F.least(times(window, w), times(goal, w)))
    return common / F.size(goal)


def _scored(df: DataFrame, words: str, target: str) -> DataFrame:
    """Adds _goal (tokens), _t (token, word), _best: (score, back, less) of every window of fitting size; rows without any have an empty array."""
    df = df.withColumn("_goal", _tokens(F.coalesce(F.col(target), F.lit("")))).withColumn("_flat", F.array_join("_goal", ""))
    flat = F.flatten(F.transform(F.col(words), lambda w, i: F.transform(_tokens(F.coalesce(w["text"], F.lit(""))), lambda x: F.struct(x.alias("token"), i.alias("word")))))
    df = df.withColumn("_t", F.coalesce(flat, F.array().cast("array<struct<token:string,word:int>>")))
    size = F.length("_flat")
    sums = F.aggregate("_t", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x["token"]))))
    df = df.withColumns({"_sums": sums, "_low": F.floor(size * (1 - SIZE_SLACK)).cast("int"), "_high": F.ceil(size * (1 + SIZE_SLACK)).cast("int"), "_n": F.size("_t")})

    def stops(s: Column) -> Column:
        ends = F.sequence(s, F.greatest(s, F.least(F.col("_n"), s + F.col("_high") - 1)))
        long = lambda e: F.get("_sums", e) - F.get("_sums", s - 1)
        return F.transform(F.filter(ends, lambda e: long(e).between(F.col("_low"), F.col("_high"))), lambda e: F.struct(s.alias("s"), e.alias("e")))

    none = F.array().cast("array<struct<s:int,e:int>>")
    spans = F.when((F.col("_n") > 0) & (size > 0), F.flatten(F.transform(F.sequence(F.lit(1), F.greatest("_n", F.lit(1))), stops))).otherwise(none)
    of = lambda x: F.transform(F.slice("_t", x["s"], x["e"] - x["s"] + 1), lambda y: y["token"])
    enough = lambda x: (F.size("_goal") <= PREFILTER_TOKENS) | (_overlap(of(x), F.col("_goal")) >= PREFILTER_OVERLAP)
    scored = F.transform(F.filter(spans, enough), lambda x: F.struct(similarity(F.array_join(of(x), ""), F.col("_flat")).alias("score"), (-x["s"]).alias("back"), (-x["e"]).alias("less")))
    return df.withColumn("_best", scored)


_HELPERS = ("_goal", "_flat", "_t", "_sums", "_low", "_high", "_n", "_best", "_top")


def best_window(df: DataFrame, words: str, target: str, threshold: float = THRESHOLD, out: str = "match") -> DataFrame:
    """Adds out: the window of words (structs with a text) most like target, at least by threshold; of equals the earliest, then shortest.

    Windows hold SIZE_SLACK less to more characters than the target. Without one, a longer token that holds the whole
    target counts (fused), the shortest first. Null words, targets or pages give null."""
    df = _scored(df, words, target).withColumn("_top", F.array_max("_best"))
    first, last = -F.col("_top.back"), -F.col("_top.less")
    part = F.slice("_t", first, last - first + 1)
    window = F.struct(first.alias("start"), last.alias("stop"), F.array_join(F.transform(part, lambda x: x["token"]), " ").alias("text"), F.col("_top.score").alias("score"),
                      F.array_distinct(F.transform(part, lambda x: x["word"])).alias("words"), F.lit(False).alias("fused"))
    size = F.length("_flat")
    holds = lambda x: (F.length(x["token"]) > size) & F.contains(x["token"], F.col("_flat")) & (size / F.length(x["token"]) >= FUSED_LEAST_SHARE)
    hosts = F.transform("_t", lambda x, i: F.when(holds(x), F.struct(F.length(x["token"]).alias("n"), (i + 1).alias("at"), x["word"].alias("word"))))
    host = F.array_min(F.filter(hosts, lambda h: h.isNotNull()))
    fused = F.struct(host["at"].alias("start"), host["at"].alias("stop"), F.col("_flat").alias("text"), F.lit(1.0).alias("score"), F.array(host["word"]).alias("words"), F.lit(True).alias("fused"))
    found = F.when(F.col("_top.score") >= threshold, window.cast(MATCH)).when((size >= FUSED_LEAST_LENGTH) & host.isNotNull(), fused.cast(MATCH))
    return df.withColumn(out, found).drop(*_HELPERS)


def explain(df: DataFrame, words: str, target: str, n: int = 5) -> DataFrame:
    """One row per candidate: the n best windows with their scores, whatever the threshold; records without windows have no row."""
    df = _scored(df, words, target)
    top = df.withColumn("_top", F.slice(F.sort_array("_best", asc=False), 1, n))
    rows = top.select("*", F.posexplode("_top").alias("_rank", "_c"))
    text = F.array_join(F.transform(F.slice("_t", -F.col("_c.back"), F.col("_c.back") - F.col("_c.less") + 1), lambda x: x["token"]), " ")
    return rows.withColumns({"rank": F.col("_rank") + 1, "start": -F.col("_c.back"), "stop": -F.col("_c.less"), "score": F.col("_c.score"), "text": text}).drop(*_HELPERS, "_rank", "_c")


def gapped_match(df: DataFrame, words: str, target: str, threshold: float = THRESHOLD, out: str = "match") -> DataFrame:
    """best_window over the words that share a token with target, where each next box stands near (boxes: x, y, width, height).

    Null where fewer than two words, or all of them, share a token."""
    goal = _tokens(F.coalesce(F.col(target), F.lit("")))
    near = F.filter(F.col(words), lambda w: F.arrays_overlap(_tokens(F.coalesce(w["text"], F.lit(""))), goal))
    df = df.withColumn("_near", near)
    df = df.withColumn("_near", F.when((F.size("_near") >= 2) & (F.size("_near") < F.size(words)), F.col("_near")))
    df = best_window(df, "_near", target, threshold, "_found")
    box = F.transform("_found.words", lambda i: F.get("_near", i))

    def close(a: Column, b: Column) -> Column:
        dx = (a["x"] + a["width"] / 2) - (b["x"] + b["width"] / 2)
        dy = (a["y"] + a["height"] / 2) - (b["y"] + b["height"] / 2)
        return F.sqrt(dx * dx + dy * dy) <= F.greatest(a["width"], a["height"], b["width"], b["height"]) * GAP_FACTOR

    df = df.withColumn("_box", box)
    ok = F.forall(F.transform("_box", lambda b, i: (i == 0) | close(F.get("_box", F.greatest(i - 1, F.lit(0))), b)), lambda x: x)
    return df.withColumn(out, F.when(ok, F.col("_found"))).drop("_near", "_found", "_box")


def missing_expected(expected: DataFrame, pages: DataFrame, keys: Sequence[str], target: str, words: str, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of expected (several to a record) that no page of the record has; records without pages miss all. One shuffle, on keys."""
    e = expected.filter(F.trim(target) != "")
    found = best_window(e.select(*keys, target).join(pages.select(*keys, words), list(keys)), words, target, threshold)
    return e.join(found.filter("match is not null").select(*keys, target).distinct(), [*keys, target], "left_anti")


def merge_adjudications(results: DataFrame, keys: Sequence[str], field: str, status: str, page: str) -> DataFrame:
    """One result per record and field: present before ambiguous before the first page's."""
    rank = F.when(F.col(status) == "present", 0).when(F.col(status) == "ambiguous", 1).otherwise(2)
    rest = [c for c in results.columns if c not in {*keys, field}]
    best = F.min_by(F.struct(*rest), F.struct(rank, F.col(page)))
    return results.groupBy(*keys, field).agg(best.alias("_r")).select(*keys, field, "_r.*")


def combine_artwork_pages(pages: DataFrame, keys: Sequence[str], slot: str, page: str) -> DataFrame:
    """pages with page numbered through a record's artworks, in order of slot (the window runs over one row per artwork)."""
    from pyspark.sql import Window

    counts = pages.groupBy(*keys, slot).agg(F.max(page).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select(*keys, slot, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return pages.join(offset.hint("merge"), [*keys, slot]).withColumn(page, F.col(page) + F.col("_offset")).drop("_offset")
