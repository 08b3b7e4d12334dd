"""Words and boxes: line building, spans and matching of declared values."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A span's letters may be this share of the target's, from and to.
SPAN_SHORT, SPAN_LONG = 0.65, 1.35


def clean_words(words: DataFrame) -> DataFrame:
    """Drops blank texts and boxes without area; a negative confidence is null."""
    ok = (F.trim("text") != "") & (F.col("width") > 0) & (F.col("height") > 0)
    return words.filter(ok).withColumn("confidence", F.when(F.col("confidence") >= 0, F.col("confidence")))


def line_numbers(y: list, height: list, share: float) -> list[int]:
    """The line of each word, in reading order: a word joins the line whose box centre is within share of the taller height, and the line's box grows by it.

    share is taken as written (0.7 of 45 is 31.5, not the 31.499... of doubles), so that boxes of whole pixels are compared exactly."""
    out, line, top, bottom = [], -1, 0.0, 0.0
    part = Fraction(str(share))
    for t, h in zip(y, height):
        if line < 0 or abs((top + bottom) / 2 - (t + h / 2)) * part.denominator > part.numerator * max(h, bottom - top):
            line, top, bottom = line + 1, t, t + h
        else:
            top, bottom = min(top, t), max(bottom, t + h)
        out.append(line)
    return out


def build_lines(words: DataFrame, keys: list[str], share: float = 0.7) -> DataFrame:
    """(keys, line, text, x, y, width, height): lines of each page of words in reading order (y, x).

    Which line a word is in depends on all before it, so a page is one array, gone through once in Arrow batches; lines are put together by Spark. Pages are bounded by what one sheet holds."""
    pages = words.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("y", "x", "width", "height", "text"))).alias("w"))

    def numbers(tops: pd.Series, heights: pd.Series) -> pd.Series:
        return pd.Series([line_numbers(t, h, share) for t, h in zip(tops, heights)])

    field = lambda c: F.transform("w", lambda w: w[c].cast("double"))
    pages = pages.withColumn("n", F.pandas_udf(numbers, "array<int>")(field("y"), field("height")))
    each = pages.select(*keys, F.posexplode(F.arrays_zip("w", "n")).alias("at", "z")).select(*keys, "at", F.col("z.n").alias("line"), "z.w.*")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ")
    left, top = F.min("x").cast("long"), F.min("y").cast("long")
    return each.groupBy(*keys, "line").agg(text.alias("text"), left.alias("x"), top.alias("y"), (F.max(F.col("x") + F.col("width")).cast("long") - left).alias("width"), (F.max(F.col("y") + F.col("height")).cast("long") - top).alias("height"))


def score_span(span: Column, target: Column) -> Column:
    """1 equal, 0.95 contained, else 1 - edits / longer length (texts already normalised)."""
    longest = F.greatest(F.length(span), F.length(target))
    return F.when(span == target, 1.0).when(F.contains(span, target) | F.contains(target, span) & (F.length(span) * 5 >= F.length(target)), 0.95).otherwise(1 - F.levenshtein(span, target) / longest)


def locate(df: DataFrame, tokens: str, target: str, threshold: float = 0.8) -> DataFrame:
    """Adds match (start, n, text, score): the best span of consecutive tokens for the target, null below threshold.

    Spans are made from their lengths before any edit distance is taken; ties go to the earlier, then shorter span."""
    t, goal = F.col(tokens), F.col(target)
    low, high = F.floor(F.length(goal) * SPAN_SHORT), F.ceil(F.length(goal) * SPAN_LONG)
    starts = F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1)))
    counts = F.sequence(F.lit(1), F.greatest(F.least(F.size(t), high.cast("int") + 1), F.lit(1)))
    spans = F.flatten(F.transform(starts, lambda s: F.transform(F.filter(counts, lambda n: s + n - 1 <= F.size(t)), lambda n: F.struct(s.alias("start"), n.alias("n"), F.array_join(F.slice(t, s, n), " ").alias("text")))))
    fits = F.filter(spans, lambda x: (F.length(x["text"]) >= low) & (F.length(x["text"]) <= high))
    scored = F.transform(fits, lambda x: F.struct(score_span(x["text"], goal).alias("score"), (-x["start"]).alias("back"), (-x["n"]).alias("less"), x["text"].alias("text")))
    best = F.array_max(scored)
    return df.withColumn("match", F.when(best["score"] >= threshold, F.struct((-best["back"]).alias("start"), (-best["less"]).alias("n"), best["text"].alias("text"), best["score"].alias("score"))))


def first_window(tokens: Column, most: int, pattern: str) -> Column:
    """The first window of 1..most tokens whose text has the pattern: shorter windows first, then earlier ones."""
    n = F.size(tokens)
    wins = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda s: s + k - 1 <= n), lambda s: F.array_join(F.slice(tokens, s, k), " "))))
    return F.get(F.filter(wins, lambda w: w.rlike(pattern)), F.lit(0))


def weak_evidence(words: DataFrame, keys: list[str], least_words: int = 8, least_confidence: float = 0.6, place: str | None = None) -> DataFrame:
    """(keys, n, confidence) of the pages with few words or a low mean confidence.

    Doubles added up in another order may end in another last digit, which decides on pages whose mean is the least one. With place, a page's words are added up in its order,
    however the rows are dealt to tasks; a page is one array then, bounded by what one sheet holds."""
    if place is None:
        mean = F.avg("confidence")
    else:
        seen = F.sort_array(F.collect_list(F.when(F.col("confidence").isNotNull(), F.struct(place, F.col("confidence").cast("double").alias("confidence")))))
        mean = F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda a, w: a + w["confidence"]) / F.size(seen))
    g = words.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(mean, F.lit(0.0)).alias("confidence"))
    return g.filter((F.col("n") < least_words) | (F.col("confidence") < least_confidence))
