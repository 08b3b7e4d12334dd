"""Spans of words that may be a declared value: opened around anchors, scored and ranked."""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriframe.functions.text import join_hyphens, normalize

#: Slack of a span's length, least length and share of a target inside a longer span, when a text is long, what of a long
#: target's words a span must have, and the most that words alone can score.
SLACK, CONTAINED_LENGTH, CONTAINED_SHARE = 0.35, 3, 0.2
LONG_LENGTH, LONG_TOKENS, LONG_RECALL, MOST_BY_TOKENS = 120, 8, 0.25, 0.94
#: Scores are ranked after rounding to this many digits.
DIGITS = 4


def _parts(n: Column) -> Column:
    """A normalised text (n) with its compact text (c), its distinct words (w) and whether it is long."""
    words, compact = F.filter(F.split(n, " "), lambda x: x != ""), F.replace(n, F.lit(" "))
    return F.struct(n.alias("n"), compact.alias("c"), F.array_distinct(words).alias("w"), ((F.length(compact) >= LONG_LENGTH) | (F.size(words) >= LONG_TOKENS)).alias("long"))


def contained(span: Column, target: Column) -> Column:
    """Compact texts: the target stands in the span and is no small part of it."""
    return (F.length(target) >= CONTAINED_LENGTH) & F.contains(span, target) & (F.length(target) >= CONTAINED_SHARE * F.length(span))


def score(span: Column, target: Column) -> Column:
    """_parts of both. 1 equal; 0.95 contained; long texts by the F1 of their words; else 1 - edits / longer length."""
    by_tokens = F.least(2.0 * F.size(F.array_intersect(span["w"], target["w"])) / (F.size(span["w"]) + F.size(target["w"])), F.lit(MOST_BY_TOKENS))
    edits = 1.0 - F.levenshtein(target["c"], span["c"]) / F.greatest(F.length(target["c"]), F.length(span["c"]))
    return F.when(span["c"] == target["c"], 1.0).when(contained(span["c"], target["c"]), 0.95).when(span["c"] == "", 0.0).when(span["long"] | target["long"], by_tokens).otherwise(edits)


def _next(places: list[tuple[int, int]], size: int) -> list[int]:
    """For every place 0..size the least end among the (start, end) that start there or later; size + 1 where there is none."""
    out = [size + 1] * (size + 2)
    if not places:
        return out
    for start, end in places:
        out[start] = min(out[start], end)
    for i in range(size, -1, -1):
        out[i] = min(out[i], out[i + 1])
    return out


def _found(text: str, part: str) -> list[tuple[int, int]]:
    at, out = text.find(part), []
    while at >= 0:
        out.append((at, at + len(part)))
        at = text.find(part, at + 1)
    return out


def _words(text: str) -> list[str]:
    return [w for w in text.split(" ") if w]


def _leading(found: list[tuple[int, int, float, float]], place: list[int], text: str, threshold: float, limit: int) -> list[tuple[int, int]]:
    """(first, last) of the spans found, with bounds of their scores, without those that limit spans of other texts surely beat by more than the rounding of scores."""
    seen, cut = set(), -math.inf
    for s, e, low, _ in sorted(found, key=lambda x: -x[2]):
        if low < threshold:
            break
        seen.add(text[place[s] : place[e + 1]])
        if len(seen) == limit:
            cut = low - 1.01 * 10**-DIGITS
            break
    return [(s, e) for s, e, _, high in found if high >= cut]


def anchored_spans(items: list[str], breaks: list[int], target: str, threshold: float, limit: int | None = None, glued: list[bool] | None = None) -> list[tuple[int, int]]:
    """(first, last) of the spans of items that can reach the threshold for target; with limit, of those that can be among the best limit ones. Every text is normalised.

    Two pointers carry the lengths. A span is opened only around an anchor: the whole target; enough of the target's words (one, or a quarter
    of a long target's, and as many as the score by words needs); and, where edits count, one of the k + 1 parts of the target of which k edits must leave one untouched.
    breaks: words of each item that a repaired hyphen may still join, by which the count of common words can fall short; glued: items whose first word the hyphen
    before surely joins to the last one. Any other break makes one word of two, so that it changes the common words by two at most. So the score by words has
    bounds here, mostly its value; a whole or contained target's is known."""
    goal_words, goal = _words(target), target.replace(" ", "")
    wanted = set(goal_words)
    compact = [x.replace(" ", "") for x in items]
    tokens = [_words(x) for x in items]
    n, size = len(items), len(goal)
    low, high = int(size * (1 - SLACK)), math.ceil(size * (1 + SLACK))
    long_ = size >= LONG_LENGTH or len(goal_words) >= LONG_TOKENS
    place = [0, *itertools.accumulate(map(len, compact))]
    text = "".join(compact)
    whole = _next(_found(text, goal), len(text)) if size >= CONTAINED_LENGTH else None
    few = max(1, math.ceil(LONG_RECALL * len(wanted))) if long_ else 1 if len(goal_words) >= 2 else 0
    k = int((1 - threshold) * max(size, high) + 1e-9)
    parts = None
    if not long_ and k + 1 <= size:
        cut = [size * i // (k + 1) for i in range(k + 2)]
        parts = _next([x for i, j in zip(cut, cut[1:]) for x in _found(text, goal[i:j])], len(text))
    # by words alone: 2 * common / (words of both) is to reach the threshold, and common is what the span has of wanted
    by_words = threshold <= MOST_BY_TOKENS
    hits = [[w for w in ws if w in wanted] for ws in tokens]
    if whole is None and few and sum(map(len, hits)) < few:
        return []
    if whole is not None and whole[0] > len(text) and (sum(map(len, hits)) < few if few else parts is not None and parts[0] > len(text) and sum(map(len, tokens)) < LONG_TOKENS):
        return []
    out = []
    hyphens = glued is not None and any(glued)
    for s in range(n):
        begin = place[s]
        first = bisect.bisect_left(place, begin + low, s + 1) - 1  # no span that ends before has letters enough
        if first >= n:
            break
        common, said, loose, words = set().union(*hits[s:first]), set().union(*tokens[s:first]), sum(breaks[s:first]), sum(map(len, tokens[s:first]))
        joined, sure, last = {}, 0, ""
        for e in range(s if hyphens else first, n):
            if hyphens:
                new = tokens[e]
                if e > s and glued[e]:
                    sure += 1
                    joined[last] -= 1
                    if not joined[last]:
                        del joined[last]
                    new = [last + new[0], *new[1:]]
                for w in new:
                    joined[w] = joined.get(w, 0) + 1
                    last = w
            if e < first:
                continue
            length = place[e + 1] - begin
            common.update(hits[e])
            said.update(tokens[e])
            loose += breaks[e]
            words += len(tokens[e])
            inside = whole is not None and whole[begin] <= place[e + 1] and size >= CONTAINED_SHARE * length
            if length > high and not inside:
                break
            if inside:
                out.append((s, e, 1.0, 1.0) if length == size else (s, e, 0.95, 0.95))
            elif length >= low and len(common) >= few:
                maybe_long = long_ or length >= LONG_LENGTH or words >= LONG_TOKENS
                by_edits = not long_ and words - loose < LONG_TOKENS and length < LONG_LENGTH
                same, of, open_ = (len(wanted & joined.keys()), len(joined), loose - sure) if hyphens else (len(common), len(said), loose)
                best = 2 * (same + open_) / (max(1, of - 2 * open_) + len(wanted))
                if maybe_long and by_words and best >= threshold - 1e-9:
                    least = 2 * max(0, same - 2 * open_) / (of + open_ + len(wanted))
                    out.append((s, e, 0.0, 1.0) if by_edits else (s, e, min(least, MOST_BY_TOKENS), min(best, MOST_BY_TOKENS)))
                elif by_edits and (parts is None or parts[begin] <= place[e + 1]):
                    out.append((s, e, 0.0, 1.0))
    return [(s, e) for s, e, _, _ in out] if limit is None else _leading(out, place, text, threshold, limit)


def find(pages: DataFrame, keys: Sequence[str], page: str, sequences: Sequence[str], target: str, threshold: float = 0.8, limit: int = 5) -> DataFrame:
    """(keys, page, text, score, confidence, x, y, width, height, rank): the best limit spans of each key for its target.

    sequences: columns of arrays of struct(text, x, y, width, height, confidence) in reading order, words or lines; the first is also read backward.
    Texts are normalised once per item; anchored_spans says in Arrow batches which spans are worth a score, and Spark scores and ranks those. A page
    stays in its row, and is searched where that is: small files with many pages want a repartition before. Equal (page, text, box) are one match. A blank target or a page without words gives no row."""
    item = lambda w: F.struct(*[w[c].alias(c) for c in ("text", "x", "y", "width", "height", "confidence")], normalize(w["text"]).alias("n"))
    order = F.array(*[F.struct(F.transform(s, item).alias("w")) for s in sequences])
    rows = pages.select(*keys, page, F.transform(F.array(normalize(F.col(target))), _parts)[0].alias("_t"), order.alias("_all")).filter("_t.c <> ''")
    rows = rows.select(*keys, page, "_t", F.explode(F.concat("_all", F.array(F.struct(F.reverse(F.col("_all")[0]["w"]).alias("w"))))).alias("_o")).select(*keys, page, "_t", F.col("_o.w").alias("_w")).filter("size(_w) > 0")

    def spans(items: pd.Series, breaks: pd.Series, glued: pd.Series, goals: pd.Series) -> pd.Series:
        return pd.Series([[{"s": s, "e": e} for s, e in anchored_spans(list(i), list(b), g, threshold, limit, list(j))] for i, b, j, g in zip(items, breaks, glued, goals)])

    names, breaks = F.transform("_w", lambda w: F.coalesce(w["n"], F.lit(""))), F.transform("_w", lambda w: F.coalesce(F.regexp_count(w["text"], F.lit(r"-(\s|$)")), F.lit(0)))
    glued = F.transform("_w", lambda w, i: F.coalesce(F.get(F.col("_w"), i - 1)["text"].rlike(r"[A-Za-z0-9]-\z") & w["text"].rlike("^[A-Za-z0-9]"), F.lit(False)))
    rows = rows.withColumn("_s", F.explode(F.pandas_udf(spans, "array<struct<s: int, e: int>>")(names, breaks, glued, "_t.n")))
    one = rows.select(*keys, page, "_t", F.slice("_w", F.col("_s.s") + 1, F.col("_s.e") - F.col("_s.s") + 1).alias("_i"))
    # lambdas name values that are worked out once; a filter on columns would be pushed down with a copy of all they are made of, for each time it names them
    said = F.transform(F.array(join_hyphens(F.array_join(F.transform("_i", lambda w: w["text"]), " "))), lambda x: F.struct(x.alias("text"), normalize(x).alias("n")))
    said = F.transform(said, lambda x: F.struct(x["text"].alias("text"), _parts(x["n"]).alias("p")))
    said = F.transform(said, lambda x: F.struct(x["text"].alias("text"), score(x["p"], F.col("_t")).alias("score")))
    scored = one.withColumn("_r", F.explode(F.filter(said, lambda x: x["score"] >= threshold))).select(*keys, page, "_i", "_r.text", F.round("_r.score", DIGITS).alias("score"))
    edge = lambda f, c: f(F.transform("_i", c))
    left, top = edge(F.array_min, lambda w: w["x"]), edge(F.array_min, lambda w: w["y"])
    seen = F.filter(F.transform("_i", lambda w: w["confidence"]), lambda c: c.isNotNull())
    mean = F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda a, c: a + c) / F.size(seen))
    boxed = scored.select(*keys, page, "text", "score", mean.alias("confidence"), left.alias("x"), top.alias("y"), (edge(F.array_max, lambda w: w["x"] + w["width"]) - left).alias("width"), (edge(F.array_max, lambda w: w["y"] + w["height"]) - top).alias("height"))
    best = boxed.groupBy(*keys, page, "text", "x", "y", "width", "height").agg(F.max("score").alias("score"), F.max("confidence").alias("confidence"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("score").desc(), page, "y", "x", "width", "text")))
    return ranked.filter(F.col("rank") <= limit)
