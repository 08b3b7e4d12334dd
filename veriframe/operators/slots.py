"""Slots of a record (field, text, page, box) grounded on and reconciled with the words of its pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.text import match_norm, not_stated, strip
from veriframe.operators.grounding import THRESHOLD, best_window

#: Words that a warning has from its first one on, and the prefix that a whole entry may start with. Fixed values.
WARNING_WORDS, WARNING_PREFIX = 70, "GOVERNMENT WARNING:"


def _matched(words: str, match: str = "match") -> Column:
    return F.transform(F.col(f"{match}.words"), lambda i: F.get(words, i))


def union_of(boxes: Column) -> Column:
    """The smallest box around an array of boxes; null of none."""
    edge = lambda f, g: f(F.transform(boxes, g))
    x, y = edge(F.array_min, lambda b: b["x"]), edge(F.array_min, lambda b: b["y"])
    right, bottom = edge(F.array_max, lambda b: b["x"] + b["width"]), edge(F.array_max, lambda b: b["y"] + b["height"])
    return F.when(F.size(boxes) > 0, F.struct(x.alias("x"), y.alias("y"), (right - x).alias("width"), (bottom - y).alias("height")))


def printed(words: str, target: Column, match: str = "match") -> Column:
    """A match as printed: the entry's own text where it is the whole target, and of words that are one token; else the token."""
    w = _matched(words, match)
    own = lambda t: F.get(F.filter(w, lambda x: match_norm(x["text"]) == t), F.lit(0))["text"]
    whole = (F.size(w) == 1) & (match_norm(F.get(w, F.lit(0))["text"]) == match_norm(target))
    return F.when(whole, F.get(w, F.lit(0))["text"]).otherwise(F.array_join(F.transform(F.split(F.col(f"{match}.text"), " "), lambda t: F.coalesce(own(t), t)), " "))


def ground(slots: DataFrame, pages: DataFrame, keys: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """slots (keys, text, page, bbox, bbox_source) with the box of the words found on their page, source ocr; a miss has source model.

    Slots of source ocr with a box stay; a null page is the first. pages: one row per keys and page, with words."""
    p = pages.select(*keys, F.col("page").alias("_page"), F.col("words").alias("_words"))
    on = [slots[k] == p[k] for k in keys] + [F.coalesce(slots["page"], F.lit(1)) == p["_page"]]
    j = slots.join(p, on, "left").select(*[slots[c] for c in slots.columns], "_words")
    j = best_window(j, "_words", "text", threshold, "_match")
    kept = F.coalesce((F.col("bbox_source") == "ocr") & F.col("bbox").isNotNull(), F.lit(False))
    hit = F.col("_match").isNotNull()
    box = union_of(_matched("_words", "_match"))
    return j.withColumns({"bbox": F.when(~kept & hit, box.cast(slots.schema["bbox"].dataType)).otherwise(F.col("bbox")),
                          "bbox_source": F.when(kept | hit, "ocr").otherwise("model")}).drop("_words", "_match")


def locate_declared(expected: DataFrame, pages: DataFrame, keys: Sequence[str], threshold: float = THRESHOLD, whole_lines: bool = False) -> DataFrame:
    """(keys, field, text, page, bbox): where each expected value (keys, field, expected) stands, on the first page that has it.

    Blank values and those that say nothing is stated are not looked for. whole_lines gives the entries' whole texts (statements)."""
    e = expected.filter(~F.coalesce(not_stated(F.col("expected")), F.lit(True)) & (F.col("expected") != "")).select(*keys, "field", "expected")
    j = best_window(e.join(pages.select(*keys, "page", "words"), list(keys)), "words", "expected", threshold).filter("match is not null")
    text = F.array_join(F.transform(_matched("words"), lambda w: w["text"]), " ") if whole_lines else printed("words", F.col("expected"))
    found = j.select(*keys, "field", F.struct(text.alias("text"), "page", union_of(_matched("words")).alias("bbox")).alias("_s"))
    return found.groupBy(*keys, "field").agg(F.min_by("_s", F.col("_s.page")).alias("_s")).select(*keys, "field", "_s.*")


def reconcile_declared(slots: DataFrame, located: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, field, text, page, bbox, model_text, bbox_source): located text replaces a slot's; its earlier text is kept as model_text.

    A model_text from before is carried on, none is kept that equals the located text, and slots that were not located stay."""
    s = slots.select(*keys, "field", F.struct("text", "page", "bbox", "model_text", "bbox_source").alias("_old"))
    j = s.join(located.select(*keys, "field", F.struct("text", "page", "bbox").alias("_new")), [*keys, "field"], "full")
    prior = F.coalesce(F.nullif(strip(F.col("_old.model_text")), F.lit("")), F.nullif(strip(F.col("_old.text")), F.lit("")))
    hit = F.col("_new").isNotNull()
    pick = lambda n: F.when(hit, F.col(f"_new.{n}")).otherwise(F.col(f"_old.{n}")).alias(n)
    model = F.when(~hit, F.col("_old.model_text")).when(prior != F.col("_new.text"), prior)
    return j.select(*keys, "field", pick("text"), pick("page"), pick("bbox"), model.alias("model_text"), F.when(hit, "ocr").otherwise(F.col("_old.bbox_source")).alias("bbox_source"))


def warning_slot(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, text, page, bbox): an entry that starts with the whole prefix, else WARNING_WORDS words from the first that starts a warning.

    The first page in order counts; records without one have no row."""
    norm = lambda w: match_norm(F.coalesce(w["text"], F.lit("")))
    starts = F.transform("words", lambda w: F.contains(norm(w), F.lit("GOVERNMENT WARNING")) | (norm(w) == "GOVERNMENT"))
    at = F.array_position(starts, True).cast("int")
    p = pages.select(*keys, "page", "words", at.alias("_at")).filter("_at > 0")
    first = F.get("words", F.col("_at") - 1)
    whole = F.startswith(F.upper(F.trim(first["text"])), F.lit(WARNING_PREFIX))
    p = p.withColumn("_w", F.when(whole, F.array(first)).otherwise(F.slice("words", F.col("_at"), F.lit(WARNING_WORDS))))
    text = F.trim(F.array_join(F.transform("_w", lambda w: w["text"]), " "))
    best = p.select(*keys, F.struct("page", text.alias("text"), union_of(F.col("_w")).alias("bbox")).alias("_s"))
    return best.groupBy(*keys).agg(F.min_by("_s", F.col("_s.page")).alias("_s")).select(*keys, "_s.text", "_s.page", "_s.bbox")
