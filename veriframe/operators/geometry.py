"""Boxes and pages: turning, scaling and padding boxes, words in regions, nested pages and pools of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.text import normalize
from veriframe.operators.joins import intersects


def _box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def rotate_box(b: Column, page_width: Column, page_height: Column, degrees: int) -> Column:
    """A box read on a page that was turned by 90 or 270 degrees, on the page as it is."""
    if degrees == 90:
        return _box(b["y"], page_height - b["x"] - b["width"], b["height"], b["width"])
    if degrees == 270:
        return _box(page_width - b["y"] - b["height"], b["x"], b["height"], b["width"])
    raise ValueError("degrees must be 90 or 270")


def scale_box(b: Column, factor: Column | float) -> Column:
    n = lambda c: F.round(b[c] * factor).cast("int")
    return _box(n("x"), n("y"), n("width"), n("height"))


def unscale_box(b: Column, left: Column, top: Column, factor: float) -> Column:
    """A box read on a crop that begins at left, top and was enlarged by factor."""
    n = lambda c: F.round(b[c] / factor).cast("int")
    return _box(left + n("x"), top + n("y"), n("width"), n("height"))


def _clamp(c: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(c, low), high)


def bounded_rect(b: Column, page_width: Column, page_height: Column) -> Column:
    """The part of a box on the page, one pixel at least."""
    n = lambda c: b[c].cast("int")
    x, y = F.least(F.greatest(n("x"), F.lit(0)), page_width - 1), F.least(F.greatest(n("y"), F.lit(0)), page_height - 1)
    right, bottom = F.least(F.greatest(n("x") + n("width"), x + 1), page_width), F.least(F.greatest(n("y") + n("height"), y + 1), page_height)
    return _box(x, y, right - x, bottom - y)


def padded_rect(b: Column, image_width: Column, image_height: Column, basis_width: Column, basis_height: Column, padding: float) -> Column:
    """A box measured on a basis, in the image's pixels, wider by padding of its own size on every side and kept on the image. Null for a box without area."""
    sx, sy = image_width / basis_width, image_height / basis_height
    px, py, zero = b["width"] * sx * padding, b["height"] * sy * padding, F.lit(0.0)
    left, top = _clamp(b["x"] * sx - px, zero, image_width - 1.0), _clamp(b["y"] * sy - py, zero, image_height - 1.0)
    right, bottom = _clamp((b["x"] + b["width"]) * sx + px, left + 1, image_width.cast("double")), _clamp((b["y"] + b["height"]) * sy + py, top + 1, image_height.cast("double"))
    return F.when((b["width"] > 0) & (b["height"] > 0) & b["x"].isNotNull() & b["y"].isNotNull(), _box(left, top, right - left, bottom - top))


def page_basis(pages: Column, page: Column, first_width: Column, first_height: Column) -> Column:
    """struct(width, height) that a page's boxes are measured on: of the list pages, or for page 1 the image's own. Null where neither is positive."""
    usable = lambda w, h: (w > 0) & (h > 0)
    pair = lambda w, h: F.struct(w.cast("double").alias("width"), h.cast("double").alias("height"))
    own = F.get(F.filter(pages, lambda p: p["page"] == page), F.lit(0))
    return F.when(usable(own["width"], own["height"]), pair(own["width"], own["height"])).when((page == 1) & usable(first_width, first_height), pair(first_width, first_height))


def _tiled(df: DataFrame, box: str, tile: float) -> DataFrame:
    """df once for every tile that its box touches, as _tx, _ty."""
    at = lambda v: F.floor(v / tile).cast("long")
    b = F.col(box)
    along = lambda low, size: F.sequence(at(low), at(low + F.greatest(size, F.lit(0))))
    return df.withColumn("_tx", F.explode(along(b["x"], b["width"]))).withColumn("_ty", F.explode(along(b["y"], b["height"])))


def in_region(words: DataFrame, regions: DataFrame, keys: Sequence[str], box: str = "bbox", region: str = "region", tile: float = 256.0) -> DataFrame:
    """words with the regions of the same keys (document, page) whose box they share an inner point with: one row for each pair that does.

    Boxes meet by tiles of the page, so that a page of very many words and regions compares those of one tile alone; a pair counts in the tile that
    has the first corner of what they share. tile is a length in the boxes' unit, some words wide. Null boxes meet nothing."""
    b, r = F.col(box), F.col(region)
    met = _tiled(words, box, tile).join(_tiled(regions, region, tile).hint("merge"), [*keys, "_tx", "_ty"]).filter(intersects(b, r))
    corner = lambda side: F.floor(F.greatest(b[side], r[side]) / tile).cast("long")
    return met.filter((F.col("_tx") == corner("x")) & (F.col("_ty") == corner("y"))).drop("_tx", "_ty")


def explode_words(pages: DataFrame, keys: Sequence[str], pages_col: str = "pages") -> DataFrame:
    """(keys, page, page_width, page_height, pos, word columns) of nested pages struct(number, width, height, words). Pages without words have no row."""
    p = pages.select(*keys, F.explode(pages_col).alias("_p"))
    w = p.select(*keys, F.col("_p.number").alias("page"), F.col("_p.width").alias("page_width"), F.col("_p.height").alias("page_height"), F.posexplode("_p.words").alias("pos", "_w"))
    return w.select(*keys, "page", "page_width", "page_height", "pos", "_w.*")


def pack_pages(words: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("text", "x", "y", "width", "height", "confidence"), pages_col: str = "pages") -> DataFrame:
    """explode_words turned round: pages in the order of their numbers, words in that of pos."""
    one = words.groupBy(*keys, "page", "page_width", "page_height").agg(F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("_w"))
    page = F.struct(F.col("page").alias("number"), F.col("page_width").alias("width"), F.col("page_height").alias("height"), F.transform("_w", lambda w: F.struct(*[w[c].alias(c) for c in columns])).alias("words"))
    return one.groupBy(*keys).agg(F.sort_array(F.collect_list(page)).alias(pages_col))


def merge_pools(base: DataFrame, extra: DataFrame, keys: Sequence[str], page: str = "page") -> DataFrame:
    """Words of both readings, each (page, normalised text, box) once, the base's before the extra's, with their place in reading order (y, x, text)."""
    from pyspark.sql import Window as W

    both = base.withColumn("_from", F.lit(0)).unionByName(extra.withColumn("_from", F.lit(1))).withColumn("_n", normalize(F.col("text")))
    same = [*keys, page, "_n", "x", "y", "width", "height"]
    rest = [c for c in both.columns if c not in same]
    once = both.groupBy(*same).agg(F.min_by(F.struct(*rest), F.struct("_from", "text")).alias("_r")).select(*same, "_r.*")
    return once.withColumn("pos", F.row_number().over(W.partitionBy(*keys, page).orderBy("y", "x", "text"))).drop("_n", "_from")


def page_sizes(lines: DataFrame, keys: Sequence[str], text_col: str = "value") -> DataFrame:
    """(keys, page, width, height) of word TSV lines: the lines of level 1 are pages."""
    f = lines.select(*keys, F.split(text_col, "\t", -1).alias("f")).filter(F.size("f") >= 12)
    num = lambda k: F.get("f", F.lit(k)).try_cast("int")
    return f.filter(num(0) == 1).groupBy(*keys, num(1).alias("page")).agg(F.max(num(8)).alias("width"), F.max(num(9)).alias("height"))
