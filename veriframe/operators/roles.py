"""Which attachment is a record's front and which its back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
FRONT_WORDS = ("front", "frt", "brand", "face", "collar")
BACK_WORDS = ("back", "bck", "rear", "retro")
SHORT_BACK_WORDS = ("bk",)
IMAGE = r"(?i)\.(jpe?g|png|webp)$"
FILENAME_WEIGHT, METADATA_WEIGHT = 3, 2


def _says(text: Column, words: Sequence[str], tokens: Sequence[str] = ()) -> Column:
    t = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "), F.lit(" "))
    out = F.lit(False)
    for w in (*words, *(f" {x} " for x in tokens)):
        out = out | F.contains(t, F.lit(w))
    return out


def role(text: Column) -> Column:
    """front or back, null where the text says neither or both."""
    front, back = _says(text, FRONT_WORDS), _says(text, BACK_WORDS, SHORT_BACK_WORDS)
    return F.when(front & ~back, "front").when(back & ~front, "back")


def role_scores(filename: Column, image_type: Column) -> tuple[Column, Column]:
    """(front, back): the name's words weigh FILENAME_WEIGHT, an unambiguous image type METADATA_WEIGHT."""
    meta = role(image_type)
    points = lambda says, n: F.when(says, n).otherwise(0)
    front = points(_says(filename, FRONT_WORDS), FILENAME_WEIGHT) + points(meta == "front", METADATA_WEIGHT)
    back = points(_says(filename, BACK_WORDS), FILENAME_WEIGHT) + points(_says(filename, (), SHORT_BACK_WORDS), FILENAME_WEIGHT) + points(meta == "back", METADATA_WEIGHT)
    return front, back


def role_conflict(filename: Column, image_type: Column) -> Column:
    return F.coalesce(role(filename) != role(image_type), F.lit(False))


def pick_front_back(attachments: DataFrame, keys: Sequence[str], index: str, filename: str, image_type: str) -> DataFrame:
    """(keys, front, back): file names. The front scores most for front over back (the first image if none says anything);
    the back is the best of the others, if it scores more for back. Only images count; records without any have no row."""
    f, b = role_scores(F.col(filename), F.col(image_type))
    a = attachments.filter(F.col(filename).rlike(IMAGE)).select(*keys, F.col(index).alias("_i"), F.col(filename).alias("_name"), f.alias("_f"), b.alias("_b"))
    some = (F.col("_f") > 0) | (F.col("_b") > 0)
    front_order = F.struct(some.cast("int"), F.col("_f") - F.col("_b"), F.col("_f"), -F.col("_i"))
    front = a.groupBy(*keys).agg(F.max_by(F.struct("_i", "_name"), front_order).alias("_front"))
    back_order = F.struct(F.col("_b") - F.col("_f"), F.col("_b"), -F.col("_i"))
    rest = a.join(front.hint("merge"), list(keys)).filter("_i <> _front._i and _b > _f")
    back = rest.groupBy(*keys).agg(F.max_by("_name", back_order).alias("back"))
    return front.join(back.hint("merge"), list(keys), "left").select(*keys, F.col("_front._name").alias("front"), "back")


def swapped_slots(records: DataFrame, front: str = "front", back: str = "back") -> DataFrame:
    """Records whose stored front file is the back and whose back file is the front, by name alone; no shuffle."""
    ff, fb = role_scores(F.col(front), F.lit(None).cast("string"))
    bf, bb = role_scores(F.col(back), F.lit(None).cast("string"))
    images = F.col(front).rlike(IMAGE) & F.col(back).rlike(IMAGE)
    # the second file is the front if it leads, or if only the first one says anything and says back
    first_says, second_says = (ff > 0) | (fb > 0), (bf > 0) | (bb > 0)
    leads = second_says & (~first_says | (bf - bb > ff - fb) | ((bf - bb == ff - fb) & (bf > ff)))
    return records.filter(images & leads & (fb > ff))


def repair_slots(records: DataFrame, key: str, front: str = "front", back: str = "back") -> DataFrame:
    """records with swapped files put right; keys are unique."""
    ids = swapped_slots(records, front, back).select(key, F.lit(True).alias("_swap"))
    j = records.join(ids, key, "left")
    swap = F.coalesce("_swap", F.lit(False))
    return j.withColumns({front: F.when(swap, F.col(back)).otherwise(F.col(front)), back: F.when(swap, F.col(front)).otherwise(F.col(back))}).drop("_swap")
