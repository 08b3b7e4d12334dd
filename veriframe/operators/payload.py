"""Slots that are read from a record's pages alone or with what it declares, and the whole of them as one table.

Pages are one row per record and page, with words (text, x, y, width, height) as an array, which a sheet of paper bounds;
located slots are (keys, field, text, page, bbox), from the first page that has them. Work is per row but for one
reduction on the keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions import parsers as P
from veriframe.functions.text import equivalent, match_norm, normalize, presence, strip
from veriframe.operators.grounding import THRESHOLD, best_window
from veriframe.operators.slots import locate_declared, reconcile_declared, union_of, warning_slot
from veriframe.plans import catalogue as K

# Fixed values.
ALCOHOL_WORDS, NET_CONTENTS_WORDS, COMMODITY_WORDS, DISCLOSURE_WORDS, CLASS_WORDS = 12, 8, 12, 8, 6
NET_CONTENTS_BLOCKS = r"(?i)\b(serving|container|calories|carbohydrates?|protein|sugar|fat|nutrition)\b"
CLASS_BLOCKS = r"(?i)\b(government|warning|surgeon|calories|serving|alc|vol|ml|oz|proof)\b"
COMMODITY_PHRASES = ("neutral spirits", "distilled from")
DISCLOSURE_WORDS_OF = {"sulfites": ("sulfite", "sulfiting", "sulphite"), "fd_c_yellow_5": ("yellow",), "saccharin": ("saccharin",), "aspartame": ("phenylketonurics", "phenylalanine", "aspartame"),
                       "cochineal_carmine": ("cochineal", "carmine"), "coloring": ("colored", "color"), "wood_treatment": ("wood",)}
DISCLOSURES_OF = {"malt": ("sulfites", "fd_c_yellow_5", "aspartame", "saccharin", "cochineal_carmine"), "wine": ("sulfites", "fd_c_yellow_5", "cochineal_carmine"),
                  "spirits": ("sulfites", "fd_c_yellow_5", "saccharin", "cochineal_carmine", "coloring", "wood_treatment")}
VERBS = ("BOTTLED", "PRODUCED", "IMPORTED", "BREWED", "DISTILLED", "VINTED", "BLENDED", "CANNED", "PACKED", "FILLED", "MANUFACTURED", "MADE", "PREPARED")
SPLIT_TOKENS, SPLIT_HEIGHT, LINE_SHARE, CONTINUED, CONTINUED_GAP = (3, 8), 0.35, 0.7, 2, 1.5
WITH_TEXT, WITHOUT_TEXT = 0.75, 0.0
#: Slot -> declared column, for values that labels print as they are.
DECLARED_FIELDS = {"brand_name": "brand_name", "fanciful_name": "fanciful_name", "appellation": "appellation", "vintage": "vintage_year", "net_contents": "net_contents"}

LOCATED = ("text", "page", "bbox")


def _text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def _upper_tokens(text: Column) -> Column:
    return F.filter(F.split(match_norm(F.coalesce(text, F.lit(""))), " "), lambda x: x != "")


def _first_page(df: DataFrame, keys: Sequence[str], words: str) -> DataFrame:
    """(keys, text, page, bbox) of the words found, from the first page that has some."""
    s = df.filter(F.size(words) > 0).select(*keys, F.struct("page", _text(F.col(words)).alias("text"), union_of(F.col(words)).alias("bbox")).alias("_s"))
    return s.groupBy(*keys).agg(F.min_by("_s", F.col("_s.page")).alias("_s")).select(*keys, *[f"_s.{n}" for n in LOCATED])


def first_statement(pages: DataFrame, keys: Sequence[str], most: int, says: Callable[[Column, Column], Column], longest_first: bool = False) -> DataFrame:
    """(keys, text, page, bbox): the first window of at most so many words for which says(text, words) holds.

    Shorter windows come before longer ones (or after them), earlier before later. A length is only looked at where
    the ones before it had none. Pages without words have none."""
    def of(k: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size("words") - k + 1)
        return F.get(F.filter(F.transform(starts, lambda s: F.slice("words", s, k)), lambda w: says(_text(w), w)), F.lit(0))

    lengths = F.sequence(F.lit(1), F.least(F.lit(most), F.size("words")))
    p = pages.filter(F.size("words") > 0)
    none = F.lit(None).cast(p.schema["words"].dataType)
    found = F.aggregate(F.reverse(lengths) if longest_first else lengths, none, lambda a, k: F.when(a.isNotNull(), a).otherwise(of(k)))
    return _first_page(p.withColumn("_found", found), keys, "_found")


def alcohol_slot(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    return first_statement(pages, keys, ALCOHOL_WORDS, lambda t, _: P.is_alcohol(t))


def net_contents_slot(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Volumes in the neighbourhood of nutrition words don't count."""
    return first_statement(pages, keys, NET_CONTENTS_WORDS, lambda t, _: ~t.rlike(NET_CONTENTS_BLOCKS) & P.parse_volume(t).isNotNull())


def commodity_slot(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    return first_statement(pages, keys, COMMODITY_WORDS, lambda t, _: reduce(lambda a, b: a | b, [F.contains(normalize(t), F.lit(p)) for p in COMMODITY_PHRASES]))


def disclosure_slots(pages: DataFrame, keys: Sequence[str], commodity: str = "beverage_type") -> DataFrame:
    """(keys, key, text, page, bbox): the first window with a keyword, per disclosure of the commodity (a column of pages); of equal texts the first key's."""
    sets = F.create_map(*[x for of, names in DISCLOSURES_OF.items() for x in (F.lit(of), F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("key"), F.array(*map(F.lit, DISCLOSURE_WORDS_OF[n])).alias("words")) for i, n in enumerate(names)]))])
    p = pages.withColumn("_d", F.explode(F.try_element_at(sets, F.col(commodity)))).withColumns({"_i": F.col("_d.i"), "key": F.col("_d.key"), "_kw": F.col("_d.words")})
    found = first_statement(p, [*keys, "_i", "key"], DISCLOSURE_WORDS, lambda t, _: F.exists("_kw", lambda k: F.contains(normalize(t), k)))
    rest = F.struct("key", *LOCATED)
    once = found.groupBy(*keys, normalize(F.col("text")).alias("_n")).agg(F.min_by(rest, F.col("_i")).alias("_s"))
    return once.select(*keys, "_s.*")


def varietal_slots(declared: DataFrame, pages: DataFrame, keys: Sequence[str], existing: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(keys, pos, text, page, bbox): existing slots (the same columns), then the declared varietals found on pages; of equal texts the first."""
    e = declared.select(*keys, F.posexplode("varietals").alias("field", "expected"))
    found = locate_declared(e, pages, keys, threshold).withColumnRenamed("field", "pos").withColumn("_old", F.lit(1))
    if existing is not None:
        found = existing.select(*keys, "pos", *LOCATED, F.lit(0).alias("_old")).unionByName(found)
    rest = F.struct("_old", "pos", *LOCATED)
    once = found.filter(presence(F.col("text")).isNotNull()).groupBy(*keys, normalize(F.col("text")).alias("_n")).agg(F.min_by(rest, F.struct("_old", "pos")).alias("_s")).filter("_n <> ''")
    order = F.row_number().over(_by(keys).orderBy("_s._old", "_s.pos")) - 1
    return once.select(*keys, order.alias("pos"), *[f"_s.{n}" for n in LOCATED])


def _by(keys: Sequence[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def locate_split(declared: DataFrame, pages: DataFrame, keys: Sequence[str], column: str = "fanciful_name") -> DataFrame:
    """(keys, field, text, page, bbox): a name of three to eight tokens whose tokens all stand somewhere on a page, in any order, in a box of limited height (pages: height).

    Each word takes the tokens that are still wanted; text is the declared name."""
    d = declared.select(*keys, F.col(column).alias("_want"), _upper_tokens(F.col(column)).alias("_goal")).filter(F.size("_goal").between(*SPLIT_TOKENS))
    j = d.join(pages.select(*keys, "page", "words", "height"), list(keys)).filter(F.size("words") > 0)
    drop = lambda left, i: F.concat(F.slice(left, 1, i - 1), F.slice(left, i + 1, F.size(left)))

    def take(left: Column, token: Column) -> Column:
        at = F.array_position(left, token).cast("int")
        return F.when(at > 0, drop(left, at)).otherwise(left)

    def step(s: Column, word: Column) -> Column:
        left = F.aggregate(_upper_tokens(word["text"]), s["left"], take)
        return F.struct(left.alias("left"), F.when(F.size(left) < F.size(s["left"]), F.concat(s["hit"], F.array(word))).otherwise(s["hit"]).alias("hit"))

    kind = pages.schema["words"].dataType
    start = F.struct(F.col("_goal").alias("left"), F.array().cast(kind).alias("hit"))
    start = start.cast(f"struct<left:array<string>,hit:{kind.simpleString()}>")
    j = j.withColumn("_s", F.aggregate("words", start, lambda s, w: step(s, w).cast(f"struct<left:array<string>,hit:{kind.simpleString()}>")))
    ok = (F.size("_s.left") == 0) & (union_of(F.col("_s.hit"))["height"] <= F.col("height") * SPLIT_HEIGHT)
    found = _first_page(j.withColumn("_hit", F.when(ok, F.col("_s.hit"))), [*keys, "_want"], "_hit")
    return found.select(*keys, F.lit(column).alias("field"), F.col("_want").alias("text"), "page", "bbox")


def reconcile_split(slots: DataFrame, declared: DataFrame, pages: DataFrame, keys: Sequence[str], column: str = "fanciful_name") -> DataFrame:
    """slots with the split name where the slot's own text is not the declared one; the earlier text is kept as model_text."""
    own = slots.filter(F.col("field") == column).select(*keys, F.col("text").alias("_own"))
    found = locate_split(declared, pages, keys, column).join(own, list(keys), "left").filter(~equivalent(F.col("_own"), F.col("text"))).drop("_own")
    return reconcile_declared(slots, found, keys)


def _same_line(words: Column) -> Column:
    first = F.get(words, F.lit(0))
    middle = lambda w: w["y"] + w["height"] / 2
    return F.forall(words, lambda w: F.abs(middle(w) - middle(first)) <= F.greatest(first["height"], w["height"]) * LINE_SHARE)


def recognised_class(pages: DataFrame, keys: Sequence[str], commodity: str = "beverage_type", entries: Sequence[dict] = tuple(K.DEFAULT)) -> DataFrame:
    """(keys, text, page, bbox): the longest, then first, window of words in one line that names a designation of the commodity (a column of pages)."""
    says = lambda t, w: ~t.rlike(CLASS_BLOCKS) & _same_line(w) & K.lookup(K.folded(t), F.col(commodity), entries).isNotNull()
    return first_statement(pages, keys, CLASS_WORDS, says, longest_first=True)


def locate_class(slots: DataFrame, declared: DataFrame, pages: DataFrame, keys: Sequence[str], entries: Sequence[dict] = tuple(K.DEFAULT), threshold: float = THRESHOLD) -> DataFrame:
    """(keys, field, text, page, bbox) for the slot class_type_designation: the declared class where it stands; else the catalogue's names that it contains;
    else, where the slot is empty too, any recognised designation. Records that declare no class get none. declared: beverage_type, declared_class_type."""
    d = declared.filter(presence(F.col("declared_class_type")).isNotNull()).select(*keys, "beverage_type", "declared_class_type")
    text = K.folded(F.col("declared_class_type"))
    every = F.array(*[F.struct(F.lit(e["commodity"]).alias("c"), F.lit(n).alias("n")) for e in entries for n in e["names"]])
    other = F.transform(F.filter(every, lambda e: (e["c"] == F.col("beverage_type")) & (e["n"] != text) & F.contains(text, e["n"])), lambda e: e["n"])
    d = d.withColumn("_all", F.array_distinct(F.concat(F.array("declared_class_type"), F.coalesce(other, F.array().cast("array<string>")))))
    found = locate_declared(d.select(*keys, F.posexplode("_all").alias("field", "expected")), pages, keys, threshold).withColumnRenamed("field", "_rank")
    own = slots.filter("field = 'class_type_designation'").select(*keys, F.col("text").alias("_own"))
    base = d.join(own, list(keys), "left")
    same = lambda a, t: equivalent(K.folded(a), K.folded(t))
    fits = lambda t: F.exists("_all", lambda a: same(a, t))
    j = base.join(found, list(keys)).withColumn("_wanted", F.get("_all", F.col("_rank")))
    good = F.when(F.col("_rank") == 0, fits(F.col("text"))).otherwise(same(F.col("_wanted"), F.col("text")))
    # of those that say their candidate the first; without one the last that was found at all
    order = F.struct((~good).alias("b"), F.when(good, F.col("_rank")).otherwise(-F.col("_rank")).alias("r"))
    best = j.filter((F.col("_rank") == 0) | ~fits(F.coalesce("_own", F.lit("")))).groupBy(*keys).agg(F.min_by(F.struct(*LOCATED), order).alias("_s")).select(*keys, "_s.*")
    empty = base.filter(presence(F.col("_own")).isNull()).join(best.select(*keys), list(keys), "left_anti").select(*keys, F.col("beverage_type").alias("_kind"))
    seen = recognised_class(pages.select(*keys, "page", "words").join(empty, list(keys)), keys, "_kind", entries)
    return best.unionByName(seen).select(*keys, F.lit("class_type_designation").alias("field"), *LOCATED)


def _ends_in_state(text: Column) -> Column:
    names = [n for pair in P.STATES.items() for n in (pair[0].lower(), pair[1])]
    return normalize(F.regexp_replace(text, r"\s*\d{5}(-\d{4})?\s*$", "")).rlike(r"(^|\s)(" + "|".join(names) + ")$")


def _lines_from(words: Column, at: Column) -> Column:
    """The word at a place (from 0) and up to two under it, close by; a line that ends in a state is the last."""
    first = F.get(words, at)
    state = F.struct(F.array(first).alias("w"), F.lit(True).alias("on"))

    def step(s: Column, w: Column) -> Column:
        last = F.element_at(s["w"], -1)
        near = s["on"] & (w["y"] >= last["y"]) & (w["y"] - (last["y"] + last["height"]) < last["height"] * CONTINUED_GAP)
        return F.struct(F.when(near, F.concat(s["w"], F.array(w))).otherwise(s["w"]).alias("w"), F.coalesce(near & ~_ends_in_state(w["text"]), F.lit(False)).alias("on"))

    return F.aggregate(F.slice(words, at + 2, CONTINUED), state, step, lambda s: s["w"])


def trim_address(text: Column, city: Column, state: Column) -> Column:
    """text up to the end of the first city and state (abbreviated or in full) that follow each other; the whole text without them."""
    tokens = F.split(strip(text), r"\s+")
    plain = F.transform(tokens, normalize)
    of = F.filter(F.split(normalize(F.coalesce(city, F.lit(""))), " "), lambda x: x != "")
    names = F.create_map(*[F.lit(x) for pair in P.STATES.items() for x in pair])
    forms = F.filter(F.array(F.lower(state), F.try_element_at(names, F.upper(state))), lambda x: x.isNotNull())
    goals = F.transform(forms, lambda f: F.concat(of, F.split(f, " ")))
    ends = F.flatten(F.transform(goals, lambda g: F.transform(F.filter(F.sequence(F.lit(1), F.size(plain)), lambda i: F.slice(plain, i, F.size(g)) == g), lambda i: i + F.size(g) - 1)))
    end = F.array_min(ends)
    return F.when(state.isNotNull() & (end < F.size(tokens)), F.array_join(F.slice(tokens, 1, F.greatest(end, F.lit(1))), " ")).otherwise(text)


def locate_address(slots: DataFrame, declared: DataFrame, pages: DataFrame, keys: Sequence[str], column: str = "applicant_name_address", threshold: float = THRESHOLD) -> DataFrame:
    """(keys, field, text, page, bbox) for the slot name_address_statement: kept where it names the applicant (or none is declared); else the lines from the
    applicant's name on; else those from "<verb> by" on. All end after the declared city and state."""
    own = slots.filter("field = 'name_address_statement'").select(*keys, F.struct(*LOCATED).alias("_own"))
    d = declared.select(*keys, F.col(column).alias("_want")).join(own, list(keys), "full").withColumn("_part", P.parse_name_address(F.col("_want")))
    d = d.withColumn("_name", F.array_join(P.name_tokens(F.col("_part.name")), " "))
    said = F.concat(F.lit(" "), normalize(F.col("_own.text")), F.lit(" "))
    named = F.forall(F.filter(F.split("_name", " "), lambda x: F.length(x) >= 3), lambda x: F.contains(said, F.concat(F.lit(" "), x, F.lit(" "))))
    d = d.withColumn("_trust", F.coalesce((presence(F.col("_own.text")).isNotNull()) & (presence(F.col("_want")).isNull() | named), F.lit(False)))
    kept = d.filter("_trust").select(*keys, "_part", "_own.*")
    j = best_window(d.filter("not _trust").select(*keys, "_part", "_name").join(pages.select(*keys, "page", "words"), list(keys)).filter(F.size("words") > 0), "words", "_name", threshold)
    verb = F.array_position(F.transform("words", lambda w: F.coalesce(match_norm(w["text"]).rlike("(" + "|".join(VERBS) + ") BY"), F.lit(False))), True).cast("int")
    at = F.when(F.col("match").isNotNull(), F.array_min("match.words")).when(verb > 0, verb - 1)
    j = j.withColumn("_tier", F.when(F.col("match").isNotNull(), 0).otherwise(1)).withColumn("_w", F.when(at.isNotNull(), _lines_from(F.col("words"), at))).filter("_w is not null")
    best = j.select(*keys, "_part", F.struct("_tier", "page", _text(F.col("_w")).alias("text"), union_of(F.col("_w")).alias("bbox")).alias("_s"))
    best = best.groupBy(*keys).agg(F.min_by(F.struct("_part", "_s"), F.struct("_s._tier", "_s.page")).alias("_b")).select(*keys, "_b._part", *[f"_b._s.{n}" for n in LOCATED])
    out = kept.select(*keys, "_part", *LOCATED).unionByName(best)
    return out.select(*keys, F.lit("name_address_statement").alias("field"), trim_address(F.col("text"), F.col("_part.city"), F.col("_part.state")).alias("text"), "page", "bbox")


def build_payload(declared: DataFrame, pages: DataFrame, keys: Sequence[str], entries: Sequence[dict] = tuple(K.DEFAULT), threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Everything that pages say about the declared records: (slots, records).

    slots: (keys, field, text, page, bbox, model_text, bbox_source), with varietals as varietal:<n> and disclosures as disclosure:<key>. records: (keys, legible,
    confidence). declared: keys, beverage_type, brand_name, fanciful_name, appellation, vintage_year, net_contents, country_of_origin, declared_class_type,
    applicant_name_address, varietals; pages: keys, page, height, words. Records without pages have no slots and are not legible."""
    word = pages.select(*keys, "page", "height", "words")
    e = declared.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(n).cast("string").alias("expected")) for f, n in DECLARED_FIELDS.items()])).alias("_e")).select(*keys, "_e.*")
    located = locate_declared(e, word, keys, threshold)
    slots = located.select(*keys, "field", *LOCATED, F.lit(None).cast("string").alias("model_text"), F.lit("ocr").alias("bbox_source"))
    slots = reconcile_split(slots, declared, word, keys)
    country = declared.select(*keys, F.lit("country_of_origin_statement").alias("field"), F.col("country_of_origin").alias("expected"))
    kinds = word.join(declared.select(*keys, "beverage_type"), list(keys))
    alone = {"alcohol_statement": alcohol_slot(word, keys), "commodity_statement": commodity_slot(word, keys), "government_warning": warning_slot(word, keys)}
    more = [locate_class(slots, declared, word, keys, entries, threshold), locate_declared(country, word, keys, threshold, whole_lines=True), locate_address(slots, declared, word, keys, threshold=threshold),
            *[df.select(*keys, F.lit(f).alias("field"), *LOCATED) for f, df in alone.items()],
            varietal_slots(declared, word, keys, threshold=threshold).select(*keys, F.concat(F.lit("varietal:"), "pos").alias("field"), *LOCATED),
            disclosure_slots(kinds, keys).select(*keys, F.concat(F.lit("disclosure:"), "key").alias("field"), *LOCATED)]
    missing = net_contents_slot(word, keys).join(slots.filter("field = 'net_contents'").select(*keys), list(keys), "left_anti")
    more.append(missing.select(*keys, F.lit("net_contents").alias("field"), *LOCATED))
    found = reduce(DataFrame.unionByName, [m.select(*keys, "field", "text", F.col("page").cast("int").alias("page"), "bbox") for m in more])
    slots = slots.withColumn("page", F.col("page").cast("int")).unionByName(found.withColumns({"model_text": F.lit(None).cast("string"), "bbox_source": F.lit("ocr")}))
    legible = word.groupBy(*keys).agg(F.coalesce(F.bool_or(F.size("words") > 0), F.lit(False)).alias("legible"))
    records = declared.select(*keys).join(legible, list(keys), "left").withColumn("legible", F.coalesce("legible", F.lit(False)))
    return slots, records.withColumn("confidence", F.when(F.col("legible"), WITH_TEXT).otherwise(WITHOUT_TEXT))
