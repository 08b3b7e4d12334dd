"""Slots that a model read: corrected from each other, held against what pages say, and shown with their findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions import parsers as P
from veriframe.functions.text import equivalent, normalize, presence, strip
from veriframe.operators.grounding import THRESHOLD, best_window
from veriframe.operators.joins import token_overlap
from veriframe.operators.latest import severity
from veriframe.operators.slots import union_of

# Fixed values.
RECALL, ABV_EPS, WARNING_OVERLAP = 0.75, 0.05, 0.6
#: Slot -> declared column, for slots that other slots' texts may correct; and the checks that stand behind a slot, the first one naming it.
TEXT_FIELDS = {"brand_name": "brand_name", "fanciful_name": "fanciful_name", "class_type_designation": "declared_class_type", "net_contents": "net_contents",
               "country_of_origin_statement": "country_of_origin", "appellation": "appellation"}
SLOT_CHECKS = {
    "brand_name": ("brand_name",), "fanciful_name": ("fanciful_name",),
    "class_type_designation": ("class_type_designation", "designation_origin_qualifier", "designation_minimum_abv", "designation_abv_class", "declared_class_type"),
    "alcohol_statement": ("alcohol_content", "alcohol_tolerance", "alcohol_range", "proof", "tax_class"), "net_contents": ("net_contents", "standards_of_fill", "measurement_system", "net_contents_form"),
    "name_address_statement": ("name_and_address",), "country_of_origin_statement": ("country_of_origin",), "government_warning": ("warning_text", "warning_prefix", "warning_bold"),
    "commodity_statement": ("commodity_statement",), "appellation": ("appellation", "requires_appellation"), "vintage": ("vintage",),
}
ALCOHOL = "alcohol_statement"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(normalize(F.coalesce(text, F.lit(""))), " "), lambda x: x != "")


def _alcohol_fits(text: Column, value: Column) -> Column:
    read = P.parse_alcohol(text)
    return F.coalesce(F.abs(read["percent"] - value) <= ABV_EPS, F.lit(False)) | F.coalesce((read["low"] <= value) & (value <= read["high"]), F.lit(False))


def correct_slots(slots: DataFrame, declared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """slots (keys, field, pos, text, page, bbox, source) with wrong or missing declared ones filled from another slot of the record whose text fits.

    Alcohol fits by value or range; a text by its share of the declared tokens, the best first, then the lowest pos. Corrected slots
    get source reconciled; slots that fit, and records without any text, stay. A record's slots meet only among themselves."""
    one = [F.struct(F.lit(f).alias("field"), F.nullif(strip(F.col(n).cast("string")), F.lit("")).alias("want"), F.lit(None).cast("double").alias("abv")) for f, n in TEXT_FIELDS.items()]
    one.append(F.struct(F.lit(ALCOHOL).alias("field"), F.lit(None).cast("string").alias("want"), F.col("alcohol_content").cast("double").alias("abv")))
    want = declared.select(*keys, F.explode(F.array(*one)).alias("_e")).select(*keys, F.col("_e.field").alias("_field"), F.col("_e.want").alias("_want"), F.col("_e.abv").alias("_abv")).filter("_want is not null or _abv is not null")
    score = F.when(F.col("_field") == ALCOHOL, F.when(_alcohol_fits(F.col("text"), F.col("_abv")), 1.0).otherwise(0.0)).otherwise(token_overlap(_tokens(F.col("_want")), _tokens(F.col("text")))["recall"])
    j = want.join(slots.filter(presence(F.col("text")).isNotNull()), list(keys)).withColumn("_score", score)
    own = (F.col("field") == F.col("_field")) & ((F.col("_score") >= RECALL) | F.coalesce((F.col("_field") != ALCOHOL) & equivalent(F.col("text"), F.col("_want")), F.lit(False)))
    best = j.groupBy(*keys, "_field").agg(F.coalesce(F.bool_or(own), F.lit(False)).alias("_fits"), F.max_by(F.struct(strip(F.col("text")).alias("text"), "page", "bbox", "_score"), F.struct("_score", -F.col("pos"))).alias("_s"))
    best = best.filter("not _fits and _s._score >= " + str(RECALL)).select(*keys, F.col("_field").alias("field"), F.struct("_s.text", "_s.page", "_s.bbox").alias("_new"))
    out = slots.join(best, [*keys, "field"], "full")
    pick = lambda n: F.when(F.col("_new").isNotNull(), F.col(f"_new.{n}")).otherwise(F.col(n)).alias(n)
    return out.select(*keys, "field", "pos", pick("text"), pick("page"), pick("bbox"), F.when(F.col("_new").isNotNull(), "reconciled").otherwise(F.col("source")).alias("source"))


def _same_alcohol(a: Column, b: Column) -> Column:
    no = F.lit(False)
    point = F.coalesce(F.abs(a["percent"] - b["percent"]) <= ABV_EPS, no)
    in_range = F.coalesce((a["low"] <= b["percent"]) & (b["percent"] <= a["high"]), no) | F.coalesce((b["low"] <= a["percent"]) & (a["percent"] <= b["high"]), no)
    return point | in_range | F.coalesce(F.greatest(a["low"], b["low"]) <= F.least(a["high"], b["high"]), no)


def ground_external(slots: DataFrame, pages: DataFrame, keys: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """slots (keys, field, text, page, bbox) held against pages (keys, page, width, height, lines: array of text and box): adds bbox_source, source, model_text.

    A text with a percentage takes the first line of the same alcohol; any text else the best window of lines at least by threshold, which for a warning
    must share three fifths of its words. Found texts replace the slot's (source ocr_grounded; another wording stays as model_text). The rest lose their
    text to model_text: vlm_region where their box meets its page, else vlm_unsupported. Slots without text stay as they are. (keys, field) is unique."""
    s = slots.withColumn("_said", F.nullif(strip(F.col("text")), F.lit("")))
    p = pages.select(*keys, F.col("page").alias("_page"), F.col("width").alias("_pw"), F.col("height").alias("_ph"), F.col("lines").alias("_lines"))
    j = best_window(s.filter("_said is not null").join(p, list(keys), "left"), "_lines", "_said", threshold, "_match")
    read = P.parse_alcohol(F.col("_said"))
    alcohol = F.filter("_lines", lambda x: F.contains(F.col("_said"), F.lit("%")) & _same_alcohol(read, P.parse_alcohol(x["text"])))
    window = F.transform(F.col("_match.words"), lambda i: F.get("_lines", i))
    said, seen = F.array_distinct(P.statement_tokens(F.col("_said"))), F.array_distinct(P.statement_tokens(F.array_join(F.transform(window, lambda w: w["text"]), " ")))
    warning = (F.col("field") == "government_warning") | F.col("_said").rlike(r"(?i)government\s+warning")
    enough = ~warning | (F.size(F.array_intersect(said, seen)) >= WARNING_OVERLAP * F.size(said))
    by_value = F.struct((-F.lit(2.0)).alias("rank"), F.col("_page").alias("page"), F.get(alcohol, F.lit(0))["text"].alias("text"), union_of(F.slice(alcohol, 1, 1)).alias("bbox"))
    by_text = F.struct((-F.col("_match.score")).alias("rank"), F.col("_page").alias("page"), F.array_join(F.transform(window, lambda w: w["text"]), " ").alias("text"), union_of(window).alias("bbox"))
    b = F.col("bbox")
    meets = (F.coalesce(F.col("page"), F.lit(0)) == F.col("_page")) & (b["width"] > 0) & (b["height"] > 0) & (b["x"] < F.col("_pw")) & (b["x"] + b["width"] > 0) & (b["y"] < F.col("_ph")) & (b["y"] + b["height"] > 0)
    kind = "struct<rank:double,page:int,text:string,bbox:struct<x:int,y:int,width:int,height:int>>"
    j = j.withColumn("_hit", F.when(F.size(alcohol) > 0, by_value.cast(kind)).when(F.col("_match").isNotNull() & enough, by_text.cast(kind))).withColumn("_meets", meets)
    best = j.groupBy(*keys, "field").agg(F.min_by(F.struct("_hit"), F.when(F.col("_hit").isNotNull(), F.struct("_hit.rank", "_hit.page"))).alias("_best"),
                                         F.coalesce(F.bool_or("_meets"), F.lit(False)).alias("_region"))
    out = s.join(best, [*keys, "field"], "left")
    hit, said = F.col("_best._hit"), F.col("_said")
    source = F.when(said.isNull(), F.lit(None)).when(hit.isNotNull(), "ocr_grounded").when(F.col("_region"), "vlm_region").otherwise("vlm_unsupported")
    return out.select(*keys, "field", F.when(said.isNull(), F.col("text")).otherwise(hit["text"]).alias("text"), F.coalesce(hit["page"], F.col("page")).alias("page"), F.coalesce(hit["bbox"], F.col("bbox")).alias("bbox"),
                      F.when(hit.isNotNull(), "ocr").when(F.col("bbox").isNotNull(), "model").alias("bbox_source"), source.alias("source"),
                      F.when(said.isNotNull() & ~F.coalesce(equivalent(said, hit["text"]), F.lit(False)), said).alias("model_text"))


def overlay(slots: DataFrame, findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, slot, field, page, bbox, verdict, note, expected, extracted, n_checks): boxes to draw, each with the worst of the findings behind it.

    slots: keys, field, text, page, bbox, bbox_source; only those read from pages (ocr) with a box count. findings: keys, finding (FINDING).
    A slot's checks are those of SLOT_CHECKS; of disclosure:<key> slots one per text counts, and only if a finding extracted that text. Slots without
    a finding have no row; of equally bad findings the check listed first counts."""
    s = slots.filter((F.col("bbox_source") == "ocr") & F.col("bbox").isNotNull())
    pairs = F.create_map(*[x for slot, checks in SLOT_CHECKS.items() for x in (F.lit(slot), F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(checks)]))])
    plain = s.filter(F.col("field").isin(*SLOT_CHECKS)).select(*keys, F.col("field").alias("slot"), "text", "page", "bbox", F.explode(F.try_element_at(pairs, F.col("field"))).alias("_c"))
    f = findings.select(*keys, F.col("finding.field").alias("_field"), F.col("finding").alias("_f"))
    j = plain.join(f, [*[plain[k] == f[k] for k in keys], plain["_c.n"] == f["_field"]]).select(*[plain[k] for k in keys], "slot", "text", "page", "bbox", F.col("_c.i").alias("_i"), "_f")
    best = j.groupBy(*keys, "slot").agg(F.max_by(F.struct("text", "page", "bbox", "_f"), F.struct(severity(F.col("_f.verdict")), -F.col("_i"))).alias("_b"), F.count("*").alias("n_checks"))
    names = F.create_map(*[F.lit(x) for slot, checks in SLOT_CHECKS.items() for x in (slot, checks[0])])
    rows = best.select(*keys, "slot", F.try_element_at(names, F.col("slot")).alias("field"), "_b.page", "_b.bbox", "_b._f", F.coalesce("_b._f.extracted", "_b.text").alias("extracted"), "n_checks")
    d = s.filter(F.startswith("field", F.lit("disclosure:"))).groupBy(*keys, F.replace(normalize(F.col("text")), F.lit(" ")).alias("_n")).agg(F.min_by(F.struct("field", "text", "page", "bbox"), F.col("field")).alias("_s"))
    g = f.filter(F.startswith("_field", F.lit("contains_")) | F.startswith("_field", F.lit("disclosure_"))).withColumn("_n", F.replace(normalize(F.col("_f.extracted")), F.lit(" "))).filter("_n <> ''")
    said = d.join(g, [*keys, "_n"]).groupBy(*keys, "_n").agg(F.min_by(F.struct("_s", "_f"), F.col("_field")).alias("_b"))
    more = said.select(*keys, F.col("_b._s.field").alias("slot"), F.col("_b._f.field").alias("field"), F.col("_b._s.page").alias("page"), F.col("_b._s.bbox").alias("bbox"), F.col("_b._f").alias("_f"), F.col("_b._s.text").alias("extracted"), F.lit(1).cast("long").alias("n_checks"))
    both = rows.unionByName(more)
    return both.select(*keys, "slot", "field", F.coalesce("page", F.lit(1)).alias("page"), "bbox", F.col("_f.verdict").alias("verdict"), F.col("_f.note").alias("note"), F.col("_f.expected").alias("expected"), "extracted", "n_checks")
