"""Rules as data: sizes, systems, tolerances, disclosures and citations are rows of one table, checked when it is loaded and compiled to column expressions.

A new size, a new disclosure or another citation is a row; no code changes. A checked book has a bounded number of rows and becomes
literals of the plan, so that checking records joins and shuffles nothing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: commodity null: all of them. What a section uses is said in SECTIONS.
ROW = "section string, commodity string, key string, number double, low double, high double, texts array<string>, words array<string>, pattern string, caps boolean, flag string, citation string"
COMMODITIES = ("malt", "wine", "spirits")
#: Section -> the columns that its rows must have.
SECTIONS = {"citation": ("key", "citation"), "fill": ("number",), "can": ("number",), "added": ("number",), "whole_litres": ("low", "high"), "system": ("key",), "tolerance": ("number",), "disclosure": ("key", "words", "citation")}
SYSTEMS = ("us", "metric")
MOST_ROWS = 20_000

# The shipped book.
_FILL = {"wine": (3000, 1500, 1000, 750, 500, 375, 187, 100, 50), "spirits": (1750, 1000, 750, 375, 200, 100, 50)}
_CAN, _ADDED, _LITRES = {"spirits": (355, 200, 100, 50)}, {"spirits": (700, 720, 900, 1800)}, {"wine": (4000, 17000)}
_SYSTEM = {"malt": "us", "wine": "metric", "spirits": "metric"}
#: By how much the actual may differ from the labelled alcohol, from a labelled percentage (low, itself outside) to another (high).
_TOLERANCE = (("malt", None, None, 0.3), ("wine", None, 14.0, 1.5), ("wine", 14.0, None, 1.0), ("spirits", None, None, 0.15))
_WARNING_FORMAT, _NAMES_FORM = "27 CFR 16.22; BAM Vol 1 3-1, Vol 2 1-17, Vol 3 1-11", "TTB F 5100.31 item 7"
_CITATIONS = {
    None: {"warning_text": "27 CFR 16.21; BAM Vol 1 1-14, Vol 2 1-17, Vol 3 1-11", "warning_prefix": _WARNING_FORMAT, "warning_bold": _WARNING_FORMAT, "warning_paragraph": _WARNING_FORMAT, "fanciful_name": _NAMES_FORM,
           "declared_class_type": "TTB F 5100.51 item 4", "artwork_quality": "TTB F 5100.31 labels", "duplicate_artwork": "TTB F 5100.31 labels", "part_4_coverage": "BAM Vol 1 Introduction"},
    "malt": {"brand_name": "BAM Vol 3 1-1", "name_and_address": "BAM Vol 3 1-2 to 1-4", "country_of_origin": "BAM Vol 3 1-12; 19 CFR Part 134", "net_contents": "BAM Vol 3 1-5 to 1-6, 5-1", "net_contents_form": "BAM Vol 3 5-1",
             "alcohol_content": "BAM Vol 3 1-7 to 1-8", "designations": "BAM Vol 3 4-2 to 4-5"},
    "wine": {"brand_name": "BAM Vol 1 1-1; 27 CFR 4.33", "name_and_address": "BAM Vol 1 1-7 to 1-9, 6-1 to 6-3", "country_of_origin": "BAM Vol 1 1-15; 19 CFR 134.11", "net_contents": "BAM Vol 1 7-1 to 7-3", "alcohol_content": "BAM Vol 1 1-3 to 1-5",
             "tax_class": "BAM Vol 1 1-5", "designations": "BAM Vol 1 5-1 to 5-15", "designation_abv_class": "BAM Vol 1 5-2, 5-8 to 5-10", "varietals": "BAM Vol 1 5-9 to 5-10; 27 CFR 4.23", "vintage": "TTB F 5100.31 (proposed) item 15; 27 CFR 4.27",
             "vintage_appellation": "BAM Vol 1 9-5; 27 CFR 4.27", "varietal_appellation": "BAM Vol 1 9-1; 27 CFR 4.23", "semi_generic_appellation": "BAM Vol 1 5-14; 26 USC 5388(c)", "appellation": "BAM Vol 1 5-14; 26 USC 5388(c)",
             "brand_label_placement": "BAM Vol 1 1-1; 27 CFR 4.33", "missing_sulfites": "BAM Vol 1 1-12 to 1-13"},
    "spirits": {"brand_name": "BAM Vol 2 1-1", "name_and_address": "BAM Vol 2 1-12 to 1-13", "country_of_origin": "BAM Vol 2 1-15 to 1-16", "net_contents": "BAM Vol 2 1-7, 6-1", "alcohol_content": "BAM Vol 2 1-2 to 1-3", "alcohol_tolerance": "BAM Vol 2 1-3",
                "designations": "BAM Vol 2 4-2 to 4-15", "commodity_statement": "BAM Vol 2 1-4 to 1-6", "cocktail": "BAM Vol 2 4-12 to 4-13"},
}
#: Findings that cite as others do.
_LIKE = {"net_contents": ("measurement_system", "standards_of_fill"), "alcohol_content": ("alcohol_tolerance", "alcohol_range", "proof", "tax_class"), "designations": ("class_type_designation", "designation_origin_qualifier", "designation_minimum_abv", "designation_abv_class")}
_SULFITES = ["CONTAINS SULFITES", "CONTAINS A SULFITING AGENT", "CONTAINS SULFITING AGENTS"]
_SACCHARIN = ["USE OF THIS PRODUCT MAY BE HAZARDOUS TO YOUR HEALTH. THIS PRODUCT CONTAINS SACCHARIN WHICH HAS BEEN DETERMINED TO CAUSE CANCER IN LABORATORY ANIMALS."]
_WORDS = {"sulfites": ["sulfite", "sulfiting", "sulphite"], "fd_c_yellow_5": ["yellow"], "saccharin": ["saccharin"], "aspartame": ["phenylketonurics", "phenylalanine", "aspartame"], "cochineal_carmine": ["cochineal", "carmine"],
          "coloring": ["colored", "color"], "wood_treatment": ["wood"]}
_FLAGS = {"sulfites": "contains_sulfites_10ppm", "fd_c_yellow_5": "contains_fd_c_yellow_5", "aspartame": "contains_aspartame", "saccharin": "contains_saccharin", "cochineal_carmine": "contains_cochineal_carmine", "coloring": "contains_added_coloring"}
_DISCLOSURES = (
    ("malt", "fd_c_yellow_5", ["CONTAINS FD&C YELLOW #5"], None, False, "BAM Vol 3 1-9"), ("malt", "saccharin", _SACCHARIN, None, False, "BAM Vol 3 1-9"), ("malt", "sulfites", _SULFITES, None, False, "BAM Vol 3 1-10"),
    ("malt", "aspartame", ["PHENYLKETONURICS: CONTAINS PHENYLALANINE."], None, True, "BAM Vol 3 1-10"),
    ("wine", "sulfites", [*_SULFITES, "CONTAINS NATURALLY OCCURING SULFITES", "NO SULFITES ADDED, CONTAINS ONLY NATURALLY OCCURING SULFITES"], None, False, "BAM Vol 1 1-12"),
    ("wine", "fd_c_yellow_5", ["CONTAINS FD&C YELLOW NO. 5", "CONTAINS FD&C YELLOW #5"], None, False, "BAM Vol 1 1-10"),
    ("wine", "cochineal_carmine", ["CONTAINS COCHINEAL EXTRACT", "CONTAINS CARMINE", "CONTAINS COCHINEAL EXTRACT AND CARMINE"], None, False, "BAM Vol 1 1-11"),
    ("spirits", "fd_c_yellow_5", ["CONTAINS FD&C YELLOW #5"], None, False, "BAM Vol 2 1-10"), ("spirits", "saccharin", _SACCHARIN, None, False, "BAM Vol 2 1-10"), ("spirits", "sulfites", _SULFITES, None, False, "BAM Vol 2 1-11"),
    ("spirits", "coloring", ["ARTIFICIALLY COLORED", "CERTIFIED COLOR ADDED", "COLORED WITH CARAMEL", "CARAMEL AND CERTIFIED COLOR ADDED"], "COLORED WITH", False, "BAM Vol 2 1-8"),
    ("spirits", "wood_treatment", [], "COLORED AND FLAVORED WITH WOOD", False, "BAM Vol 2 1-9"),
)


def _shipped() -> list[dict]:
    out = [{"section": s, "commodity": k, "number": float(ml)} for s, of in (("fill", _FILL), ("can", _CAN), ("added", _ADDED)) for k, sizes in of.items() for ml in sizes]
    out += [{"section": "whole_litres", "commodity": k, "low": float(a), "high": float(b)} for k, (a, b) in _LITRES.items()]
    out += [{"section": "system", "commodity": k, "key": v} for k, v in _SYSTEM.items()]
    out += [{"section": "tolerance", "commodity": k, "low": a, "high": b, "number": n} for k, a, b, n in _TOLERANCE]
    for k, of in _CITATIONS.items():
        every = {name: of[like] for like, names in _LIKE.items() if like in of for name in names} | {n: x for n, x in of.items() if n != "designations"}
        out += [{"section": "citation", "commodity": k, "key": name, "citation": text} for name, text in every.items()]
    return out + [{"section": "disclosure", "commodity": k, "key": key, "texts": texts, "words": _WORDS[key], "pattern": pattern, "caps": caps, "flag": _FLAGS.get(key), "citation": cite} for k, key, texts, pattern, caps, cite in _DISCLOSURES]


@dataclass(frozen=True)
class Rulebook:
    rows: tuple[dict, ...]

    def of(self, section: str, commodity: str | None = None) -> list[dict]:
        """Rows of a section; of a commodity those for it and those for all."""
        return [r for r in self.rows if r["section"] == section and (commodity is None or r.get("commodity") in (None, commodity))]

    def numbers(self, section: str, commodity: str) -> list[float]:
        return [r["number"] for r in self.of(section, commodity)]

    def citation(self, field: Column, commodity: Column) -> Column:
        """The commodity's citation of a finding's field, else that for all, else null."""
        cited = {(r.get("commodity") or "", r["key"]): r["citation"] for r in self.of("citation")} | {(r.get("commodity") or "", f"disclosure_{r['key']}"): r["citation"] for r in self.of("disclosure")}
        if not cited:
            return F.lit(None).cast("string")
        table = F.create_map(*[F.lit(x) for (k, name), text in cited.items() for x in (f"{k}:{name}", text)])
        at = lambda k: F.try_element_at(table, F.concat(k, F.lit(":"), field))
        return F.coalesce(at(F.coalesce(commodity, F.lit(""))), at(F.lit("")))


DEFAULT = Rulebook(tuple(_shipped()))


def load(spark: SparkSession, path: str) -> DataFrame:
    """A book of JSON lines with the columns of ROW."""
    return spark.read.schema(ROW).json(path)


def to_table(spark: SparkSession, book: Rulebook = DEFAULT) -> DataFrame:
    names = [x.split(" ")[0] for x in ROW.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in book.rows], ROW)


def violations(book: DataFrame, findings: Sequence[str] = ()) -> DataFrame:
    """(section, commodity, key, problem): what is wrong with a book's rows; a sound one has none. findings: names that must have a citation for every commodity."""
    blank = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) == "" for c in ("key", "citation")} | {c: F.col(c).isNull() for c in ("number", "low", "high")} | {"words": F.coalesce(F.size("words"), F.lit(0)) <= 0}
    rules = {"unknown section": ~F.coalesce(F.col("section").isin(*SECTIONS), F.lit(False)), "unknown commodity": F.col("commodity").isNotNull() & ~F.col("commodity").isin(*COMMODITIES),
             "size must be positive": F.col("section").isin("fill", "can", "added") & (F.col("number") <= 0), "bounds are not in order": F.col("low") > F.col("high"), "tolerance is negative": (F.col("section") == "tolerance") & (F.col("number") < 0),
             "unknown system": (F.col("section") == "system") & ~F.col("key").isin(*SYSTEMS), "no permitted form": (F.col("section") == "disclosure") & (F.coalesce(F.size("texts"), F.lit(0)) <= 0) & F.col("pattern").isNull()}
    rules |= {f"{s}: {c} missing": (F.col("section") == s) & blank[c] for s, cs in SECTIONS.items() for c in cs}
    found = F.filter(F.array(*[F.when(bad, F.lit(text)) for text, bad in rules.items()]), lambda x: x.isNotNull())
    rows = book.select("section", "commodity", "key", F.explode(found).alias("problem"))
    twice = book.filter(F.col("section").isin("citation", "disclosure", "system")).groupBy("section", "commodity", F.when(F.col("section") != "system", F.col("key")).alias("key")).count().filter("count > 1")
    rows = rows.unionByName(twice.select("section", "commodity", "key", F.lit("stated twice").alias("problem")))
    if findings:
        wanted = book.sparkSession.createDataFrame([(k, f) for k in COMMODITIES for f in findings], "commodity string, key string")
        cited = book.filter("section = 'citation'").select("key", F.explode(F.when(F.col("commodity").isNull(), F.array(*map(F.lit, COMMODITIES))).otherwise(F.array("commodity"))).alias("commodity"))
        rows = rows.unionByName(wanted.join(cited, ["commodity", "key"], "left_anti").select(F.lit("citation").alias("section"), "commodity", "key", F.lit("no citation").alias("problem")))
    return rows


def book_of(table: DataFrame, most: int = MOST_ROWS) -> Rulebook:
    """A book from its table, checked: raises ValueError if it has violations or more than most rows."""
    bad = violations(table).take(1)
    if bad:
        raise ValueError(f"rulebook: {bad[0]['section']} {bad[0]['commodity']} {bad[0]['key']}: {bad[0]['problem']}")
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"rulebook: more than {most} rows")
    return Rulebook(tuple(r.asDict(recursive=True) for r in rows))
