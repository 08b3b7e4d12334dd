"""The rule catalogue: every check is a column expression that gives a finding or null; nothing is shuffled.

Input columns: declared values (beverage_type, imported, brand_name, fanciful_name, applicant_name_address, net_contents,
country_of_origin, alcohol_content, actual_alcohol_content, appellation, vintage_year, varietals, flags) and what was read on the label
under label_ and the same name (label_warning, label_alcohol, label_net_contents, label_disclosures, ...)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions import parsers as P
from veriframe.functions import text as X
from veriframe.operators.joins import band_match, bucket_match
from veriframe.operators.latest import worst_of_array
from veriframe.plans import catalogue as K
from veriframe.plans import rulebook

# Fixed values.
PREFIX = "GOVERNMENT WARNING:"
WARNING = (PREFIX + " (1) According to the Surgeon General, women should not drink alcoholic beverages during pregnancy because of the risk of birth defects. "
           "(2) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems.")
PART_4_ABV, BOUNDARY, ABV_EPS, ML_EPS = 7.0, 14.0, 0.05, 1.0
#: Forms of content by size: whole units within ML_EPS of them, and what lies between.
WHOLE = {"1 pint": 16 * X.FLUID_OUNCE, "1 quart": 32 * X.FLUID_OUNCE, "1 gallon": 128 * X.FLUID_OUNCE}
BETWEEN = ("fluid ounces or fractions of a pint", "pints and fluid ounces", "quarts, pints and fluid ounces", "gallons")
EDGES = [0.0, *[x for ml in WHOLE.values() for x in (ml - ML_EPS, ml + ML_EPS)], float("inf")]
FORMS = [(name, low, high) for name, low, high in zip([n for pair in zip(BETWEEN, [*WHOLE, ""]) for n in pair], EDGES, EDGES[1:])]
MAKERS = ("bottled by", "packed by", "filled by", "distilled by", "blended by", "made by", "prepared by", "manufactured by", "produced by", "brewed by", "vinted by", "cellared by")
IMPORTERS = ("imported by", "sole agent", "sole u s agent", "imported and bottled by")
COCKTAILS = ("apricot sour", "black russian", "bloody mary", "alexander", "daiquiri", "egg nog", "gimlet", "vodka gimlet", "grasshopper", "mai tai", "manhattan", "margarita", "martini", "vodka martini", "mint julep",
             "old fashioned", "pink squirrel", "screwdriver", "sloe gin fizz", "tom collins", "wallbanger", "whisky sour", "white russian")
QUALIFIERS = ("type", "american", "brewed", "produced", "distilled", "blended", "made")
COMPONENTS = ("seltzer", "soda", "spritz", "spritzer", "cocktail", "margarita", "mule", "highball", "cooler", "lemonade", "punch", "tea", "ready to drink", "rtd")
SPECIALTIES = ("specialty", "specialties", "proprietary", "proprietaries", "cocktail", "cocktails", "seltzer", "cooler", "ready to drink", "rtd", "under 48 proof")
COLORS = ("red", "white", "rose", "pink", "amber")
#: Designation, least and most alcohol, and whether each bound is itself outside; the first that a text names counts.
ABV_CLASSES = [("table wine", 7.0, 14.0, False, False), ("light wine", 7.0, 14.0, False, False), ("dessert wine", 14.0, 24.0, True, False), ("sherry", 17.0, 24.0, False, False), ("light sherry", 14.0, 17.0, True, True),
               ("madeira", 18.0, 24.0, False, False), ("port", 18.0, 24.0, False, False), ("angelica", 18.0, 24.0, False, False), ("muscatel", 18.0, 24.0, False, False), ("light madeira", 14.0, 18.0, True, True),
               ("light port", 14.0, 18.0, True, True), ("light angelica", 14.0, 18.0, True, True), ("light muscatel", 14.0, 18.0, True, True), ("vermouth", 15.0, float("inf"), False, False)]
#: Classes that need a statement with a percentage and neutral spirits, and those that need what they are distilled from.
STATEMENT_GROUPS = {"group_1": ("neutral spirits", "vodka", "grain spirits", "blended whisky", "blended bourbon whisky", "blended wheat whisky", "blended rye whisky", "blended malt whisky", "blended rye malt whisky",
                                "blended corn whisky", "spirit whisky", "compounded gin", "redistilled gin", "blended applejack"),
                    "group_2": ("neutral spirits", "vodka", "grain spirits", "distilled gin")}
#: Columns that say whether a formula has an ingredient, by its key.
DISCLOSURES = ("contains_sulfites_10ppm", "contains_fd_c_yellow_5", "contains_aspartame", "contains_saccharin", "contains_cochineal_carmine", "contains_added_coloring")
#: Words of an importer's name that name nobody, and what an embossed container says of its contents.
GENERIC = ("america", "american", "americas", "beverage", "beverages", "company", "co", "corporation", "incorporated", "inc", "import", "imported", "importer", "importers", "imports", "llc", "ltd", "supply", "wine", "wines", "spirits")
EMBOSSED = r"contents|\d+\s*(ml|oz|liter|pint|quart|gallon)"
#: Confidence from which a near name is taken for the name, and the current tolerance of spirits.
SURE, CURRENT_TOLERANCE = 0.9, 0.3

c = F.col
norm = X.normalize


def finding(field: str, verdict, expected=None, extracted=None, note: str | None = None) -> Column:
    text = lambda v: F.lit(None).cast("string") if v is None else (v if isinstance(v, Column) else F.lit(v)).cast("string")
    return F.struct(F.lit(field).alias("field"), text(verdict).alias("verdict"), text(expected).alias("expected"), text(extracted).alias("extracted"), F.lit(None).cast("string").alias("citation"), text(note).alias("note"))


def blank(col: Column) -> Column:
    return X.presence(col).isNull()


def model(slot: str) -> Column:
    """What a vision model read where the print was replaced by located words; null without it."""
    return F.try_element_at(c("label_model_texts"), F.lit(slot))


def weak(slot: str) -> Column:
    """Whether a slot's evidence is ambiguous."""
    return F.coalesce(F.array_contains("label_weak_fields", slot), F.lit(False))


def same(a: Column, b: Column) -> Column:
    """Normalised texts are equal but for spaces, and not blank."""
    return F.coalesce((F.replace(a, F.lit(" ")) == F.replace(b, F.lit(" "))) & (F.trim(a) != ""), F.lit(False))


def unread(slot: str, what: str) -> Column:
    return F.when(weak(slot), f"{what} evidence is ambiguous; confirm the label visually").otherwise(f"{what} was not found; confirm the label visually")


def ladder(field: str, what: str) -> Column:
    """Missing, exact, equal but for case and marks, equal as the model read it, near at high confidence, other; a fanciful name may stand in several fields together."""
    want, got, n, m = c(field), c("label_" + field), c(f"_n_{field}"), c(f"_n_label_{field}")
    sure = F.coalesce(F.try_element_at(c("label_field_confidences"), F.lit(field)) >= SURE, F.lit(False)) & X.near_equivalent(n, m, lambda x: x)
    alike, read = same(n, m), same(n, c(f"_m_{field}"))
    together = F.lit(False)
    if field == "fanciful_name":
        tokens = lambda x: F.filter(F.split(x, " "), lambda w: F.length(w) >= 2)
        seen = tokens(F.concat_ws(" ", "_n_label_brand_name", "_n_label_class_type", "_n_label_fanciful_name", "_m_brand_name", "_m_class_type_designation", "_m_fanciful_name"))
        together = (F.size(tokens(n)) >= 3) & ~blank(got) & (F.size(F.array_except(tokens(n), seen)) == 0)
    cases = [(together, "pass_with_note", "The declared name stands across the fields that are visible"), (blank(got), "needs_review", unread(field, what)), (F.trim(want) == F.trim(got), "pass", None), (alike, "pass_with_note", "The same name in another case, spacing or punctuation"),
             (read, "pass_with_note", F.concat(F.lit("As the model read it ("), model(field), F.lit("), the name is the declared one"))), (sure, "pass_with_note", "Nearly the same, read with high confidence"), (F.lit(True), "needs_review", "Differs by more than case and punctuation")]
    return F.when(~blank(want), decided(field, cases, want, got))


def decided(field: str, cases: list[tuple[Column, str | Column, str | Column | None]], expected=None, extracted=None) -> Column:
    """The finding of the first case (when, verdict, note) that holds; each condition stands in the plan once."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string") if x is None else F.lit(x)
    chosen = None
    for when, verdict, note in cases:
        one = F.struct(text(verdict).alias("v"), text(note).alias("n"))
        chosen = F.when(when, one) if chosen is None else chosen.when(when, one)
    # an array of one binds what was chosen
    made = F.get(F.transform(F.array(chosen), lambda x: finding(field, x["v"], expected, extracted, x["n"])), F.lit(0))
    return made


def check_name_and_address() -> Column:
    """The applicant's name and place behind a phrase that says what they do; importers may be named by the first word that is theirs."""
    want, got, said = c("_applicant"), c("_n_label_name_address"), F.split("_n_label_name_address", " ")
    padded = F.concat(F.lit(" "), got, F.lit(" "))
    share = lambda words: F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(got, w))) / F.size(words)).otherwise(0.0)
    words = lambda x: F.filter(F.split(x, " "), lambda w: F.length(w) >= 3)
    tokens = F.filter(c("_applicant_tokens"), lambda w: F.length(w) >= 3)
    named = F.when(want["state"].isNull(), share(words(c("_n_applicant_name_address")))).when(F.size(tokens) > 0, share(tokens)).otherwise(share(words(norm(want["name"])))) >= 0.6
    place = (want["city"].isNull() | F.contains(padded, F.concat(F.lit(" "), norm(want["city"]), F.lit(" ")))) & P.state_in(said, want["state"])
    imported, malt = F.coalesce(c("imported"), F.lit(False)), F.coalesce(c("beverage_type") == "malt", F.lit(False))
    any_of = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(got, p))
    phrase = F.when(imported, any_of(IMPORTERS + MAKERS)).otherwise(any_of(MAKERS))
    own = F.get(F.filter(c("_applicant_tokens"), lambda w: (F.length(w) >= 4) & ~w.isin(*GENERIC)), F.lit(0))
    short = imported & phrase & want["state"].isNotNull() & place & F.coalesce(F.array_contains(said, own), F.lit(False))
    present = named & (want["state"].isNull() | place)
    cases = [(blank(c("label_name_address")), "needs_review", unread("name_address_statement", "Name and address")), (present & phrase, "pass", None), (present & malt & ~imported, "pass_with_note", "No phrase says who made or imported it"),
             (present, "fail", "No phrase says who made or imported it"), (named, "needs_review", "The name is there, but not its city and state"), (short, "pass_with_note", "The importer's name is shortened, its city and state are there"), (F.lit(True), "needs_review", "The statement does not clearly have the applicant's name")]
    return decided("name_and_address", cases, c("applicant_name_address"), c("label_name_address"))


def check_country() -> Column:
    want, got = norm(c("country_of_origin")), norm(c("label_country_of_origin"))
    return finding("country_of_origin", F.when(~F.coalesce(c("imported"), F.lit(False)), "not_required").when(blank(c("label_country_of_origin")), "needs_review").when(F.contains(got, want), "pass").otherwise("fail"), c("country_of_origin"), c("label_country_of_origin"))


FOLDED = ("brand_name", "label_brand_name", "fanciful_name", "label_fanciful_name", "appellation", "label_appellation", "label_class_type", "applicant_name_address", "label_name_address")
MODEL_NAMES = ("brand_name", "fanciful_name", "appellation", "class_type_designation")


def parsed() -> dict[str, Column]:
    """What several checks read, folded and parsed once in a projection before theirs."""
    want = P.parse_name_address(c("applicant_name_address"))
    return {"_declared_volume": P.parse_volume(c("net_contents")), "_label_volume": P.parse_volume(c("label_net_contents")), "_model_volume": P.parse_volume(model("net_contents")), "_alcohol": P.parse_alcohol(c("label_alcohol")),
            "_warning": P.compare_statement(c("label_warning"), WARNING, PREFIX), "_model_warning": P.compare_statement(model("government_warning"), WARNING, PREFIX), "_applicant": want, "_applicant_tokens": P.name_tokens(want["name"]),
            "_said": F.transform(F.coalesce("label_disclosures", F.array().cast("array<string>")), lambda x: F.struct(x.alias("text"), norm(x).alias("n"))),
            **{f"_n_{x}": norm(c(x)) for x in FOLDED}, **{f"_m_{x}": norm(model(x)) for x in MODEL_NAMES}}


def _noise() -> Column:
    """The words of the label's warning are the statute's but for single characters."""
    said, wanted = P.statement_tokens(c("label_warning")), P.statement_tokens(F.lit(WARNING))
    return P.char_noise(F.array_join(said, " "), F.array_join(wanted, " "))


def _by_model() -> Column:
    """The warning was read by the model alone."""
    return F.coalesce(F.try_element_at(c("label_field_sources"), F.lit("government_warning")) == "model", F.lit(False))


def check_warning_text() -> Column:
    w, m, said, wanted = c("_warning"), c("_model_warning"), P.statement_tokens(c("label_warning")), P.statement_tokens(F.lit(WARNING))
    some = lambda words: F.array_join(F.slice(words, 1, 6), " ")
    words = F.concat(F.lit("The wording differs"), F.when(F.size(w["missing_words"]) > 0, F.concat(F.lit("; missing: "), some(w["missing_words"]))).otherwise(""), F.when(F.size(w["extra_words"]) > 0, F.concat(F.lit("; unexpected: "), some(w["extra_words"]))).otherwise(""))
    cases = [(blank(c("label_warning")), "needs_review", unread("government_warning", "Government warning")), (w["text_matches"], "pass", None), (m["text_matches"], "pass_with_note", "As the model read it, the warning is the statute's"),
             (_noise(), "pass_with_note", "Single characters differ"), (P.truncated(said, wanted), "needs_review", "The end is cut off"), (_by_model(), "needs_review", "The model alone read it, and in other words"), (F.lit(True), "fail", words)]
    return decided("warning_text", cases, WARNING, c("label_warning"))


def check_warning_prefix() -> Column:
    w, m = c("_warning"), c("_model_warning")
    cases = [(w["prefix_all_caps"], "pass", None), (F.coalesce(m["text_matches"] & m["prefix_all_caps"], F.lit(False)), "pass_with_note", "As the model read it, the prefix is in capitals"), (~F.coalesce(w["text_matches"], F.lit(False)) & _noise(), "pass_with_note", "Single characters differ"),
             (_by_model(), "needs_review", "The model alone read it"), (F.lit(True), "fail", "It must be in capital letters")]
    return F.when(~blank(c("label_warning")), decided("warning_prefix", cases, PREFIX, F.substring(F.trim("label_warning"), 1, 20)))


def check_warning_bold() -> Column:
    note = F.when(~c("label_warning_bold"), "The prefix does not look bold").otherwise("Bold type could not be seen")
    return F.when(~blank(c("label_warning")) & ~F.coalesce(c("label_warning_bold"), F.lit(False)), finding("warning_bold", "needs_review", f"{PREFIX[:-1]} in bold type").withField("note", note))


def check_warning_paragraph() -> Column:
    broken = ~F.coalesce(c("label_warning_paragraph"), F.lit(True)) & ~F.coalesce(c("_warning")["text_matches"], F.lit(False))
    return F.when(broken, finding("warning_paragraph", "needs_review", "One continuous paragraph", note="The warning does not run as one paragraph"))


def _volume() -> Column:
    """The label's volume, as printed or else as the model read it."""
    return F.coalesce(c("_label_volume"), c("_model_volume"))


def _has_contents() -> Column:
    """There is a declared and a readable volume to check."""
    return ~blank(c("label_net_contents")) & ~X.not_stated(c("net_contents")) & _volume().isNotNull()


def check_net_contents() -> Column:
    want, got, m = c("_declared_volume")["milliliters"], _volume()["milliliters"], c("_model_volume")["milliliters"]
    sentinel, none = X.not_stated(c("net_contents")), blank(c("label_net_contents"))
    embossed = F.coalesce(norm(c("container_embossed_info")).rlike(EMBOSSED), F.lit(False))
    cases = [(none & sentinel, "needs_review", "The application states no volume"), (none & embossed, "pass_with_note", "Declared as blown, branded or embossed on the container"), (none & weak("net_contents"), "needs_review", "Net contents evidence is ambiguous; confirm the label visually"),
             (none, "fail", "No net contents on the label"), (sentinel, "pass_with_note", "The application states no volume"), (got.isNull(), "needs_review", "No volume could be read from the label"), (want.isNull(), "needs_review", "The application states no volume"),
             (F.abs(want - got) <= ML_EPS, "pass", None), (F.abs(want - m) <= ML_EPS, "pass_with_note", "As the model read it, the volume is the declared one"), (F.lit(True), "fail", F.concat(F.lit("The label says "), X.fmt_ml(got), F.lit(", the application "), X.fmt_ml(want)))]
    return decided("net_contents", cases, c("net_contents"), c("label_net_contents"))


def check_measurement_system(book: rulebook.Rulebook = rulebook.DEFAULT) -> Column:
    out = F.lit(None)
    for row in book.of("system"):
        kind, system = row["commodity"], row["key"]
        bad = (c("beverage_type") == kind) & _has_contents() & (_volume()["unit_system"] != system) & ~P.has_unit_system(c("label_net_contents"), system)
        out = F.when(bad, finding("measurement_system", "needs_review" if system == "us" else "fail", system, c("label_net_contents"))).otherwise(out)
    return out


def check_standards_of_fill(book: rulebook.Rulebook = rulebook.DEFAULT) -> Column:
    """Commodities with sizes in the book: a standard or can size or whole litres of a range pass, sizes that were added since are for review."""
    ml, out = _volume()["milliliters"], F.lit(None)
    for kind in dict.fromkeys(r["commodity"] for r in book.of("fill")):
        even = F.lit(False)
        for r in book.of("whole_litres", kind):
            even = even | ((ml >= r["low"]) & (ml <= r["high"]) & (F.pmod(ml, F.lit(1000.0)) <= ML_EPS))
        good = band_match(ml, book.numbers("fill", kind) + book.numbers("can", kind), ML_EPS).isNotNull() | even
        sizes = "Authorized sizes: " + ", ".join(f"{x:g} mL" for x in book.numbers("fill", kind))
        cases = [(good, "pass", None), (band_match(ml, book.numbers("added", kind), ML_EPS).isNotNull(), "needs_review", "A size that was authorized later"), (F.lit(True), "fail", "No authorized size")]
        out = F.when((c("beverage_type") == kind) & _has_contents(), decided("standards_of_fill", cases, sizes, X.fmt_ml(ml))).otherwise(out)
    return out


def _form_said(text: Column, form: Column) -> Column:
    """A text states its size in a form of FORMS, brackets aside."""
    whole = F.regexp_replace(text, r"\([^)]*\)", " ")
    n, unit = norm(whole), F.regexp_extract(form, r"^1 (pint|quart|gallon)$", 1)
    ounces = n.rlike("oz|ounce")
    part = F.contains(form, F.lit("fractions"))
    any_unit = F.exists(F.array(*[F.when(F.contains(form, F.lit(u)), F.lit(u.split(" ")[0])) for u in ("pint", "quart", "gallon", "fluid ounces")]), lambda u: F.coalesce(F.contains(n, u), F.lit(False)))
    return F.coalesce(F.when(unit != "", F.contains(n, unit) & ~ounces).when(part, ounces | F.contains(n, F.lit("pint"))).otherwise(any_unit), F.lit(False))


def check_malt_form() -> Column:
    form = bucket_match(_volume()["milliliters"], FORMS)
    asked = (c("beverage_type") == "malt") & _has_contents() & (_volume()["unit_system"] == "us") & form.isNotNull() & ~_form_said(c("label_net_contents"), form)
    cases = [(_form_said(model("net_contents"), form), "pass_with_note", "As the model read it, the form is the required one"), (F.lit(True), "fail", F.concat(F.lit("A container of this size must say it in "), form))]
    return F.when(asked, decided("net_contents_form", cases, form, c("label_net_contents")))


def _abv() -> Column:
    return c("alcohol_content").cast("double")


def check_alcohol() -> Column:
    """Missing statements by commodity; a statement is compared where the application has a percentage."""
    read, none = c("_alcohol"), c("_alcohol").isNull()
    exempt = (c("beverage_type") == "wine") & F.coalesce(_abv() <= BOUNDARY, F.lit(True)) & c("_n_label_class_type").rlike(r"\b(table|light) wine\b")
    cases = [(none & (c("beverage_type") == "malt"), "not_required", "Optional for malt beverages"), (none & exempt, "not_required", "Optional for table and light wine"), (none & weak("alcohol_statement"), "needs_review", "Alcohol content evidence is ambiguous; confirm the label visually"),
             (none, "fail", "No alcohol content on the label"), (read["percent"].isNull(), "needs_review", "A range or proof alone; compare by hand"), (F.abs(read["percent"] - _abv()) <= ABV_EPS, "pass", None),
             (F.lit(True), "fail", F.concat(F.lit("The label says "), X.fmt_pct(read["percent"]), F.lit(", the application "), X.fmt_pct(_abv())))]
    return F.when(none | _abv().isNotNull(), decided("alcohol_content", cases, X.fmt_pct(_abv()), c("label_alcohol")))


def check_alcohol_tolerance(book: rulebook.Rulebook = rulebook.DEFAULT) -> Column:
    actual, labelled = c("actual_alcohol_content").cast("double"), c("_alcohol")["percent"]
    off, band = F.round(F.abs(actual - labelled), 4), None
    for r in book.of("tolerance"):
        hit = (F.lit(True) if r.get("commodity") is None else c("beverage_type") == r["commodity"]) & (F.lit(True) if r.get("low") is None else labelled > r["low"]) & (F.lit(True) if r.get("high") is None else labelled <= r["high"])
        band = F.when(hit, r["number"]) if band is None else band.when(hit, r["number"])
    spirits = F.when((actual <= labelled) & (off <= band), "pass").when(off <= CURRENT_TOLERANCE, "needs_review").otherwise("fail")
    verdict = F.when(c("beverage_type") == "spirits", spirits).otherwise(F.when(off <= band, "pass").otherwise("fail"))
    return F.when(off.isNotNull() & band.isNotNull(), finding("alcohol_tolerance", verdict, X.fmt_pct(actual), X.fmt_pct(labelled)))


def check_alcohol_range() -> Column:
    r = c("_alcohol")
    ok = r["high"] - r["low"] <= F.when(r["high"] <= BOUNDARY, 3.0).otherwise(2.0)
    return F.when((c("beverage_type") == "wine") & r["low"].isNotNull(), finding("alcohol_range", F.when(ok, "pass").otherwise("fail"), None, c("label_alcohol")))


def check_proof() -> Column:
    r = c("_alcohol")
    return F.when((c("beverage_type") == "spirits") & r["proof"].isNotNull() & r["percent"].isNotNull(), finding("proof", F.when(F.abs(r["proof"] - 2 * r["percent"]) <= 0.01, "pass").otherwise("fail"), None, c("label_alcohol")))


def check_tax_class() -> Column:
    actual, labelled = c("actual_alcohol_content").cast("double"), c("_alcohol")["percent"]
    return F.when((c("beverage_type") == "wine") & ((actual <= BOUNDARY) != (labelled <= BOUNDARY)), finding("tax_class", "fail", X.fmt_pct(actual), X.fmt_pct(labelled)))


def _without_appellation() -> Column:
    return (c("beverage_type") == "wine") & blank(c("label_appellation"))


def check_vintage_appellation() -> Column:
    return F.when(_without_appellation() & P.vintage_year(c("label_vintage")).isNotNull(), finding("vintage_appellation", "fail", "An appellation of origin", c("label_vintage"), "A vintage needs an appellation"))


def check_varietal_appellation() -> Column:
    grapes = F.filter(F.coalesce("label_varietals", F.array().cast("array<string>")), lambda v: F.trim(v) != "")
    return F.when(_without_appellation() & (F.size(grapes) > 0), finding("varietal_appellation", "fail", "An appellation of origin", F.array_join(grapes, ", "), "A grape needs an appellation"))


def check_semi_generic() -> Column:
    """A semi-generic name needs an appellation, unless the label says that it comes from the name's own country."""
    e = c("_entry")
    own = (norm(e["produced_in"]) != "") & F.contains(norm(c("label_country_of_origin")), norm(e["produced_in"]))
    return F.when(_without_appellation() & (e["kind"] == "semi_generic") & ~F.coalesce(own, F.lit(False)), finding("semi_generic_appellation", "fail", "An appellation of origin with a semi-generic designation", c("label_class_type"), "A semi-generic designation needs an appellation"))


def check_vintage() -> Column:
    want, got = c("vintage_year"), P.vintage_year(c("label_vintage"))
    cases = [(want.isNull(), "needs_review", "A vintage that is not declared"), (got.isNull(), "fail", "The declared vintage is not on the label"), (want == got, "pass", None), (F.lit(True), "fail", "Another vintage than the declared one")]
    return F.when((c("beverage_type") == "wine") & (want.isNotNull() | got.isNotNull()), decided("vintage", cases, want, got))


def check_cocktail() -> Column:
    kind = norm(c("label_class_type"))
    hit = kind.rlike(f"(^| )({'|'.join(COCKTAILS)})( |$)")
    return F.when((c("beverage_type") == "spirits") & hit & ~F.contains(kind, F.lit("made with")), finding("cocktail", "fail", None, c("label_class_type")))


def _permitted(said: Column, row: dict) -> Column:
    """A statement (text, n) is in a form of the row."""
    forms = [F.contains(said["n"], F.lit(X.normalized(t))) | same(said["n"], F.lit(X.normalized(t))) for t in row.get("texts") or []]
    if row.get("pattern"):
        forms.append(F.startswith(said["n"], F.lit(X.normalized(row["pattern"]))))
    out = F.lit(False)
    for f in forms:
        out = out | f
    return out & (said["text"] == F.upper(said["text"])) if row.get("caps") else out


def check_disclosures(book: rulebook.Rulebook = rulebook.DEFAULT) -> Column:
    """An array of findings disclosure_<key>, one per row of the record's commodity."""
    out = []
    for row in book.of("disclosure"):
        flag = c(row["flag"]) if row.get("flag") else F.lit(None).cast("boolean")
        some = F.filter("_said", lambda s: F.exists(F.array(*map(F.lit, row["words"])), lambda w: F.contains(s["n"], w)))  # noqa: B023
        good = F.get(F.filter(some, lambda s: _permitted(s, row)), F.lit(0))["text"]  # noqa: B023
        found = F.coalesce(good, F.get(some, F.lit(0))["text"])
        cases = [(good.isNotNull() & F.coalesce(~flag, F.lit(False)), "needs_review", "Stated, but the formula has no such ingredient"), (good.isNotNull(), "pass", None), (found.isNotNull(), F.when(flag, "fail").otherwise("needs_review"), "Not in a permitted form" if not row.get("caps") else F.when(found == F.upper(found), "Not in a permitted form").otherwise("It must be in capital letters")),
                 (F.coalesce(flag, F.lit(False)), "fail", "The formula has the ingredient, so it must be stated"), (F.lit(row["key"] == "sulfites" and row.get("commodity") == "wine"), "needs_review", "No sulfite statement; only a laboratory waiver allows that"),
                 (F.coalesce(~flag, F.lit(False)), "pass", "The formula has no such ingredient"), (F.lit(True), "not_required", "Nothing is known of the formula, and nothing stated")]
        of = F.lit(True) if row.get("commodity") is None else c("beverage_type") == row["commodity"]
        out.append(F.when(of, decided(f"disclosure_{row['key']}", cases, (row.get("texts") or [row.get("pattern")])[0], found)))
    return F.filter(F.array(*out), lambda f: f.isNotNull()) if out else F.array()


def check_varietals() -> Column:
    """Sets of grape names: one not listed fails, one not on the label is for review, one with more words around it passes with a note."""
    none = F.array().cast("array<string>")
    want, got = (F.filter(F.coalesce(n, none), lambda v: F.trim(v) != "") for n in ("varietals", "label_varietals"))
    wider = lambda e, v: X.token_run(norm(v), norm(e)) & (norm(v) != norm(e))
    same = lambda e, v: (norm(v) == norm(e)) | wider(e, v)
    unlisted = F.filter(got, lambda v: ~F.exists(want, lambda e: same(e, v)))
    missing = F.filter(want, lambda e: ~F.exists(got, lambda v: same(e, v)))
    qualified = F.exists(got, lambda v: F.exists(want, lambda e: wider(e, v)))
    verdict = F.when(F.size(unlisted) > 0, "fail").when(F.size(missing) > 0, "needs_review").when(qualified, "pass_with_note").otherwise("pass")
    note = F.when(F.size(unlisted) > 0, F.concat(F.lit("On the label, but not declared: "), F.array_join(unlisted, ", "))).when(
        F.size(missing) > 0, F.concat(F.lit("Declared, but not on the label: "), F.array_join(missing, ", "))).when(
        qualified, "The label names a declared grape with more words around it")
    f = finding("varietals", verdict, F.array_join(want, ", "), F.array_join(got, ", "))
    return F.when((c("beverage_type") == "wine") & c("label_varietals").isNotNull() & (F.size(want) + F.size(got) > 0), f.withField("note", note))


#: Items that wine must carry on its brand label. Fixed values.
BRAND_LABEL_ITEMS = {"brand_name": "brand name", "class_type_designation": "class/type designation", "alcohol_statement": "alcohol content statement"}


def check_placement() -> Column:
    """Only where some field stands on a later page: items of the brand label that do are for review."""
    pages = c("label_field_pages")
    late = F.filter(F.array(*[F.when(F.try_element_at(pages, F.lit(k)) > 1, F.lit(v)) for k, v in BRAND_LABEL_ITEMS.items()]), lambda x: x.isNotNull())
    extracted = F.when(F.size(late) > 0, F.concat(F.lit("On the back label: "), F.array_join(late, ", "))).otherwise("All on the brand label")
    f = finding("brand_label_placement", F.when(F.size(late) > 0, "needs_review").otherwise("pass"), "Brand name, class/type designation, and alcohol content on the brand label", extracted)
    return F.when((c("beverage_type") == "wine") & F.exists(F.map_values(pages), lambda p: p > 1), f)


def classified(entries: Sequence[dict]) -> list[dict[str, Column]]:
    """What the designation checks read, in the order of their projections: the text read (the fanciful name where the class is blank and the name is a designation) and catalogue entries."""
    kind, fanciful = c("label_class_type"), c("label_fanciful_name")
    swap = blank(kind) & K.lookup(K.folded(fanciful), c("beverage_type"), entries).isNotNull()
    text = {"_swapped": swap}
    chosen = {"_class": F.when(c("_swapped"), fanciful).otherwise(kind)}
    found = {"_entry": K.lookup(K.folded(c("_class")), c("beverage_type"), entries), "_declared_entry": K.lookup(K.folded(c("declared_class_type")), c("beverage_type"), entries),
             "_other": K.other_commodity(K.folded(c("_class")), c("beverage_type"), entries),
             "_class_text": norm(c("_class")), "_declared_text": norm(c("declared_class_type"))}
    return [text, chosen, found]


def _holds(text: Column, words: Sequence[str]) -> Column:
    """One of the words (letters, digits and spaces) stands anywhere in text."""
    return F.coalesce(text.rlike("|".join(words)), F.lit(False))


def _specialty() -> Column:
    return _holds(c("_declared_text"), SPECIALTIES)


def check_class_type() -> Column:
    """In the catalogue: by whether the name is enough. Else a bare color or another commodity's name fails, and a grape with an appellation passes with a note."""
    e, text, wine = c("_entry"), c("_class_text"), F.coalesce(c("beverage_type") == "wine", F.lit(False))
    none = F.array().cast("array<string>")
    grapes = F.filter(F.transform(F.concat(F.coalesce("varietals", none), F.coalesce("label_varietals", none)), norm), lambda v: v != "")
    grape = wine & ~(blank(c("label_appellation")) & blank(c("appellation"))) & F.exists(grapes, lambda v: F.contains(text, v))
    known = F.when(e["sufficient"] == "true", F.when(c("_swapped"), "pass_with_note").otherwise("pass")).when(e["sufficient"] == "conditional", "needs_review").otherwise("fail")
    unknown = F.when((wine & text.isin(*COLORS)) | c("_other").isNotNull(), "fail").when(grape, "pass_with_note").otherwise("needs_review")
    verdict = F.when(blank(c("_class")), "needs_review").when(e.isNotNull(), known).otherwise(unknown)
    note = (F.when(blank(c("_class")), "No designation was read").when(e.isNotNull() & (e["sufficient"] == "true"), F.when(c("_swapped"), "The designation was read as the fanciful name"))
            .when(e["sufficient"] == "conditional", F.coalesce(e["note"], e["composition"], F.lit("Whether the name is enough needs a decision")))
            .when(e.isNotNull(), F.coalesce(e["composition"], F.lit("The name alone is not enough"))).when(wine & text.isin(*COLORS), "A color must be followed by Wine")
            .when(c("_other").isNotNull(), F.concat(F.lit("A designation of "), c("_other"))).when(grape, "A grape with an appellation").otherwise("Not in the catalogue"))
    return finding("class_type_designation", verdict, F.concat(F.lit("A recognized designation of "), c("beverage_type")), c("_class")).withField("note", note)


def check_origin_qualifier() -> Column:
    """A domestic product with a designation of foreign origin needs a word that says so."""
    e = c("_entry")
    foreign = e["qualifier"].isNotNull() & ~F.coalesce(c("imported"), F.lit(False)) & ~F.contains(F.coalesce(e["produced_in"], F.lit("")), F.lit("United States"))
    return F.when(foreign & ~_holds(c("_class_text"), QUALIFIERS), finding("designation_origin_qualifier", "fail", F.concat(c("_class"), F.lit(" type / American "), c("_class")), c("_class")).withField("note", e["qualifier"]))


def check_minimum_abv() -> Column:
    """The label's alcohol is not under the designation's least; specialties, cocktails and drinks with a spirit in them are exempt."""
    e, text, read = c("_entry"), c("_class_text"), c("_alcohol")["percent"]
    cocktail = F.contains(text, F.lit("made with")) & _holds(text, COCKTAILS)
    component = _holds(text, COMPONENTS) & F.exists(e["names"], lambda n: F.contains(text, n))
    verdict = F.when(c("alcohol_content").isNull(), "needs_review").otherwise("fail")
    return F.when((read < e["min_abv"]) & ~_specialty() & ~cocktail & ~component, finding("designation_minimum_abv", verdict, F.concat(F.lit("At least "), X.fmt_pct(e["min_abv"]), F.lit(" for "), c("_class")), X.fmt_pct(read)))


def check_abv_class() -> Column:
    """Wine of a designation with bounds of alcohol keeps within them."""
    text, read = c("_class_text"), F.coalesce(c("_alcohol")["percent"], _abv())
    inside, named = None, None
    for name, low, high, above, below in ABV_CLASSES:
        hit, ok = X.token_bounded(text, F.lit(name)), (read > low if above else read >= low) & (read < high if below else read <= high)
        inside, named = (F.when(hit, ok), F.when(hit, name)) if inside is None else (inside.when(hit, ok), named.when(hit, name))
    verdict = F.when(_abv().isNull() & c("actual_alcohol_content").isNull(), "needs_review").otherwise("fail")
    return F.when((c("beverage_type") == "wine") & c("_entry").isNotNull() & ~inside, finding("designation_abv_class", verdict, F.concat(named, F.lit(" within its limits of alcohol")), X.fmt_pct(read)))


def check_declared_class() -> Column:
    """For review where the label's designation neither says the declared class nor is the same entry, and the model's reading is not it either."""
    want, got = c("declared_class_type"), c("_class")
    same = F.coalesce(c("_entry")["entry"] == c("_declared_entry")["entry"], F.lit(False))
    fits = X.equivalent(want, got) | F.contains(c("_class_text"), c("_declared_text")) | same | X.equivalent(want, c("label_class_type_model"))
    return F.when(~blank(want) & ~blank(got) & ~fits, finding("declared_class_type", "needs_review", want, got, "The label's designation is not the declared one"))


def check_commodity_statement() -> Column:
    """Classes with neutral spirits must say the percentage and commodity (group 1) or what they are distilled from (group 2)."""
    kind, said = K.folded(c("label_class_type")), norm(c("label_commodity_statement"))
    one, two = (_holds(kind, STATEMENT_GROUPS[g]) for g in ("group_1", "group_2"))
    form = F.when(one, c("label_commodity_statement").rlike(r"\d+(\.\d+)?\s*%") & F.contains(said, F.lit("neutral spirits"))).otherwise(F.contains(said, F.lit("distilled from")))
    verdict = F.when(~blank(c("label_commodity_statement")) & form, "pass").otherwise("fail")
    wanted = F.when(one, "__% NEUTRAL SPIRITS DISTILLED FROM ___").otherwise("DISTILLED FROM ___")
    return F.when((c("beverage_type") == "spirits") & (one | two) & ~_specialty(), finding("commodity_statement", verdict, wanted, c("label_commodity_statement")))


def coverage_note(findings: Column, least: int = 3) -> Column:
    """A note where at least so many failing or open findings have nothing extracted; else null."""
    empty = F.filter(findings, lambda f: f["verdict"].isin("fail", "needs_review") & (F.trim(F.coalesce(f["extracted"], F.lit(""))) == ""))
    return F.when(F.size(empty) >= least, finding("artwork_quality", "pass_with_note", note="Some required items were not readable anywhere; a clearer picture may settle them"))


def duplicate_note() -> Column:
    """A note where duplicate_of names another record with the same artwork."""
    note = F.concat(F.lit("The same artwork stands with record "), c("duplicate_of"))
    return F.when(c("duplicate_of").isNotNull(), finding("duplicate_artwork", "pass_with_note", note="").withField("note", note))


#: Inputs that a table may lack: their checks then give nothing.
OPTIONAL = {"label_varietals": "array<string>", "label_field_pages": "map<string,int>", "duplicate_of": "string", "declared_class_type": "string", "label_class_type_model": "string", "label_commodity_statement": "string", "label_model_texts": "map<string,string>", "label_weak_fields": "array<string>",
            "label_field_confidences": "map<string,double>", "label_field_sources": "map<string,string>", "label_warning_paragraph": "boolean", "container_embossed_info": "string", **{k: "boolean" for k in DISCLOSURES}}


#: Name -> check, in the order of their findings. register_check adds more.
CHECKS: dict[str, Callable[[], Column]] = {
    "brand_name": lambda: ladder("brand_name", "Brand name"), "fanciful_name": lambda: ladder("fanciful_name", "Fanciful name"), "name_and_address": check_name_and_address, "country_of_origin": check_country,
    "warning_text": check_warning_text, "warning_prefix": check_warning_prefix, "warning_bold": check_warning_bold, "warning_paragraph": check_warning_paragraph, "net_contents": check_net_contents, "measurement_system": check_measurement_system,
    "standards_of_fill": check_standards_of_fill, "net_contents_form": check_malt_form, "alcohol_content": check_alcohol, "alcohol_tolerance": check_alcohol_tolerance, "alcohol_range": check_alcohol_range,
    "proof": check_proof, "tax_class": check_tax_class, "vintage_appellation": check_vintage_appellation, "varietal_appellation": check_varietal_appellation, "semi_generic_appellation": check_semi_generic, "vintage": check_vintage, "appellation": lambda: ladder("appellation", "Appellation"), "cocktail": check_cocktail,
    "varietals": check_varietals, "brand_label_placement": check_placement,
    "class_type_designation": check_class_type, "designation_origin_qualifier": check_origin_qualifier, "designation_minimum_abv": check_minimum_abv, "designation_abv_class": check_abv_class,
    "declared_class_type": check_declared_class, "commodity_statement": check_commodity_statement,
}
#: Checks that wine under PART_4_ABV skips.
PART_4 = ("net_contents", "measurement_system", "standards_of_fill", "net_contents_form", "alcohol_content", "alcohol_tolerance", "alcohol_range", "proof", "tax_class", "vintage_appellation", "varietal_appellation", "semi_generic_appellation", "vintage", "appellation", "varietals", "brand_label_placement",
          "class_type_designation", "designation_origin_qualifier", "designation_minimum_abv", "designation_abv_class", "declared_class_type")


def register_check(name: str, check: Callable[[], Column]) -> None:
    CHECKS[name] = check


#: Checks that read the rulebook.
BY_BOOK = {"measurement_system": check_measurement_system, "standards_of_fill": check_standards_of_fill, "alcohol_tolerance": check_alcohol_tolerance}


def evaluate(df: DataFrame, least_confidence: float = 0.5, entries: Sequence[dict] = tuple(K.DEFAULT), book: rulebook.Rulebook = rulebook.DEFAULT, only: Sequence[str] | None = None) -> DataFrame:
    """Adds findings and overall. Illegible records (label_legible false, or confidence under the least) get request_retake and no findings.

    entries: the designations, shipped or of catalogue.entries_of; book: sizes, tolerances, disclosures and citations, shipped or of rulebook.book_of. Every finding that the book cites has its citation.
    only: names of checks ("disclosures" for those); by default all, with the notes on the whole record."""
    lacking = {n: F.lit(None).cast(kind) for n, kind in OPTIONAL.items() if n not in df.columns}
    df = df.withColumns(lacking) if lacking else df
    outside = F.coalesce((c("beverage_type") == "wine") & (F.coalesce(_abv(), c("_alcohol")["percent"]) < PART_4_ABV), F.lit(False))
    made = {n: BY_BOOK[n](book) if f is BY_BOOK.get(n) else f() for n, f in CHECKS.items() if only is None or n in only}
    cols = {f"_{n}": (F.when(~outside, f) if n in PART_4 else f) for n, f in made.items()}
    staged = df.withColumns(parsed())
    stages = classified(entries)
    for stage in stages:
        staged = staged.withColumns(stage)
    helpers = [n for stage in stages for n in stage]
    staged = staged.withColumns(cols).withColumn("_coverage", F.when(outside, finding("part_4_coverage", "not_applicable")))
    staged = staged.withColumn("findings", F.concat(F.filter(F.array(*cols, "_coverage"), lambda f: f.isNotNull()), *([check_disclosures(book)] if only is None or "disclosures" in only else [])))
    notes = [F.filter(F.array(coverage_note(c("findings")), duplicate_note()), lambda f: f.isNotNull())] if only is None else []
    cited = lambda f: f.withField("citation", F.coalesce(f["citation"], F.when((f["field"] == "disclosure_sulfites") & (f["verdict"] == "needs_review") & f["extracted"].isNull(), book.citation(F.lit("missing_sulfites"), c("beverage_type"))), book.citation(f["field"], c("beverage_type"))))
    staged = staged.withColumn("findings", F.transform(F.concat("findings", *notes), cited))
    retake = ~F.coalesce(c("label_legible"), F.lit(True)) | F.coalesce(c("label_confidence") < least_confidence, F.lit(False))
    out = staged.drop(*cols, *parsed(), *helpers, "_coverage", *lacking).withColumn("findings", F.when(retake, F.slice("findings", 1, 0)).otherwise(c("findings")))
    return out.withColumn("overall", F.when(retake, "request_retake").otherwise(worst_of_array(c("findings"))))
