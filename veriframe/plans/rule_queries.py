"""Queries of the rule catalogue by family: every part is a record and a label, and the SQL says which verdict each way of differing must have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.plans import rulebook, rules
from veriframe.plans.queries import query, t
from veriframe.tables import materialize

c, lit = F.col, F.lit
COMMODITIES = ("malt", "wine", "spirits")


def case(n: int) -> Column:
    """Which of n cases a part is. A function, as are the next two: columns need a session, and queries are registered before there is one."""
    return c("p_partkey") % n


def kinds() -> Column:
    return pick(COMMODITIES, case(3))


def sound() -> dict[str, Column]:
    """A record and label without faults; names of types where a column may be null."""
    return {
        "imported": lit(False), "brand_name": c("p_brand"), "label_brand_name": c("p_brand"), "fanciful_name": lit(None).cast("string"), "label_fanciful_name": lit(None).cast("string"), "applicant_name_address": lit("Stone Works LLC, Austin, TX"),
        "label_name_address": lit("Bottled by Stone Works, Austin, TX"), "country_of_origin": lit(None).cast("string"), "label_country_of_origin": lit(None).cast("string"), "label_warning": lit(rules.WARNING), "label_warning_bold": lit(True),
        "net_contents": lit("750 mL"), "label_net_contents": lit("750 ML"), "alcohol_content": lit(12.0), "actual_alcohol_content": lit(None).cast("double"), "label_alcohol": lit("ALC 12% BY VOL"), "label_class_type": lit("Table Wine"), "vintage_year": lit(None).cast("int"),
        "label_vintage": lit(None).cast("string"), "varietals": lit(None).cast("array<string>"), "label_varietals": lit(None).cast("array<string>"), "appellation": lit(None).cast("string"), "label_appellation": lit(None).cast("string"),
        "label_disclosures": F.array(lit("CONTAINS SULFITES")), "label_legible": lit(True), "label_confidence": lit(0.9), "label_model_texts": lit(None).cast("map<string,string>"), "label_weak_fields": lit(None).cast("array<string>"),
        "label_field_confidences": lit(None).cast("map<string,double>"), "label_field_sources": lit(None).cast("map<string,string>"), "label_warning_paragraph": lit(True), "container_embossed_info": lit(None).cast("string"),
        **{k: lit(None).cast("boolean") for k in rules.DISCLOSURES},
    }


def __getattr__(name: str) -> dict[str, Column]:
    """SOUND, made when it is asked for."""
    if name == "SOUND":
        return sound()
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")


def pick(values: Sequence, by: Column) -> Column:
    return F.element_at(F.array(*[v if isinstance(v, Column) else lit(v) for v in values]), (by + 1).cast("int"))


def findings(spark, d, fields: Sequence[str], changes: dict[str, Column], beverage: Column) -> DataFrame:
    """(p_partkey, field, verdict, citation) of some fields, on sound records with changes."""
    records = t(spark, d, "part").select("p_partkey", beverage.alias("beverage_type"), *[F.coalesce(changes[k], v).alias(k) if k in KEEP and k in changes else changes.get(k, v).alias(k) for k, v in sound().items()])
    # the outer form, as Spark copies what an inner explode reads into a filter below all checks; records are written first, so that the checks start from columns and not from what the columns are made of
    only = {"disclosures" if x.startswith("disclosure") else x for x in fields}
    f = rules.evaluate(materialize(records), only=only).select("p_partkey", F.explode_outer("findings").alias("f")).select("p_partkey", "f.field", "f.verdict", "f.citation")
    return f.filter(c("field").isin(*fields))


#: Columns where a case without a change of its own keeps what is sound.
KEEP = {"label_brand_name", "label_warning", "label_net_contents", "net_contents", "label_alcohol", "alcohol_content", "label_name_address", "label_class_type"}


def model(slot: str, text: Column) -> Column:
    return F.create_map(lit(slot), text)


def cite(field: str, commodity: str) -> str:
    return next(r["citation"] for r in rulebook.DEFAULT.rows if r["section"] == "citation" and r["key"] == field and r.get("commodity") in (None, commodity))


def sql_list(values) -> str:
    return "[" + ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def by_kind(field: str) -> str:
    return f"{sql_list(cite(field, k) for k in COMMODITIES)}[p_partkey % 3 + 1]"


@query(f"""select p_partkey, 'brand_name' field, {sql_list(["pass", "pass_with_note", "needs_review", "needs_review", "pass_with_note", "pass_with_note", "needs_review", "needs_review"])}[p_partkey % 8 + 1] verdict, {by_kind('brand_name')} citation from part""")
def rule_names(spark, d):
    """Brand names: exact, other case, missing, ambiguous, as the model read it, near at high and at low confidence, another name."""
    k, near = case(8), F.replace(c("p_brand"), lit("Bra"), lit("Bro"))
    return findings(spark, d, ["brand_name"], {
        "label_brand_name": pick([c("p_brand"), F.concat(F.upper("p_brand"), lit(" !")), lit(""), lit(" "), lit("Xyz"), near, near, c("p_type")], k), "label_weak_fields": F.when(k == 3, F.array(lit("brand_name"))), "label_model_texts": F.when(k == 4, model("brand_name", F.lower("p_brand"))),
        "label_field_confidences": F.when(k == 5, F.create_map(lit("brand_name"), lit(0.95))).when(k == 6, F.create_map(lit("brand_name"), lit(0.5)))}, kinds())


@query(f"""select p_partkey, 'fanciful_name' field, {sql_list(["pass", "pass_with_note", "needs_review", "needs_review"])}[p_partkey % 5 + 1] verdict, '{cite("fanciful_name", "wine")}' citation from part where p_partkey % 5 < 4""")
def rule_fanciful(spark, d):
    """Fanciful names: exact, spread over brand, class and name, spread but the name is missing, another; every fifth part declares none."""
    k = case(5)
    return findings(spark, d, ["fanciful_name"], {
        "fanciful_name": F.when(k == 0, c("p_name")).when(k < 3, F.concat("p_brand", lit(" golden river"))).when(k == 3, lit("golden river")), "label_fanciful_name": pick([c("p_name"), lit("RIVER"), lit(None).cast("string"), lit("silver lake"), lit("x")], k),
        "label_class_type": F.when(k.isin(1, 2), "Golden Table Wine")}, kinds())


@query(f"""select p_partkey, 'name_and_address' field, case when p_partkey % 7 = 1 then case when p_partkey % 3 = 0 then 'pass_with_note' else 'fail' end else {sql_list(["pass", None, "needs_review", "needs_review", "needs_review", "pass_with_note", "pass"])}[p_partkey % 7 + 1] end verdict, {by_kind('name_and_address')} citation from part
union all select p_partkey, 'country_of_origin', case when p_partkey % 7 < 5 then 'not_required' when p_partkey % 7 = 5 then 'needs_review' else case when p_partkey % 2 = 0 then 'pass' else 'fail' end end, {by_kind('country_of_origin')} from part""")
def rule_places(spark, d):
    """Applicants with and without a phrase, place or name, importers shortened and in full, and countries of origin."""
    k = case(7)
    said = pick([lit("Bottled by Stone Works Austin TX"), lit("Stone Works, Austin, Texas"), lit("Made by Stone Works"), lit("Bottled by Someone Else, Austin, TX"), lit(""), lit("Imported by Galaxy, Austin, TX"), lit("Imported by Galaxy Northern Imports, Austin, TX")], k)
    return findings(spark, d, ["name_and_address", "country_of_origin"], {
        "label_name_address": said, "imported": k >= 5, "applicant_name_address": F.when(k < 5, "Stone Works LLC, Austin, TX").otherwise("Galaxy Northern Trading Imports Inc, Austin, TX"), "country_of_origin": F.when(k >= 5, "France"),
        "label_country_of_origin": F.when(k == 6, F.when(case(2) == 0, "PRODUCT OF FRANCE").otherwise("Product of Italy"))}, kinds())


_W = ["pass", "needs_review", "needs_review", "pass_with_note", "pass_with_note", "needs_review", "needs_review", "fail", "pass"]


@query(f"""with w as (select p_partkey, p_partkey % 9 k from part) select p_partkey, 'warning_text' field, {sql_list(_W)}[k + 1] verdict, '{cite("warning_text", "malt")}' citation from w
union all select p_partkey, 'warning_prefix', {sql_list(["pass", None, None, "pass_with_note", "pass", "pass", "needs_review", "fail", "fail"])}[k + 1], '{cite("warning_prefix", "malt")}' from w where k not in (1, 2)
union all select p_partkey, 'warning_bold', 'needs_review', '{cite("warning_bold", "malt")}' from w where k in (0, 3) union all select p_partkey, 'warning_paragraph', 'needs_review', '{cite("warning_paragraph", "malt")}' from w where k in (6, 7)""")
def rule_warnings(spark, d):
    """Warnings: right, missing, ambiguous, as the model read it, with noise, cut off, read by the model alone, reworded, with a prefix in lower case; some not bold, some broken up."""
    k, w = case(9), rules.WARNING
    lower = w.replace("GOVERNMENT WARNING", "Government Warning")
    texts = [w, "", " ", "goverment xx", w.replace("machinery", "machinary"), " ".join(w.split(" ")[:-4]), lower.replace("birth", "birthday party"), lower.replace("birth ", ""), lower]
    return findings(spark, d, ["warning_text", "warning_prefix", "warning_bold", "warning_paragraph"], {
        "label_warning": pick(texts, k), "label_weak_fields": F.when(k == 2, F.array(lit("government_warning"))), "label_model_texts": F.when(k == 3, model("government_warning", lit(w))), "label_field_sources": F.when(k == 6, F.create_map(lit("government_warning"), lit("model"))),
        "label_warning_bold": F.when(k == 0, False).when(k == 3, lit(None).cast("boolean")).otherwise(True), "label_warning_paragraph": ~k.isin(0, 6, 7)}, kinds())


@query(f"""with p as (select p_partkey, p_partkey % 9 k, ['wine', 'spirits'][p_partkey % 2 + 1] kind from part), n as (select *, case kind when 'wine' then '{cite("net_contents", "wine")}' else '{cite("net_contents", "spirits")}' end citation from p)
select p_partkey, 'net_contents' field, {sql_list(["pass", "fail", "pass_with_note", "needs_review", "pass_with_note", "needs_review", "pass_with_note", "fail", "needs_review"])}[k + 1] verdict, citation from n
union all select p_partkey, 'standards_of_fill', case k when 0 then 'pass' when 6 then case kind when 'wine' then 'fail' else 'pass' end else case kind when 'wine' then 'fail' else 'needs_review' end end, citation from n where k in (0, 6, 7)
union all select p_partkey, 'measurement_system', 'fail', citation from n where k = 6""")
def rule_contents(spark, d):
    """Net contents of wine and spirits: equal, missing, embossed, ambiguous, not declared but printed, neither, right as the model read it, another size, unreadable."""
    k = case(9)
    return findings(spark, d, ["net_contents", "standards_of_fill", "measurement_system"], {
        "label_net_contents": pick(["750 mL", "", "", " ", "750 mL", "", "12 oz", "700 ml", "large"], k), "net_contents": F.when(k.isin(4, 5), "Not stated on application"), "container_embossed_info": F.when(k == 2, "Contents: 750 ml"),
        "label_weak_fields": F.when(k == 3, F.array(lit("net_contents"))), "label_model_texts": F.when(k == 6, model("net_contents", lit("750 mL")))}, pick(["wine", "spirits"], case(2)))


@query(f"""with p as (select p_partkey, p_partkey % 6 k from part) select p_partkey, 'net_contents_form' field, case k when 2 then 'pass_with_note' else 'fail' end verdict, '{cite("net_contents_form", "malt")}' citation from p where k in (1, 2, 4)
union all select p_partkey, 'measurement_system', 'needs_review', '{cite("measurement_system", "malt")}' from p where k = 5""")
def rule_forms(spark, d):
    """Malt beverages of a pint: said so, in ounces, in ounces but read as a pint by the model, a pint with ounces in brackets; a quart and some in ounces alone; litres."""
    k = case(6)
    return findings(spark, d, ["net_contents_form", "measurement_system"], {
        "label_net_contents": pick(["1 PINT", "16 FL OZ", "16 FL OZ", "1 PINT (16 FL OZ)", "32 FL. OZ.", "500 mL"], k), "net_contents": pick(["1 pint", "1 pint", "1 pint", "1 pint", "1 quart", "500 mL"], k), "label_model_texts": F.when(k == 2, model("net_contents", lit("1 pint"))),
        "label_class_type": lit("Lager")}, lit("malt"))


@query(f"""with p as (select p_partkey, p_partkey % 7 k, p_partkey % 3 b from part), a as (select p_partkey, case k when 0 then 'pass' when 1 then 'fail' when 2 then {sql_list(["not_required", "not_required", "fail"])}[b + 1] when 3 then 'needs_review' when 4 then {sql_list(["not_required", "needs_review", "needs_review"])}[b + 1] when 6 then 'pass' end verdict, k, b from p)
select p_partkey, 'alcohol_content' field, verdict, {by_kind('alcohol_content')} citation from a where k <> 5
union all select p_partkey, 'alcohol_tolerance', {sql_list(["fail", "pass", "fail"])}[b + 1], {by_kind('alcohol_tolerance')} from a where k = 6
union all select p_partkey, 'alcohol_range', 'fail', '{cite("alcohol_range", "wine")}' from a where k = 3 and b = 1 union all select p_partkey, 'proof', 'fail', '{cite("proof", "spirits")}' from a where k = 1 and b = 2""")
def rule_alcohol(spark, d):
    """Alcohol: equal, another with a wrong proof, missing, a wide range, ambiguous, not declared, and an actual percentage 0.5 above the label's."""
    k = case(7)
    return findings(spark, d, ["alcohol_content", "alcohol_tolerance", "alcohol_range", "proof"], {
        "label_alcohol": pick(["ALC 12% BY VOL", "ALC. 11% BY VOL (20 PROOF)", "", "9% to 13% by volume", "", "ALC 12% BY VOL", "ALC 12% BY VOL"], k), "actual_alcohol_content": F.when(k == 6, 12.5), "label_weak_fields": F.when(k == 4, F.array(lit("alcohol_statement"))),
        "alcohol_content": F.when(k != 5, 12.0), "label_class_type": F.when(k == 4, "Sparkling Wine")}, kinds()).filter(~((k == 5) & (c("field") == "alcohol_content")))


@query(f"""with p as (select p_partkey, p_partkey % 8 k from part) select p_partkey, 'vintage_appellation' field, 'fail' verdict, '{cite("vintage_appellation", "wine")}' citation from p where k = 0
union all select p_partkey, 'varietal_appellation', 'fail', '{cite("varietal_appellation", "wine")}' from p where k = 1 union all select p_partkey, 'semi_generic_appellation', 'fail', '{cite("semi_generic_appellation", "wine")}' from p where k in (2, 3)
union all select p_partkey, 'vintage', {sql_list(["needs_review", None, None, None, None, "pass", "fail", "fail"])}[k + 1], '{cite("vintage", "wine")}' from p where k in (0, 5, 6, 7)
union all select p_partkey, 'designation_origin_qualifier', 'fail', '{cite("designation_origin_qualifier", "wine")}' from p where k in (2, 6) and false union all select p_partkey, 'class_type_designation', 'pass', '{cite("class_type_designation", "wine")}' from p""")
def rule_wines(spark, d):
    """Wines: a vintage, a grape and semi-generic names without appellation, champagne of France, vintages that agree, differ and are missing, a protected place."""
    k = case(8)
    return findings(spark, d, ["vintage_appellation", "varietal_appellation", "semi_generic_appellation", "vintage", "class_type_designation"], {
        "label_class_type": pick(["Table Wine", "Table Wine", "Burgundy", "Champagne", "Champagne", "Red Wine", "Pouilly-Fuissé", "Rioja"], k), "label_vintage": pick(["2019", None, None, None, None, "2019", "2018", None], k),
        "vintage_year": F.when(k.isin(5, 6, 7), 2019), "label_varietals": F.when(k == 1, F.array(lit("Merlot"))), "varietals": F.when(k == 1, F.array(lit("Merlot"))), "appellation": F.when(k >= 5, "Napa"), "label_appellation": F.when(k >= 5, "Napa"),
        "label_country_of_origin": F.when(k == 4, "Product of France").when(k == 3, "Product of Spain")}, lit("wine"))


_D = {r["commodity"] + r["key"]: r["citation"] for r in rulebook.DEFAULT.of("disclosure")}


@query(f"""with p as (select p_partkey, p_partkey % 8 k, p_partkey % 3 b from part) select p_partkey, 'disclosure_sulfites' field, case k when 0 then 'pass' when 1 then 'needs_review' when 2 then 'fail' when 3 then 'needs_review' when 4 then 'fail' when 5 then case b when 1 then 'needs_review' else 'pass' end else case b when 1 then 'needs_review' else 'not_required' end end verdict,
 case when b = 1 and k in (5, 6, 7) then '{cite("missing_sulfites", "wine")}' else {sql_list(_D[k + "sulfites"] for k in COMMODITIES)}[b + 1] end citation from p
union all select p_partkey, 'disclosure_aspartame', case k when 6 then 'pass' when 7 then 'needs_review' else 'not_required' end, '{_D["maltaspartame"]}' from p where b = 0""")
def rule_disclosures(spark, d):
    """Sulfites: stated, stated though absent, due but missing, in another form, in another form though due, known to be absent, unknown; aspartame in capitals and not."""
    k = case(8)
    said = pick(["CONTAINS SULFITES", "Contains sulfites", "", "may have sulfite", "sulphite inside", "", "PHENYLKETONURICS: CONTAINS PHENYLALANINE.", "Phenylketonurics: contains phenylalanine."], k)
    return findings(spark, d, ["disclosure_sulfites", "disclosure_aspartame"], {"label_disclosures": F.array(said, lit("other words")), "contains_sulfites_10ppm": F.when(k.isin(2, 4), True).when(k.isin(1, 5), False)}, kinds())
