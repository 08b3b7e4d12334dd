"""The catalogue of designations, its checks and the rules that read it."""

import pytest
from pyspark.sql import functions as F

from veriframe.plans import catalogue as K
from veriframe.plans import rules


def test_shipped_catalogue_is_sound(spark):
    dim = spark.createDataFrame(K.DEFAULT, K.ENTRY)
    assert K.violations(dim).count() == 0
    assert K.entries_of(dim) == sorted(({**dict.fromkeys(x.split()[0] for x in K.ENTRY.split(", ")), **e} for e in K.DEFAULT), key=lambda e: (e["commodity"], e["entry"]))


def test_violations_and_load(spark, tmp_path):
    bad = [{"commodity": "tea", "entry": 1, "names": ["a"], "kind": "x", "sufficient": "true"}, {"commodity": "wine", "entry": 1, "names": [], "kind": " ", "sufficient": "maybe", "min_abv": 0.0},
           {"commodity": "wine", "entry": 1, "names": ["ok", " "], "kind": "x", "sufficient": "false"}, {"commodity": None, "entry": None, "names": None, "kind": None, "sufficient": None}]
    got = {(r.commodity, r.entry, r.problem) for r in K.violations(spark.createDataFrame(bad, K.ENTRY)).collect()}
    assert ("tea", 1, "unknown commodity") in got and ("wine", 1, "entry number repeated") in got and ("wine", 1, "blank name") in got and (None, None, "entry number missing") in got
    assert {p for c, e, p in got if c == "wine"} == {"names must not be empty", "kind missing", "sufficient must be true, false or conditional", "least alcohol must be positive", "blank name", "entry number repeated"}
    with pytest.raises(ValueError):
        K.entries_of(spark.createDataFrame(bad, K.ENTRY))
    spark.createDataFrame([{"commodity": "malt", "entry": 0, "names": ["Old Style Whiskey"], "kind": "type", "sufficient": "true"}], K.ENTRY).write.json(str(tmp_path / "c"))
    entries = K.entries_of(K.load(spark, str(tmp_path / "c")))
    assert entries[0]["names"] == ["old style whisky"]
    with pytest.raises(ValueError):
        K.entries_of(K.load(spark, str(tmp_path / "c")), most=0)
    got = spark.range(1).select(K.lookup(F.lit("fine old style whisky"), F.lit("malt"), entries)["entry"], K.lookup(F.lit("stout"), F.lit("malt"), entries)["entry"]).first()
    assert tuple(got) == (0, None)


COLUMNS = ("id string, beverage_type string, imported boolean, brand_name string, fanciful_name string, applicant_name_address string, net_contents string, country_of_origin string, alcohol_content double, actual_alcohol_content double, "
           "appellation string, vintage_year int, varietals array<string>, declared_class_type string, label_brand_name string, label_fanciful_name string, label_name_address string, label_country_of_origin string, label_warning string, "
           "label_warning_bold boolean, label_net_contents string, label_alcohol string, label_class_type string, label_class_type_model string, label_appellation string, label_vintage string, label_disclosures array<string>, "
           "label_commodity_statement string, label_legible boolean, label_confidence double, " + ", ".join(f"{k} boolean" for k in rules.DISCLOSURES))
CASES = {
    "exact": ({"beverage_type": "spirits", "label_class_type": "Vodka", "label_alcohol": "ALC 40% BY VOL", "alcohol_content": 40.0, "label_commodity_statement": "100% Neutral Spirits distilled from grain"},
              {"class_type_designation": "pass", "commodity_statement": "pass"}),
    "contained": ({"beverage_type": "spirits", "label_class_type": "Kentucky Straight Bourbon Whiskey", "label_alcohol": "38% ALC/VOL", "alcohol_content": 38.0}, {"class_type_designation": "pass", "designation_minimum_abv": "fail"}),
    "no declared alcohol": ({"beverage_type": "spirits", "label_class_type": "Rum", "label_alcohol": "ALC 35% BY VOL"}, {"class_type_designation": "pass", "designation_minimum_abv": "needs_review"}),
    "component": ({"beverage_type": "spirits", "label_class_type": "Rum Punch", "label_alcohol": "ALC 10% BY VOL", "alcohol_content": 10.0}, {"class_type_designation": "pass"}),
    "specialty": ({"beverage_type": "spirits", "label_class_type": "Gin", "declared_class_type": "Gin Specialties", "label_alcohol": "ALC 10% BY VOL"}, {"class_type_designation": "pass"}),
    "conditional": ({"beverage_type": "spirits", "label_class_type": "Fine Whiskey"}, {"class_type_designation": "needs_review"}),
    "no statement": ({"beverage_type": "spirits", "label_class_type": "Blended Whiskey", "label_commodity_statement": "neutral spirits"}, {"class_type_designation": "pass", "commodity_statement": "fail"}),
    "group 2": ({"beverage_type": "spirits", "label_class_type": "Distilled Gin", "label_commodity_statement": "Distilled from corn"}, {"class_type_designation": "pass", "commodity_statement": "pass"}),
    "foreign": ({"beverage_type": "malt", "label_class_type": "Munich", "imported": False}, {"class_type_designation": "pass", "designation_origin_qualifier": "fail"}),
    "qualified": ({"beverage_type": "malt", "label_class_type": "Munich Type Lager"}, {"class_type_designation": "pass"}),
    "imported": ({"beverage_type": "malt", "label_class_type": "Munich", "imported": True}, {"class_type_designation": "pass"}),
    "at home too": ({"beverage_type": "malt", "label_class_type": "Pilsner"}, {"class_type_designation": "pass"}),
    "swapped": ({"beverage_type": "malt", "label_fanciful_name": "Oatmeal Stout"}, {"class_type_designation": "pass_with_note"}),
    "blank": ({"beverage_type": "malt"}, {"class_type_designation": "needs_review"}),
    "not enough": ({"beverage_type": "malt", "label_class_type": "Half and Half"}, {"class_type_designation": "fail"}),
    "color": ({"beverage_type": "wine", "label_class_type": "Red"}, {"class_type_designation": "fail"}),
    "other": ({"beverage_type": "wine", "label_class_type": "Bourbon Whiskey"}, {"class_type_designation": "fail"}),
    "grape": ({"beverage_type": "wine", "label_class_type": "Old Merlot", "varietals": ["Merlot"], "appellation": "Napa", "label_appellation": "Napa"}, {"class_type_designation": "pass_with_note"}),
    "unknown": ({"beverage_type": "wine", "label_class_type": "Old Merlot", "varietals": ["Merlot"]}, {"class_type_designation": "needs_review"}),
    "class limit": ({"beverage_type": "wine", "label_class_type": "California Table Wine", "label_alcohol": "ALC 15% BY VOL", "alcohol_content": 15.0}, {"class_type_designation": "pass", "designation_abv_class": "fail"}),
    "no limit known": ({"beverage_type": "wine", "label_class_type": "Dessert Wine", "label_alcohol": "ALC 14% BY VOL"}, {"class_type_designation": "pass", "designation_abv_class": "needs_review"}),
    "declared": ({"beverage_type": "spirits", "label_class_type": "Aged Rum", "declared_class_type": "Rum"}, {"class_type_designation": "pass"}),
    "same entry": ({"beverage_type": "spirits", "label_class_type": "Mezcal", "declared_class_type": "Mescal"}, {"class_type_designation": "pass"}),
    "another": ({"beverage_type": "spirits", "label_class_type": "Rum", "declared_class_type": "Brandy"}, {"class_type_designation": "pass", "declared_class_type": "needs_review"}),
    "model read it": ({"beverage_type": "spirits", "label_class_type": "Rum", "declared_class_type": "Brandy", "label_class_type_model": "BRANDY"}, {"class_type_designation": "pass"}),
    "under 7": ({"beverage_type": "wine", "label_class_type": "Red", "label_alcohol": "ALC 5% BY VOL", "declared_class_type": "Cider"}, {}),
    "no commodity": ({"label_class_type": "Rum"}, {"class_type_designation": "needs_review"}),
}
NAMES = {"class_type_designation", "designation_origin_qualifier", "designation_minimum_abv", "designation_abv_class", "declared_class_type", "commodity_statement"}


def test_designation_rules(spark):
    names = [x.strip().split(" ")[0] for x in COLUMNS.split(", ")]
    df = spark.createDataFrame([tuple(({"id": k} | v).get(n) for n in names) for k, (v, _) in CASES.items()], COLUMNS)
    out = rules.evaluate(df)
    assert set(out.columns) == {*names, "findings", "overall"}
    got = {r.id: {f.field: f.verdict for f in r.findings if f.field in NAMES} for r in out.collect()}
    assert got == {k: want for k, (_, want) in CASES.items()}
