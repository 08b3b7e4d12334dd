"""Golden values of the text functions and parsers."""

import pytest
from pyspark.sql import functions as F

from veriframe.functions import parsers as P
from veriframe.functions import text as X
from veriframe.plans import rules

c = F.col("x")


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("r")).first().r


@pytest.mark.parametrize("value, expr, expected", [
    ("\t a \n", X.strip(c), "a"), ("  ", X.presence(c), None), ("N/A ", X.not_stated(c), True), (None, X.not_stated(c), False), ("", X.not_stated(c), False),
    ("Château—Né", X.normalize(c), "chateau ne"), ("Stone's  THROW", X.normalize_ascii(c), "stone s throw"), ("a-\n b", X.join_hyphens(c), "ab"), ("15 5 GALLONS", X.repair_decimal(c), "15.5 GALLONS"),
    ("M A D E", X.collapse_spaced_words(c), "MADE"), ("Authorization: Bearer abc.def", X.redact(c), "Authorization: Bearer [REDACTED]"), ('{"api_key": "abc123"}', X.redact(c), '{"api_key": "[REDACTED]"}'), ("a sk-abcdefgh1 b", X.redact(c), "a [REDACTED] b"), ("Kentucky Whisky", X.commodity_of(c), "spirits"), ("paper", X.commodity_of(c), None), ("Tawny PORT", X.commodity_of(c), "wine"), ("Sherry", X.commodity_of(c), "wine"), ("Double IPA", X.commodity_of(c), "malt"), ("portion", X.commodity_of(c), None),
    ("Yes", X.tri_bool(c), True), (" ", X.tri_bool(c), None), ("40.00", X.trim_decimal(c), "40"), ("12.50", X.trim_decimal(c), "12.5"), ("brand_name", X.field_label(c), "Brand name"), ("a/b/C.PNG", X.content_type(c), "image/png"),
    ("a/b.c", X.basename(c), "b.c"), ("N°5 % ab", X.match_norm(c), "N 5 % AB"), ("irish whiskey", X.fold_whisky(c), "irish whisky"),
    ("about 2019 or 2020", P.vintage_year(c), 2019), ("none", P.vintage_year(c), None), ("12 FL. OZ.", P.has_unit_system(c, "us"), True), ("45% Alc/Vol", P.is_alcohol(c), True),
])
def test_scalar(spark, value, expr, expected):
    assert one(spark, value, expr) == expected


@pytest.mark.parametrize("value, percent, low, high, proof", [
    ("ALC. 45% BY VOL (90 PROOF)", 45.0, None, None, 90.0), ("11% to 14% by volume", None, 11.0, 14.0, None), ("80 proof", None, None, None, 80.0)])
def test_alcohol(spark, value, percent, low, high, proof):
    r = one(spark, value, P.parse_alcohol(c))
    assert (r.percent, r.low, r.high, r.proof) == (percent, low, high, proof)


def test_no_alcohol(spark):
    assert one(spark, "red wine", P.parse_alcohol(c)) is None


@pytest.mark.parametrize("value, ml, system", [("750 mL", 750.0, "metric"), ("1 pint 8 fl oz", 709.7647, "us"), ("12 FL OZ (355 mL)", 354.8824, "us"), ("600 gallons", 2271247.0704, "us"), ("1 1/4 gallons and 1 qt", 5678.1177, "us"), ("15 5 GALLONS", 58673.8827, "us"), ("5 2 l.", 5200.0, "metric"), ("2 750 mL", 750.0, "metric"), ("1.5 L", 1500.0, "metric")])
def test_volume(spark, value, ml, system):
    r = one(spark, value, P.parse_volume(c))
    assert (r.milliliters, r.unit_system) == (ml, system)


@pytest.mark.parametrize("value", ["", "no size", None, "750 mL and 2 gallons"])
def test_no_volume(spark, value):
    assert one(spark, value, P.parse_volume(c)) is None


def test_address(spark):
    r = one(spark, "Old Tom Co., Louisville, KY 40202", P.parse_name_address(c))
    assert (r.name, r.city, r.state) == ("Old Tom Co.", "Louisville", "KY")
    assert one(spark, "Old Tom Distilling Co. LLC", P.name_tokens(c)) == ["old", "tom", "distilling"]
    assert one(spark, "Kentucky", P.parse_name_address(c)).state is None


def test_statement(spark):
    said = rules.WARNING.replace("machinery", "machin ery")
    r = one(spark, said, P.compare_statement(c, rules.WARNING, rules.PREFIX))
    assert r.text_matches and r.prefix_all_caps
    r = one(spark, rules.WARNING.replace("birth ", ""), P.compare_statement(c, rules.WARNING, rules.PREFIX))
    assert not r.text_matches and r.missing_words == ["birth"]
    assert one(spark, ["a", "a", "b"], P.bag_minus(c, F.array(F.lit("b"))), "array<string>") == ["a", "a"]


@pytest.mark.parametrize("a, b, near", [("Stone Throw", "Stona Throw", True), ("abc", "abd", False), ("Stone Throw", "StoneThrow", False), ("", "", False), (None, "x", False)])
def test_near(spark, a, b, near):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(X.near_equivalent(F.col("a"), F.col("b")).alias("r")).first().r is near
