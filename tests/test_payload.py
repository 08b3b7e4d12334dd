"""Slots of small pages, alone and as one table."""

from pyspark.sql import functions as F

from veriframe.operators import payload

PAGE = "id int, page int, height int, beverage_type string, words array<struct<text:string,x:int,y:int,width:int,height:int>>"
DECLARED = ("id int, beverage_type string, brand_name string, fanciful_name string, appellation string, vintage_year int, net_contents string, country_of_origin string, declared_class_type string, "
            "applicant_name_address string, varietals array<string>")


def line(y, *words):
    return [(w, 10 * i, y, 9, 10) for i, w in enumerate(words)]


FRONT = line(0, "OLD", "OAK") + line(20, "Straight", "Rye", "Whiskey") + line(40, "ALC", "45%", "BY", "VOL") + line(60, "serving", "12", "oz") + line(80, "750", "ML")
BACK = line(0, "Contains", "Sulfites") + line(20, "RIVER", "OF", "the", "GREAT") + line(60, "Bottled by Old Oak Distilling LLC") + line(75, "Austin, Texas 78701 USA") + line(150, "Merlot") + line(170, "100%", "neutral", "spirits")
PAGES = [(1, 1, 400, "spirits", FRONT), (1, 2, 400, "spirits", BACK), (2, 1, 100, "wine", []), (3, 1, 100, None, None), (4, 1, 100, "wine", line(0, "Made by", "Someone") + line(15, "Old", "Red", "Wine", None))]


def by(df, *cols):
    return {tuple(r[c] for c in ("id", *cols)): r.text for r in df.collect()}


def test_statements(spark):
    p = spark.createDataFrame(PAGES, PAGE)
    assert by(payload.alcohol_slot(p, ["id"]), "page") == {(1, 1): "ALC 45%"}
    assert by(payload.net_contents_slot(p, ["id"]), "page") == {(1, 1): "12 oz"}  # the serving's word is outside the shortest window
    assert by(payload.commodity_slot(p, ["id"]), "page") == {(1, 2): "neutral spirits"}
    assert by(payload.disclosure_slots(p, ["id"]), "key") == {(1, "sulfites"): "Sulfites"}
    assert by(payload.recognised_class(p, ["id"]), "page") == {(1, 1): "Straight Rye Whiskey", (4, 1): "Old Red Wine"}


def test_split_name(spark):
    p = spark.createDataFrame(PAGES, PAGE)
    d = spark.createDataFrame([(1, "Great River of the"), (2, "a b c"), (3, "x y z"), (4, None)], "id int, fanciful_name string")
    assert by(payload.locate_split(d, p, ["id"]), "page") == {(1, 2): "Great River of the"}
    s = spark.createDataFrame([(1, "fanciful_name", "Grat River", 1, None, None, "model")], "id int, field string, text string, page int, bbox struct<x:int,y:int,width:int,height:int>, model_text string, bbox_source string")
    r = payload.reconcile_split(s, d, p, ["id"]).collect()
    assert [(x.text, x.model_text, x.page) for x in r] == [("Great River of the", "Grat River", 2)]


def test_varietals(spark):
    p = spark.createDataFrame(PAGES, PAGE)
    d = spark.createDataFrame([(1, ["merlot", "Malbec", "MERLOT"]), (2, ["x"]), (3, None)], "id int, varietals array<string>")
    old = spark.createDataFrame([(1, 0, "Syrah", 1, None), (2, 0, "syrah", 1, None), (2, 1, "SYRAH", 1, None)], "id int, pos int, text string, page int, bbox struct<x:int,y:int,width:int,height:int>")
    assert by(payload.varietal_slots(d, p, ["id"], old), "pos") == {(1, 0): "Syrah", (1, 1): "Merlot", (2, 0): "syrah"}


def test_trim_address(spark):
    rows = [("By X, Austin, TX 78701 USA", "Austin", "TX"), ("By X Austin Texas now", "Austin", "TX"), ("By X", "Austin", "TX"), ("By X, TX", None, None), (None, "a", "TX"), ("Santa Fe, New Mexico here", "Santa Fe", "NM")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, c string, s string").select(payload.trim_address(F.col("t"), F.col("c"), F.col("s"))).collect()]
    assert got == ["By X, Austin, TX", "By X Austin Texas", "By X", "By X, TX", None, "Santa Fe, New Mexico"]


def test_build(spark):
    d = [(1, "spirits", "Old Oak", "Great River of the", None, None, "750 mL", None, "Rye Whiskey Specialty", "Old Oak Distilling LLC, Austin, TX", ["Merlot"]), (2, "wine", "A", None, None, None, None, None, None, None, None),
         (3, None, None, None, None, None, None, None, None, None, None), (4, "wine", None, None, None, None, None, None, "Zinfandel", "Nobody Inc, Reno, NV", []), (5, "malt", "B", None, None, None, None, None, "Ale", None, None)]
    p = spark.createDataFrame(PAGES, PAGE)
    slots, records = payload.build_payload(spark.createDataFrame(d, DECLARED), p, ["id"])
    got = by(slots, "field")
    assert got[1, "brand_name"] == "OLD OAK" and got[1, "fanciful_name"] == "Great River of the" and got[1, "net_contents"] == "750 ML" and got[1, "class_type_designation"] == "Rye Whiskey"
    assert got[1, "name_address_statement"] == "Bottled by Old Oak Distilling LLC Austin, Texas" and got[1, "varietal:0"] == "Merlot" and got[1, "disclosure:sulfites"] == "Sulfites"
    assert got[4, "class_type_designation"] == "Old Red Wine" and got[4, "name_address_statement"].startswith("Made by")
    assert {k[0] for k in got} == {1, 4} and slots.count() == len(got)
    assert {(r.id, r.legible, r.confidence) for r in records.collect()} == {(1, True, 0.75), (2, False, 0.0), (3, False, 0.0), (4, True, 0.75), (5, False, 0.0)}
