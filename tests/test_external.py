"""Slots that a model read."""

from veriframe.operators import external

BOX = "struct<x:int,y:int,width:int,height:int>"


def test_correct_slots(spark):
    rows = [(1, "brand_name", 0, "12% ALC/VOL", 1, (1, 1, 2, 2), "model"), (1, "fanciful_name", 1, "Old Oak Reserve", 1, None, "model"), (1, "net_contents", 2, "750 mL", 2, None, "model"), (1, "varietal:0", 3, " ", 1, None, "model"),
            (2, "brand_name", 0, "Fine Brand", 1, None, "model"), (3, "alcohol_statement", 0, "10-14% alc by vol", 1, None, "model")]
    slots = spark.createDataFrame(rows, f"id int, field string, pos int, text string, page int, bbox {BOX}, source string")
    declared = spark.createDataFrame([(1, "Old Oak", None, None, "750 ML", None, None, 12.0), (2, "fine brand", "Nothing Like It", None, None, None, None, None), (3, None, None, None, None, None, None, 12.0), (4, "x", None, None, None, None, None, 5.0)],
                                     "id int, brand_name string, fanciful_name string, declared_class_type string, net_contents string, country_of_origin string, appellation string, alcohol_content double")
    got = {(r.id, r.field): (r.text, r.source) for r in external.correct_slots(slots, declared, ["id"]).collect()}
    assert got == {(1, "brand_name"): ("Old Oak Reserve", "reconciled"), (1, "fanciful_name"): ("Old Oak Reserve", "model"), (1, "net_contents"): ("750 mL", "model"), (1, "varietal:0"): (" ", "model"),
                   (1, "alcohol_statement"): ("12% ALC/VOL", "reconciled"), (2, "brand_name"): ("Fine Brand", "model"), (3, "alcohol_statement"): ("10-14% alc by vol", "model")}


def test_ground_external(spark):
    lines = [("OLD OAK", 0, 0, 50, 10), ("13.5% ALC BY VOL", 0, 20, 60, 10), ("GOVERNMENT WARNING", 0, 40, 60, 10)]
    pages = spark.createDataFrame([(1, 1, 100, 100, lines), (1, 2, 100, 100, []), (2, 1, 100, 100, None)], "id int, page int, width int, height int, lines array<struct<text:string,x:int,y:int,width:int,height:int>>")
    rows = [(1, "brand_name", "Old 0ak", 1, None), (1, "alcohol_statement", "alcohol 13.5% by volume", 1, None), (1, "fanciful_name", "Nowhere", 2, (90, 90, 20, 20)), (1, "vintage", "2019", 1, (200, 0, 5, 5)), (1, "appellation", None, 1, None),
            (1, "government_warning", "GOVERNMENT WARNING according to the surgeon general women should not", 1, None), (2, "brand_name", "A", 1, None), (3, "brand_name", "B", None, None)]
    got = {(r.id, r.field): (r.text, r.bbox and r.bbox.y, r.bbox_source, r.source, r.model_text) for r in external.ground_external(spark.createDataFrame(rows, f"id int, field string, text string, page int, bbox {BOX}"), pages, ["id"]).collect()}
    assert got == {
        (1, "brand_name"): ("OLD OAK", 0, "ocr", "ocr_grounded", "Old 0ak"), (1, "alcohol_statement"): ("13.5% ALC BY VOL", 20, "ocr", "ocr_grounded", "alcohol 13.5% by volume"), (1, "fanciful_name"): (None, 90, "model", "vlm_region", "Nowhere"),
        (1, "vintage"): (None, 0, "model", "vlm_unsupported", "2019"), (1, "appellation"): (None, None, None, None, None), (2, "brand_name"): (None, None, None, "vlm_unsupported", "A"), (3, "brand_name"): (None, None, None, "vlm_unsupported", "B"),
        (1, "government_warning"): (None, None, None, "vlm_unsupported", "GOVERNMENT WARNING according to the surgeon general women should not")}


def test_overlay(spark):
    b = (1, 2, 3, 4)
    rows = [(1, "brand_name", "OLD", 1, b, "ocr"), (1, "class_type_designation", "Rum", None, b, "ocr"), (1, "vintage", "2019", 1, b, "model"), (1, "appellation", "X", 1, None, "ocr"), (1, "fanciful_name", "noise", 1, b, "ocr"),
            (1, "disclosure:sulfites", "CONTAINS SULFITES", 2, b, "ocr"), (1, "disclosure:x", "Contains sulfites.", 1, b, "ocr"), (1, "disclosure:wood", "5c deposit", 1, b, "ocr")]
    slots = spark.createDataFrame(rows, f"id int, field string, text string, page int, bbox {BOX}, bbox_source string")
    f = lambda n, v, x=None: (1, (n, v, "want", x, None, "note " + v))
    findings = spark.createDataFrame([f("brand_name", "pass"), f("class_type_designation", "pass", "Rum"), f("designation_minimum_abv", "fail", "35%"), f("declared_class_type", "fail", "zz"), f("vintage", "fail"), f("contains_sulfites_10ppm", "pass", "contains sulfites")],
                                     "id int, finding struct<field:string,verdict:string,expected:string,extracted:string,citation:string,note:string>")
    got = {r.slot: (r.field, r.page, r.verdict, r.extracted, r.n_checks) for r in external.overlay(slots, findings, ["id"]).collect()}
    assert got == {"brand_name": ("brand_name", 1, "pass", "OLD", 1), "class_type_designation": ("class_type_designation", 1, "fail", "35%", 3), "disclosure:sulfites": ("contains_sulfites_10ppm", 2, "pass", "CONTAINS SULFITES", 1)}
