"""Slots on small pages."""

from veriframe.operators import slots

PAGE = "id int, page int, words array<struct<text:string,x:int,y:int,width:int,height:int>>"
SLOT = "id int, field string, text string, page int, bbox struct<x:int,y:int,width:int,height:int>, model_text string, bbox_source string"


def pages(spark):
    one = [("Old", 0, 0, 10, 5), ("Oak", 20, 2, 10, 5), ("Product of France", 0, 20, 90, 5)]
    two = [("OLD OAK", 5, 5, 50, 5), ("Government", 0, 30, 10, 5), ("warning:", 20, 30, 10, 5)]
    return spark.createDataFrame([(1, 1, one), (1, 2, two), (2, 1, [("GOVERNMENT WARNING: (1) According", 1, 1, 9, 9), ("to", 0, 9, 1, 1)]), (3, 1, None), (4, 1, [])], PAGE)


def test_ground(spark):
    s = [(1, "brand", "old oak", None, None, None, "model"), (1, "x", "else", 1, None, None, None), (1, "kept", "old oak", 1, (1, 1, 1, 1), None, "ocr"), (3, "b", "a", 1, None, None, None), (9, "b", None, 1, None, None, None)]
    got = {(r.id, r.field): (r.bbox and tuple(r.bbox), r.bbox_source) for r in slots.ground(spark.createDataFrame(s, SLOT), pages(spark), ["id"]).collect()}
    assert got == {(1, "brand"): ((0, 0, 30, 7), "ocr"), (1, "x"): (None, "model"), (1, "kept"): ((1, 1, 1, 1), "ocr"), (3, "b"): (None, "model"), (9, "b"): (None, "model")}


def test_locate_and_reconcile(spark):
    e = spark.createDataFrame([(1, "brand", "OLD OAK"), (1, "country", "france"), (1, "vintage", "Not stated on application"), (2, "brand", None), (3, "brand", "A")], "id int, field string, expected string")
    found = slots.locate_declared(e, pages(spark), ["id"])
    assert sorted((r.id, r.field, r.text, r.page) for r in found.collect()) == [(1, "brand", "Old Oak", 1), (1, "country", "FRANCE", 1)]
    whole = slots.locate_declared(e.filter("field = 'country'"), pages(spark), ["id"], whole_lines=True)
    assert [r.text for r in whole.collect()] == ["Product of France"]
    s = spark.createDataFrame([(1, "brand", "O1d Oak", 1, None, None, "model"), (1, "other", "x", 1, None, "m", "model")], SLOT)
    got = {r.field: (r.text, r.model_text, r.bbox_source) for r in slots.reconcile_declared(s, found, ["id"]).collect()}
    assert got == {"brand": ("Old Oak", "O1d Oak", "ocr"), "country": ("FRANCE", None, "ocr"), "other": ("x", "m", "model")}


def test_warning_slot(spark):
    got = {r.id: (r.text, r.page, tuple(r.bbox)) for r in slots.warning_slot(pages(spark), ["id"]).collect()}
    assert got == {1: ("Government warning:", 2, (0, 30, 30, 5)), 2: ("GOVERNMENT WARNING: (1) According", 1, (1, 1, 9, 9))}
