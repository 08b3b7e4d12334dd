"""The rulebook as a table: loading and checking it, new rows that change findings, and citations of every finding."""

import json

import pytest
from pyspark.sql import functions as F

from veriframe.plans import rule_queries, rulebook, rules


def test_book_is_a_table(spark, tmp_path):
    table = rulebook.to_table(spark)
    assert rulebook.violations(table, ["brand_name", "net_contents", "alcohol_content", "class_type_designation"]).count() == 0
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "book.json").write_text("\n".join(json.dumps({k: v for k, v in r.items() if v is not None}) for r in rulebook.DEFAULT.rows))
    again = rulebook.book_of(rulebook.load(spark, str(tmp_path / "b")))
    assert sorted(again.numbers("fill", "wine")) == sorted(rulebook.DEFAULT.numbers("fill", "wine")) and len(again.rows) == len(rulebook.DEFAULT.rows)
    with pytest.raises(ValueError):
        rulebook.book_of(table, most=3)


@pytest.mark.parametrize("row, problem", [
    ({"section": "fill", "commodity": "wine", "number": -1.0}, "size must be positive"), ({"section": "odd"}, "unknown section"), ({"section": "fill", "commodity": "tea", "number": 5.0}, "unknown commodity"), ({"section": "system", "commodity": "malt", "key": "old"}, "unknown system"),
    ({"section": "disclosure", "commodity": "wine", "key": "x", "words": ["x"], "citation": "c"}, "no permitted form"), ({"section": "citation", "key": " ", "citation": "x"}, "citation: key missing"), ({"section": "citation", "commodity": "wine", "key": "brand_name", "citation": "y"}, "stated twice")])
def test_violations(spark, row, problem):
    book = rulebook.Rulebook((*rulebook.DEFAULT.rows, row))
    assert problem in {r.problem for r in rulebook.violations(rulebook.to_table(spark, book)).collect()}


def test_new_rows_are_new_rules(spark):
    p = spark.createDataFrame([(1, "Stone")], "p_partkey int, p_brand string")
    sound = rule_queries.SOUND | {"label_net_contents": F.lit("640 mL"), "net_contents": F.lit("640 mL"), "actual_alcohol_content": F.lit(13.0), "label_disclosures": F.array(F.lit("MADE WITH NUTS"))}
    record = p.select(F.lit("wine").alias("beverage_type"), *[v.alias(k) for k, v in sound.items()])
    more = rulebook.Rulebook((*[r for r in rulebook.DEFAULT.rows if r["section"] != "tolerance"], {"section": "fill", "commodity": "wine", "number": 640.0}, {"section": "tolerance", "commodity": None, "number": 0.1},
                              {"section": "disclosure", "commodity": "wine", "key": "nuts", "texts": ["MADE WITH NUTS"], "words": ["nuts"], "citation": "NUT 1"}))
    only = ["standards_of_fill", "alcohol_tolerance", "disclosures"]
    old, new = ({f.field: (f.verdict, f.citation) for f in rules.evaluate(record, only=only, book=b).first().findings} for b in (rulebook.DEFAULT, more))
    assert (old["standards_of_fill"][0], new["standards_of_fill"][0]) == ("fail", "pass") and (old["alcohol_tolerance"][0], new["alcohol_tolerance"][0]) == ("pass", "fail")
    assert "disclosure_nuts" not in old and new["disclosure_nuts"] == ("pass", "NUT 1")
    every = rules.evaluate(record).first().findings
    assert len(every) > 10 and all(f.citation for f in every), [f.field for f in every if not f.citation]
