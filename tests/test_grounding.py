"""Grounding, roles, decisions and notes on small tables."""

from pyspark.sql import functions as F

from veriframe.operators import grounding, joins, lifecycle, roles
from veriframe.plans import rules
from veriframe.sources import ingest

WORDS = "array<struct<text:string,x:int,y:int,width:int,height:int>>"


def page(*texts, step=30):
    return [(w, step * i, 0, 20, 10) for i, w in enumerate(texts)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_best(words, target):
    """The best window by brute force: (score, start, stop)."""
    best, low, high = (-1.0, 0, 0), int(len(target) * 0.7), -int(-len(target) * 1.3 // 1)
    for s in range(len(words)):
        for e in range(s + 1, len(words) + 1):
            text = "".join(words[s:e])
            if low <= len(text) <= high:
                score = 1 - edits(text, target) / max(len(text), len(target))
                if score > best[0]:
                    best = (score, s + 1, e)
    return best


def test_best_window_is_brute_force(spark):
    cases = [("OLD OAK RESERVE ALE FROM OLD OAK", "OLD OAK"), ("D R A U G H T BEER", "DRAUGHT"), ("OAK OLD 0LD OAKS", "OLD OAK"), ("A BB CCC DDDD", "CCD")]
    df = spark.createDataFrame([(i, page(*w.split()), x) for i, (w, x) in enumerate(cases)], f"id int, words {WORDS}, target string")
    for r in grounding.explain(df, "words", "target", 1).collect():
        w, x = cases[r.id]
        score, start, stop = plain_best(w.split(), x.replace(" ", ""))
        assert (round(r.score, 9), r.start, r.stop) == (round(score, 9), start, stop)


def test_best_window_fused_and_empty(spark):
    data = [(1, page("XXOAKSIDEXX", "ALE"), "OAKSIDE"), (2, page("TEDDY LOVES IPA"), "loves ipa!"), (3, [], "A"), (4, None, "A"), (5, page("A"), None), (6, page("A", None), ""), (7, page("NOTHING"), "ELSE ALTOGETHER")]
    got = {r.id: r.match for r in grounding.best_window(spark.createDataFrame(data, f"id int, words {WORDS}, target string"), "words", "target").collect()}
    assert got[1].fused and got[1].text == "OAKSIDE" and got[1].words == [0]
    assert not got[2].fused and got[2].text == "LOVES IPA" and got[2].words == [0] and (got[2].start, got[2].stop) == (2, 3)
    assert all(got[i] is None for i in (3, 4, 5, 6, 7))


def test_gapped_match(spark):
    data = [(1, page("4.1%", "BEER", "ALC./VOL."), "4.1% alc./vol."), (2, page("4.1%", "BEER", "ALC./VOL.", step=300), "4.1% alc./vol."), (3, page("4.1%"), "4.1% alc./vol.")]
    got = {r.id: r.match for r in grounding.gapped_match(spark.createDataFrame(data, f"id int, words {WORDS}, target string"), "words", "target").collect()}
    assert got[1].score == 1.0 and got[2] is None and got[3] is None


def test_missing_expected(spark):
    e = spark.createDataFrame([(1, "OLD OAK"), (1, "RED ALE"), (2, "PORTER"), (3, None)], "id int, want string")
    p = spark.createDataFrame([(1, page("X")), (1, page("OLD", "OAK"))], f"id int, words {WORDS}")
    assert sorted(map(tuple, grounding.missing_expected(e, p, ["id"], "want", "words").select("id", "want").collect())) == [(1, "RED ALE"), (2, "PORTER")]


def test_combine_pages(spark):
    p = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 2, 1), (2, 2, 1)], "id int, slot int, page int")
    assert sorted(tuple(r) for r in grounding.combine_artwork_pages(p, ["id"], "slot", "page").select("id", "slot", "page").collect()) == [(1, 1, 1), (1, 1, 2), (1, 2, 3), (2, 2, 1)]


def test_front_and_back(spark):
    a = [(1, 0, "back.jpg", None), (1, 1, "front.png", None), (2, 0, "a.jpg", None), (2, 1, "b.jpg", None), (3, 0, "form.pdf", "front"), (4, 0, "x bk.jpg", "front"), (4, 1, "y.jpeg", "Brand (front)")]
    got = roles.pick_front_back(spark.createDataFrame(a, "id int, i int, name string, kind string"), ["id"], "i", "name", "kind")
    assert sorted(map(tuple, got.collect())) == [(1, "front.png", "back.jpg"), (2, "a.jpg", None), (4, "y.jpeg", "x bk.jpg")]
    r = spark.createDataFrame([(1, "back.jpg", "front.jpg"), (2, "front.jpg", "back.jpg"), (3, "a.jpg", "b.jpg"), (4, "rear.jpg", "b.jpg"), (5, None, "front.jpg")], "id int, front string, back string")
    pairs = {x.id: (x.front, x.back) for x in r.collect()}
    fixed = {x.id: (x.front, x.back) for x in roles.repair_slots(r, "id").collect()}
    assert fixed[1] == ("front.jpg", "back.jpg") and all(fixed[i] == pairs[i] for i in (2, 3, 4, 5))
    assert spark.range(1).select(roles.role_conflict(F.lit("back.jpg"), F.lit("Brand (front)"))).first()[0]


def test_manifest_errors(spark):
    df = spark.createDataFrame([("a", '[{"ttbId": "1"}]'), ("b", '{"ttbId": "1"}'), ("c", "[{"), ("d", None), ("e", "[]")], "file string, text string")
    assert sorted((r.file, r.kind) for r in ingest.manifest_errors(df).collect()) == [("b", "not_array"), ("c", "unreadable"), ("d", "not_array")]


def test_infer_files_order(spark):
    f = spark.createDataFrame([("7-10.jpg",), ("7-2.PNG",), ("7-1.pdf",), ("77-1.jpg",), (None,)], "name string")
    got = {r.s: r.files for r in joins.infer_files(spark.createDataFrame([("7",), ("8",)], "s string"), "s", f, "name").collect()}
    assert got == {"7": ["7-2.PNG", "7-10.jpg"], "8": []}


def test_decisions_and_fallback(spark):
    h = spark.createDataFrame([(1,), (2,)], "id int")
    d = spark.createDataFrame([(1, 1, "approved", "n", "t"), (1, 2, None, "n", "t"), (2, 1, "rejected", "n", "t"), (9, 1, "approved", "n", "t")], "id int, seq int, decision string, decision_note string, decided_at string")
    assert sorted(map(tuple, lifecycle.apply_decisions(h, d, "id", ["seq"]).collect())) == [(1, None, None, None), (2, "rejected", "n", "t")]
    kind = "id int, overall string, findings array<struct<verdict:string>>"
    first = spark.createDataFrame([(1, "pass", [("pass",)]), (2, "fail", [("fail",)]), (3, "request_retake", []), (4, "pass", None)], kind)
    second = spark.createDataFrame([(1, "b", []), (2, "b", []), (3, "b", []), (5, "b", [])], kind)
    got = lifecycle.accept_or_fallback(first, second, "id").select("id", "overall", "fell_back").collect()
    assert sorted(map(tuple, got)) == [(1, "pass", False), (2, "b", True), (3, "b", True), (4, "pass", False), (5, "b", True)]


def test_notice(spark):
    f = F.array(rules.finding("net_contents", "needs_review", "750 mL"), rules.finding("brand_name", "fail", "A", "B", "differs"), rules.finding("x", "pass"))
    text = spark.range(1).select(lifecycle.rejection_notice(f, F.lit("S1"), F.lit("A"), F.lit("wine"), F.lit("Co"), F.lit(None).cast("timestamp"), F.lit(" "))).first()[0]
    assert "Date of decision: pending" in text and "Product type: Wine" in text and "REVIEWER" not in text
    assert text.index("1. Brand") < text.index("Does not conform") < text.index("On the label: B") < text.index("   differs") < text.index("2. Net") < text.index("On the label: not found")


def test_varietals_placement_and_notes(spark):
    data = [(["Merlot"], ["MERLOT"], None), (["Merlot"], ["Old Vine Merlot"], None), (["Merlot"], ["Syrah"], {"brand_name": 2}), (["Merlot", "Syrah"], ["Syrah"], {"vintage": 2})]
    df = spark.createDataFrame(data, "varietals array<string>, label_varietals array<string>, label_field_pages map<string,int>").withColumn("beverage_type", F.lit("wine"))
    got = df.select(rules.check_varietals()["verdict"], rules.check_placement()["verdict"]).collect()
    assert [tuple(r) for r in got] == [("pass", None), ("pass_with_note", None), ("fail", "needs_review"), ("needs_review", "pass")]
    empty = F.array(*[rules.finding(n, "fail") for n in "abc"])
    assert spark.range(1).select(rules.coverage_note(empty)["verdict"]).first()[0] == "pass_with_note"
    assert spark.range(1).select(rules.coverage_note(F.slice(empty, 1, 2))).first()[0] is None
