"""From extraction payloads to the facts that the rules read, and from findings to what a page shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions import parsers as P
from veriframe.functions.text import abv_terms, equivalent, normalize, presence, search_terms, strip
from veriframe.operators.latest import severity, worst_of_array

#: Slots that give a fact of their own, those whose earlier reading is kept, and sources of slots that were not read.
TEXT_FACTS = {"brand_name": "brand_name", "fanciful_name": "fanciful_name", "class_type_designation": "class_type_designation", "alcohol_statement": "alcohol_statement", "net_contents": "net_contents",
              "name_address_statement": "name_address_statement", "country_of_origin_statement": "country_of_origin_statement", "government_warning_text": "government_warning", "appellation": "appellation", "commodity_statement": "commodity_statement"}
MODEL_TEXTS = ("brand_name", "fanciful_name", "class_type_designation", "net_contents", "government_warning", "appellation")
UNREAD = ("vlm_unsupported", "vlm_region")
WEAK = 0.75
PROMOTABLE = ("exact", "equivalent")
UNRESOLVED = ("fail", "needs_review")
GROUPS = {"failed": ("fail",), "needs_review": ("needs_review",), "passing": ("pass", "pass_with_note"), "informational": ("not_required", "not_applicable")}


def dedupe_text(texts: Column) -> Column:
    """Texts stripped, without blank ones, the first of those that are equal when normalised."""
    pairs = F.filter(F.transform(texts, lambda t: F.struct(normalize(t).alias("n"), strip(t).alias("t"))), lambda x: F.coalesce(x["t"] != "", F.lit(False)))
    once = F.filter(F.transform(pairs, lambda x, i: F.when(F.array_position(F.transform(pairs, lambda y: y["n"]), x["n"]) == i + 1, x["t"])), lambda t: t.isNotNull())
    return F.coalesce(once, F.array().cast("array<string>"))


def keyed_map(entries: Column, key: str) -> Column:
    """A map of structs by one of their texts: blank keys are left out, of equal keys the later entry counts."""
    good = F.filter(entries, lambda e: F.coalesce(F.trim(e[key]) != "", F.lit(False)))
    keys = F.transform(good, lambda e: F.trim(e[key]))
    last = F.filter(F.transform(good, lambda e, i: F.struct(F.trim(e[key]).alias("key"), e.alias("value"), i.alias("i"))), lambda x: ~F.array_contains(F.slice(keys, x["i"] + 2, F.greatest(F.size(keys), F.lit(1))), x["key"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], x["value"])))


def put_if_blank(slots: Column, key: Column, slot: Column) -> Column:
    """The map with slot under key, unless the one there has a text or slot is null."""
    taken = presence(F.try_element_at(slots, key)["text"]).isNotNull()
    return F.when(taken | slot.isNull(), slots).otherwise(F.map_concat(F.map_filter(slots, lambda k, _: k != key), F.map_from_arrays(F.array(key), F.array(slot))))


def append_if_new(slots: Column, slot: Column) -> Column:
    """The array with slot behind it, unless one of an equivalent text is there or slot is null."""
    return F.when(slot.isNull() | F.exists(slots, lambda s: equivalent(s["text"], slot["text"])), slots).otherwise(F.concat(slots, F.array(slot)))


def promotable(slot: Column, key: Column, statement: str, prefix: str) -> Column:
    """Evidence (match_status, visible, verbatim_text) may fill the slot of key; the warning only with the statutory text."""
    text = slot["verbatim_text"]
    good = slot["match_status"].isin(*PROMOTABLE) & slot["visible"] & presence(text).isNotNull()
    return F.coalesce(good & ((key != "government_warning") | P.compare_statement(text, statement, prefix)["text_matches"]), F.lit(False))


def to_facts(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """payloads with a column for each fact. payload: struct(fields map<string, slot>, disclosures, varietals arrays of slots, warning_attributes
    struct(prefix_bold, continuous_paragraph), legible, confidence); a slot is struct(text, model_text, page, confidence, source, bbox_source). Whatever lacks is null or empty; legible is true by default."""
    p = F.col(payload)
    fields = F.coalesce(p["fields"], F.expr(f"map_filter({payload}.fields, (k, v) -> false)"))
    slot = lambda k: F.try_element_at(p["fields"], F.lit(k))
    picked = lambda f: F.map_filter(F.transform_values(fields, lambda _, s: f(s)), lambda _, v: v.isNotNull())
    texts = lambda c: dedupe_text(F.transform(F.coalesce(p[c], F.expr(f"slice({payload}.{c}, 1, 0)")), lambda s: s["text"]))
    cols = {name: presence(slot(k)["text"]) for name, k in TEXT_FACTS.items()}
    cols |= {"warning_prefix_bold": p["warning_attributes"]["prefix_bold"], "warning_continuous_paragraph": p["warning_attributes"]["continuous_paragraph"], "disclosures": texts("disclosures"), "varietals": texts("varietals"),
             "vintage_year": P.vintage_year(slot("vintage")["text"], slot("vintage")["model_text"]), "model_texts": F.map_filter(picked(lambda s: presence(s["model_text"])), lambda k, _: k.isin(*MODEL_TEXTS)),
             "field_pages": picked(lambda s: F.when(s["page"] > 0, s["page"])), "field_confidences": picked(lambda s: s["confidence"]), "field_sources": picked(lambda s: F.coalesce(presence(s["source"]), presence(s["bbox_source"]))),
             "legible": F.coalesce(p["legible"], F.lit(True)), "confidence": p["confidence"]}
    return payloads.withColumns(cols)


def weak_field(field: Column, sources: Column, confidences: Column) -> Column:
    """The slot was not read, or with little confidence."""
    return F.coalesce(F.try_element_at(sources, field).isin(*UNREAD), F.lit(False)) | F.coalesce(F.try_element_at(confidences, field) < WEAK, F.lit(False))


def apply_adjudications(findings: DataFrame, key: str, findings_col: str, adjudications: DataFrame, note: str = "The expected value was seen; its exact text could not be read. ") -> DataFrame:
    """findings with open findings passed, with a note, where an adjudication of the same key and field says present, and overall taken anew.

    adjudications: (key, field, status, reason), gathered to one small map a key."""
    seen = adjudications.filter("status = 'present'").groupBy(key, "field").agg(F.max("reason").alias("reason"))
    seen = seen.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", F.coalesce("reason", F.lit("")).alias("reason"))))).alias("_seen"))
    said = lambda f: F.try_element_at(F.col("_seen"), f["field"])
    passed = lambda f: f.withField("verdict", F.lit("pass_with_note")).withField("extracted", F.lit("present")).withField("note", F.concat(F.lit(note), said(f)))
    made = F.transform(findings_col, lambda f: F.when(f["verdict"].isin(*UNRESOLVED) & said(f).isNotNull(), passed(f)).otherwise(f))
    out = findings.join(seen.hint("merge"), key, "left").withColumn(findings_col, made).drop("_seen")
    return out.withColumn("overall", worst_of_array(F.col(findings_col)))


def group_findings(findings: Column) -> Column:
    """struct of GROUPS: the findings of each, worst first, in their order of equals."""
    ranked = F.transform(F.array_sort(F.transform(findings, lambda f, i: F.struct((-severity(f["verdict"])).alias("s"), i.alias("i"), f.alias("f")))), lambda x: x["f"])
    def of(verdicts):
        return F.filter(ranked, lambda f: f["verdict"].isin(*verdicts))

    return F.struct(*[of(vs).alias(n) for n, vs in GROUPS.items()])


def expected_fields(declared: DataFrame, key: str, texts: list[str], alcohol: str | None = None, lists: list[str] | None = None) -> DataFrame:
    """(key, field, value, terms): one row for each declared value, with the spellings to search; blank values and sentinels have none, each element of a list has one."""
    from veriframe.functions.text import not_stated

    row = lambda f, v, terms: F.struct(F.lit(f).alias("field"), v.alias("value"), terms.alias("terms"))
    value = lambda c: F.when(~not_stated(F.col(c)), presence(F.col(c)))
    rows = F.array(*[row(c, value(c), search_terms(value(c))) for c in texts])
    if alcohol:
        rows = F.concat(rows, F.array(row(alcohol, F.col(alcohol).cast("string"), abv_terms(F.col(alcohol)))))


    def elements(c: str) -> Column:
        return F.coalesce(F.transform(c, lambda v: row(c, presence(v), search_terms(presence(v)))), F.slice(rows, 1, 0))

    rows = F.concat(rows, *[elements(c) for c in lists or []])
    return declared.select(key, F.explode(F.filter(rows, lambda r: r["value"].isNotNull())).alias("r")).select(key, "r.*")
