"""Queue tabs, decisions, data quality and evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.text import field_label
from veriframe.operators import ranks
from veriframe.operators.latest import latest_per_key, severity


def state_for(verdict: Column) -> Column:
    return F.when(verdict.isin("pass", "pass_with_note"), "passed").when(verdict == "fail", "failed").when(verdict == "error", "error").otherwise("needs_review")


def tab_for(verdict: Column, decision: Column) -> Column:
    """decided, unchecked, ready (may be approved) or review."""
    return F.when(decision.isNotNull(), "decided").when(verdict.isNull() | (verdict == "error"), "unchecked").when(verdict.isin("pass", "pass_with_note"), "ready").otherwise("review")


def reviewable(verdict: Column, decision: Column) -> Column:
    return verdict.isNotNull() & (verdict != "error") & decision.isNull()


def search(df: DataFrame, cols: Sequence[str], q: str | None) -> DataFrame:
    """Rows with q in any of cols, in any case; a blank q keeps all."""
    if not (q or "").strip():
        return df
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(q.strip().lower())), F.lit(False))
    return df.filter(hit)


def sort_history(df: DataFrame, key: str, direction: str, tie: str, keys: Sequence[str], default: str) -> DataFrame:
    """By key and tie, both falling with desc; an unknown key is the default, falling."""
    key, direction = (key, direction) if key in keys else (default, "desc")
    turn = (lambda c: F.col(c).desc()) if direction == "desc" else (lambda c: F.col(c).asc())
    return df.orderBy(turn(key), turn(tie))


def findings_text(findings: Column) -> Column:
    """field: note (citation) of all that did not plainly pass, parted by bars."""
    some = F.filter(findings, lambda f: severity(f["verdict"]) > 2)
    return F.array_join(F.transform(some, lambda f: F.concat(f["field"], F.lit(": "), F.coalesce(f["note"], F.lit("")), F.lit(" ("), F.coalesce(f["citation"], F.lit("")), F.lit(")"))), " | ")


def top_findings(findings: Column, n: int) -> Column:
    ranked = F.array_sort(F.transform(findings, lambda f, i: F.struct((-severity(f["verdict"])).alias("s"), i.alias("i"), f.alias("f"))))
    return F.slice(F.transform(ranked, lambda x: x["f"]), 1, n)


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())


def mutate(df: DataFrame, serial: str, changes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(serial, mutation, value): one row per change (when, value) that applies; serials end in -MUT- and its name."""
    made = F.array(*[F.when(when, F.struct(F.lit(n).alias("mutation"), v.cast("string").alias("value"))) for n, (when, v) in changes.items()])
    m = df.select(serial, F.explode(F.filter(made, lambda x: x.isNotNull())).alias("m"))
    return m.select(F.concat(F.col(serial).cast("string"), F.lit("-MUT-"), F.col("m.mutation")).alias("serial"), "m.mutation", "m.value")


def pair_mutants(df: DataFrame, serial: str) -> DataFrame:
    return df.withColumns({"parent": F.regexp_extract(serial, r"\A(.+)-MUT-([A-Z]+)\z", 1), "kind": F.regexp_extract(serial, r"\A(.+)-MUT-([A-Z]+)\z", 2)}).filter("parent <> ''")


def rate(part: Column, whole: Column) -> Column:
    """Percent with one decimal, n/a of nothing."""
    return F.when(whole == 0, "n/a").otherwise(F.format_string("%.1f", F.round(part * 100.0 / whole, 1)))


def attempt_report(df: DataFrame, state: str, wait: str) -> DataFrame:
    """Long metrics (metric, name, value): states, and the wait's distribution by nearest rank."""
    states = df.groupBy(F.col(state).alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit("state").alias("metric"), "name", "value")
    d = ranks.distribution(df, [], wait, 10).withColumn("count", F.col("count").cast("double"))
    return states.union(d.unpivot([], ["count", "min", "p50", "p95", "max"], "name", "value").select(F.lit("wait").alias("metric"), "name", "value"))


def apply_decisions(history: DataFrame, decisions: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """history with decision, decision_note, decided_at of the newest decision on each key; a null decision undoes the ones before it.

    Decisions on keys that history does not have (records out of sight) have no effect."""
    new = latest_per_key(decisions, [key], order)
    clear = F.col("decision").isNull()
    new = new.select(key, "decision", *[F.when(~clear, F.col(c)).alias(c) for c in ("decision_note", "decided_at")])
    return history.drop("decision", "decision_note", "decided_at").join(new, key, "left")


def revalidation_copy(df: DataFrame, declared: Sequence[str], channel: str = "revalidation", source: str = "id") -> DataFrame:
    """New records of the declared columns alone, with the channel and the id they come from."""
    return df.select(*declared, F.lit(channel).alias("channel"), F.col(source).alias("source_id"))


def accept_or_fallback(first: DataFrame, second: DataFrame, key: str, overall: str = "overall", findings: str = "findings") -> DataFrame:
    """first's row unless it needs a retake, has a failing finding or is absent; else second's. Adds fell_back; keys are unique in each.

    Where second has no row for such a key, it has no result."""
    ok = (F.coalesce(F.col(overall), F.lit("request_retake")) != "request_retake") & ~F.coalesce(F.exists(findings, lambda f: f["verdict"] == "fail"), F.lit(False))
    good = first.filter(ok)
    return good.withColumn("fell_back", F.lit(False)).unionByName(second.join(good.select(key), key, "left_anti").withColumn("fell_back", F.lit(True)))


def rejection_notice(findings: Column, serial: Column, brand: Column, product: Column, applicant: Column, decided_at: Column, note: Column) -> Column:
    """Text of a draft notice: the record, failing findings before those to review, and the reviewer's note."""
    flagged = F.concat(F.filter(findings, lambda f: f["verdict"] == "fail"), F.filter(findings, lambda f: f["verdict"] == "needs_review"))
    line = lambda label, c: F.when(F.trim(c) != "", F.concat(F.lit(f"   {label}"), c))

    def item(f: Column, i: Column) -> Column:
        framing = F.when(f["verdict"] == "fail", "Does not conform").otherwise("Requires correction or clarification")
        head = F.concat((i + 1).cast("string"), F.lit(". "), field_label(f["field"]), F.lit(" - "), framing, F.lit("."))
        seen = F.when(F.trim(f["extracted"]) != "", f["extracted"]).otherwise("not found")
        return F.concat_ws("\n", head, line("On the application: ", f["expected"]), line("On the label: ", seen), line("", f["note"]), line("Reference: ", f["citation"]))

    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    # Fixed wording.
    header = F.concat(F.lit("DRAFT REJECTION NOTICE (prototype - not an official TTB communication)\n\nApplication serial number: "), text(serial), F.lit("\nBrand name: "), text(brand), F.lit("\nProduct type: "), text(F.initcap(product)),
                      F.lit("\nApplicant: "), text(applicant), F.lit("\nDate of decision: "), F.coalesce(F.date_format(decided_at, "MMMM d, yyyy"), F.lit("pending")),
                      F.lit("\n\nThe label submitted with this application cannot be approved as filed.\nThe findings below identify each item, the problem observed, and the\nrule it concerns."))
    none = F.lit("No individual label findings were cited; see the reviewer note below.")
    body = F.concat(F.lit("FINDINGS\n\n"), F.when(F.coalesce(F.size(flagged), F.lit(0)) > 0, F.array_join(F.transform(flagged, item), "\n\n")).otherwise(none))
    said = F.when(F.trim(note) != "", F.concat(F.lit("REVIEWER NOTE\n\n"), note))
    footer = F.lit("A corrected label may be resubmitted with the same application serial\nnumber. Each finding above cites the Beverage Alcohol Manual rule or\nregulation it concerns; where the manual and current regulations\ndiffer, the finding says so.")
    return F.concat(F.concat_ws("\n\n", header, body, said, footer), F.lit("\n"))
