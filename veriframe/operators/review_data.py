"""Data quality and evaluation: quarantine reasons, where records come from, changes to make, mutated records and their scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions import parsers as P
from veriframe.operators.latest import latest_per_key, tally, tally_elements, worst_of_array
from veriframe.operators.lifecycle import rate, reasons
from veriframe.operators.roles import role

#: Names of reasons, of batches and serials by source, of mutations with the check that must flag each.
REASONS = ("identical_front_back_artwork", "primary_artwork_filename_indicates_back", "back_artwork_filename_indicates_front", "primary_artwork_filename_indicates_neck_or_collar", "artwork_checksum_shared_across_applications")
BATCH_SOURCES = ((r"(?i)\ATTB registry eval\b", "registry_eval"), (r"(?i)\AMutations of ", "mutation"), (r"\ATTB registry sample\z", "seed_sample"))
KEPT_SOURCES = ("mutation", "registry_eval", "seed_sample", "batch_upload")
DEMO_SERIAL, MUTANT = "DEMO-RETAKE", r"\A(.+)-MUT-([A-Z]+)\z"
EXPECTED_FLAGS = {"BRAND": "brand_name", "NET": "net_contents", "ABV": "alcohol_content", "FANCIFUL": "fanciful_name", "ORIGIN": "country_of_origin"}
SENTINEL = "Not stated on application"
CLEAN, FLAGGED = ("pass", "pass_with_note"), ("needs_review", "fail")


def shared_checksums(artworks: DataFrame, key: str, checksum: str, kind: str, exempt: str = "mutation") -> DataFrame:
    """Checksums that records of more than one key have, those of the exempt source not counted."""
    rows = artworks.filter(~F.coalesce(F.col(kind) == exempt, F.lit(False)) & F.col(checksum).isNotNull())
    return rows.groupBy(checksum).agg(F.count_distinct(key).alias("owners")).filter("owners > 1")


def quarantine_reasons(records: DataFrame, key: str, front: str, back: str, front_sum: str, back_sum: str, kind: str, exempt: str = "mutation") -> DataFrame:
    """records with reasons, in the order of REASONS; records of the exempt source have none.

    A shared checksum is found by a map-side count and two joins on it, of the few checksums that are shared."""
    long = records.select(key, kind, F.explode(F.array(front_sum, back_sum)).alias("_sum"))
    shared = shared_checksums(long, key, "_sum", kind, exempt).select("_sum")
    marked = records
    for c, name in ((front_sum, "_front_shared"), (back_sum, "_back_shared")):
        marked = marked.join(shared.select(F.col("_sum").alias(f"{name}_key"), F.lit(True).alias(name)).hint("merge"), F.col(c) == F.col(f"{name}_key"), "left").drop(f"{name}_key")
    yes = lambda c: F.coalesce(c, F.lit(False))
    found = [yes(F.col(front_sum) == F.col(back_sum)), yes(role(F.col(front)) == "back"), yes(role(F.col(back)) == "front"), yes(F.col(front).rlike(r"(?i)\b(neck|collar)\b")), yes(F.col("_front_shared")) | yes(F.col("_back_shared"))]
    made = F.when(yes(F.col(kind) == exempt), F.array().cast("array<string>")).otherwise(reasons(dict(zip(REASONS, found))))
    return marked.withColumn("reasons", made).drop("_front_shared", "_back_shared")


def batch_source(name: Column, kind: Column) -> Column:
    out = None
    for pattern, source in BATCH_SOURCES:
        out = F.when(name.rlike(pattern), source) if out is None else out.when(name.rlike(pattern), source)
    return out.otherwise(F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.lit("batch_upload")))


def record_source(serial: Column, batch: Column, kind: Column) -> Column:
    """batch: the batch's source, null without one."""
    own = F.coalesce(F.nullif(F.trim(kind), F.lit("")), F.lit("manual"))
    return F.when(serial == DEMO_SERIAL, "demo").when(serial.rlike("(?i)-MUT-"), "mutation").when(batch.isin(*KEPT_SOURCES), batch).otherwise(own)


def backfill_diff(current: DataFrame, target: DataFrame, key: str, kind: str, reasons_col: str, at: str, now: Column) -> DataFrame:
    """(key, before, after, reasons, at) of the rows that change: another source, other reasons in any order, or a time that is there without reasons or
    lacks with them. The first time of a quarantine stays. Nothing is written: this is the dry run too."""
    c = current.select(key, F.col(kind).alias("before"), F.array_sort(F.coalesce(reasons_col, F.array().cast("array<string>"))).alias("_old"), F.col(at).alias("_at"))
    t = target.select(key, F.col(kind).alias("after"), F.col(reasons_col).alias("reasons"))
    j = c.join(t, key)
    any_ = F.size("reasons") > 0
    same = F.col("before").eqNullSafe(F.col("after")) & (F.col("_old") == F.array_sort("reasons")) & (any_ == F.col("_at").isNotNull())
    return j.filter(~same).select(key, "before", "after", "reasons", F.when(any_, F.coalesce("_at", now)).alias("at"))


def quality_dashboard(records: DataFrame, kind: str, at: str, reasons_col: str, seen: Column) -> DataFrame:
    """Long (metric, name, n): rows by source, rows that reviewers see, rows in quarantine, and rows by reason."""
    held = records.filter(F.col(at).isNotNull())
    row = lambda metric, d, name: d.select(F.lit(metric).alias("metric"), name.alias("name"), F.col("n").cast("long").alias("n"))
    totals = records.agg(F.count_if(seen).alias("v"), F.count_if(F.col(at).isNotNull()).alias("q")).select(F.explode(F.array(F.struct(F.lit("visible").alias("metric"), F.col("v").alias("n")), F.struct(F.lit("quarantined").alias("metric"), F.col("q").alias("n")))).alias("x")).select("x.metric", F.lit("all").alias("name"), "x.n")
    return row("source", tally(records, [kind]), F.col(kind)).unionByName(totals).unionByName(row("reason", tally_elements(held, reasons_col), F.col("value")))


def mutated_net_contents(c: Column) -> Column:
    """Another legal size: 750 mL, or 1 L for what is 750 mL."""
    ml = P.parse_volume(c)["milliliters"]
    return F.when(ml.isNotNull() & (F.abs(ml - 750.0) < 1.0), "1 L").otherwise("750 mL")


def mutations(records: DataFrame, serial: str = "serial_number") -> DataFrame:
    """One row of records' columns for each way in which a record can be mutated, with mutation, serial-MUT-mutation as serial, and channel and source_kind set."""
    change = {
        "BRAND": ("brand_name", F.lit(True), F.concat("brand_name", F.lit(" RESERVE"))), "NET": ("net_contents", F.lit(True), mutated_net_contents(F.col("net_contents"))),
        "FANCIFUL": ("fanciful_name", F.lit(True), F.lit("NONEXISTENT FANCY")), "ABV": ("alcohol_content", F.col("alcohol_content").isNotNull(), F.col("alcohol_content") + 5),
        "ORIGIN": ("country_of_origin", F.coalesce(F.col("imported"), F.lit(False)) & (F.trim("country_of_origin") != ""), F.when(F.lower("country_of_origin") == "chile", "Portugal").otherwise("Chile")),
    }
    kinds = F.filter(F.array(*[F.when(when, F.lit(n)) for n, (_, when, _) in change.items()]), lambda x: x.isNotNull())
    m = records.withColumn("mutation", F.explode(kinds))
    new = {c: F.when(F.col("mutation") == n, v.cast(records.schema[c].dataType)).otherwise(F.col(c)) for n, (c, _, v) in change.items()}
    return m.withColumns({**new, serial: F.concat(F.col(serial).cast("string"), F.lit("-MUT-"), F.col("mutation")), "channel": F.lit("submitted"), "source_kind": F.lit("mutation")})


def score_positives(records: DataFrame, key: str, net_contents: str, history: DataFrame, model: str, order: Sequence[str], verdict_col: str, findings_col: str, sentinel_note: str) -> DataFrame:
    """(model, key, bucket): clean, flagged, other or unverified for every model that history has.

    The verdict is taken anew from the findings; of a record whose net contents are not stated, the finding that says so is left out."""
    models = history.select(model).distinct()
    newest = latest_per_key(history.select(model, key, *[c for c in dict.fromkeys([*order, verdict_col, findings_col]) if c not in (model, key)]), [model, key], order)
    keep = F.filter(findings_col, lambda f: ~(F.coalesce(F.col(net_contents) == SENTINEL, F.lit(False)) & (f["field"] == "net_contents") & F.coalesce(f["note"] == sentinel_note, F.lit(False))))
    every = records.select(key, net_contents).join(F.broadcast(models))  # models are the few that a run compares
    j = every.join(newest, [model, key], "left").withColumn("_f", keep)
    verdict = F.when(F.coalesce(F.size("_f"), F.lit(0)) > 0, worst_of_array(F.col("_f"))).otherwise(F.col(verdict_col))
    bucket = F.when(F.col(verdict_col).isNull(), "unverified").when(verdict.isin(*CLEAN), "clean").when(verdict.isin(*FLAGGED), "flagged").otherwise("other")
    return j.select(model, key, bucket.alias("bucket"))


def score_negatives(mutants: DataFrame, key: str, serial: str, history: DataFrame, model: str, order: Sequence[str], findings_col: str) -> DataFrame:
    """(model, key, mutation, bucket): caught where the check that must flag does, missed, or unverified."""
    models = history.select(model).distinct()
    newest = latest_per_key(history.select(model, key, *[c for c in dict.fromkeys([*order, findings_col]) if c not in (model, key)]), [model, key], order)
    kind = F.regexp_extract(serial, MUTANT, 2)
    field = F.element_at(F.create_map(*[F.lit(x) for kv in EXPECTED_FLAGS.items() for x in kv]), F.col("mutation"))
    every = mutants.select(key, kind.alias("mutation")).withColumn("_field", field).filter("_field is not null").join(F.broadcast(models))
    j = every.join(newest, [model, key], "left")
    caught = F.exists(findings_col, lambda f: (f["field"] == F.col("_field")) & f["verdict"].isin(*FLAGGED))
    return j.select(model, key, "mutation", F.when(F.col(findings_col).isNull(), "unverified").when(caught, "caught").otherwise("missed").alias("bucket"))


def score_summary(positives: DataFrame, negatives: DataFrame, model: str) -> DataFrame:
    """(model, verified, false_flag, checked, catch): counts and rates of each model, 'n/a' of nothing."""
    p = positives.groupBy(model).agg(F.count_if(F.col("bucket").isin("clean", "flagged")).alias("verified"), F.count_if(F.col("bucket") == "flagged").alias("_flagged"))
    n = negatives.groupBy(model).agg(F.count_if(F.col("bucket").isin("caught", "missed")).alias("checked"), F.count_if(F.col("bucket") == "caught").alias("_caught"))
    j = p.join(n, model, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    percent = lambda a, b: F.when(zero(b) == 0, "n/a").otherwise(F.concat(rate(zero(a), zero(b)), F.lit("%")))
    return j.select(model, zero("verified").alias("verified"), percent("_flagged", "verified").alias("false_flag"), zero("checked").alias("checked"), percent("_caught", "checked").alias("catch"))


def corpus_failures(cases: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """cases: (key, overall, verdicts map<field, verdict>, forbidden array<string>); actual: (key, overall, findings, payload struct).

    (key, what, expected, actual): a wrong overall verdict, a wrong or missing finding, a forbidden text in the payload."""
    j = cases.select(key, F.col("overall").alias("_want"), "verdicts", "forbidden").join(actual.select(key, F.col("overall").alias("_got"), "findings", F.to_json("payload").alias("_payload")), key, "left")
    one = lambda what, want, got: F.struct(what.alias("what"), want.cast("string").alias("expected"), got.cast("string").alias("actual"))
    none = F.lit(None).cast("string")
    overall = F.array(F.when(~F.col("_want").eqNullSafe(F.col("_got")), one(F.lit("overall"), F.col("_want"), F.col("_got"))))
    verdict = lambda e: F.get(F.transform(F.filter(F.coalesce("findings", F.expr("slice(findings, 1, 0)")), lambda f: f["field"] == e["key"]), lambda f: f["verdict"]), F.lit(0))
    fields = F.transform(F.map_entries("verdicts"), lambda e: F.when(~e["value"].eqNullSafe(verdict(e)), one(F.concat(F.lit("field:"), e["key"]), e["value"], verdict(e))))
    texts = F.transform("forbidden", lambda t: F.when(F.contains(F.col("_payload"), t), one(F.lit("forbidden"), none, t)))
    every = F.filter(F.concat(overall, F.coalesce(fields, F.slice(overall, 1, 0)), F.coalesce(texts, F.slice(overall, 1, 0))), lambda x: x.isNotNull())
    return j.select(key, F.explode(every).alias("x")).select(key, "x.*")
