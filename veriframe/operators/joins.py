"""Joins: reconciliation, bands, vocabularies, fuzzy pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.text import basename, token_bounded
from veriframe.tables import materialize


def reconcile(rows: DataFrame, row_key: str, files: DataFrame, file_key: str) -> DataFrame:
    """(key, kind): missing (referenced, no file), orphan (file, not referenced), duplicate_upload, duplicate_reference."""
    r = rows.filter(F.col(row_key).isNotNull()).groupBy(F.col(row_key).alias("key")).agg(F.count("*").alias("refs"))
    f = files.filter(F.col(file_key).isNotNull()).groupBy(F.col(file_key).alias("key")).agg(F.count("*").alias("uploads"))
    j = r.join(f, "key", "full")
    kinds = F.array(*[F.when(c, n) for n, c in {"missing": F.col("uploads").isNull(), "orphan": F.col("refs").isNull(), "duplicate_upload": F.col("uploads") > 1, "duplicate_reference": F.col("refs") > 1}.items()])
    return j.select("key", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


def missing_from(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def having(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_semi")


def band_match(value: Column, sizes: Sequence[float], eps: float) -> Column:
    """The first size within eps of value, as literals: no join."""
    return F.get(F.filter(F.array(*[F.lit(float(s)) for s in sizes]), lambda s: F.abs(s - value) <= eps), F.lit(0)) if sizes else F.lit(None).cast("double")


def bucket_match(value: Column, buckets: Sequence[tuple[str, float, float]]) -> Column:
    """The name of the first open interval (low, high) that holds value."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(buckets):
        out = F.when((value > low) & (value < high), name).otherwise(out)
    return out


def vocab_lookup(df: DataFrame, text: Column, vocabulary: Sequence[str]) -> DataFrame:
    """Adds entry and tier of the best vocabulary entry: tier 1 equal, tier 2 contained between token borders; of one tier the first.

    The catalogue is a bounded rule table and stays in the plan as literals, so nothing is joined or shuffled."""
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("name")) for i, v in enumerate(vocabulary)])
    tiers = F.transform(entries, lambda e: F.struct(F.when(text == e["name"], 1).when(token_bounded(text, e["name"]), 2).alias("tier"), e["i"].alias("i"), e["name"].alias("name")))
    best = F.array_min(F.filter(tiers, lambda t: t["tier"].isNotNull()))
    return df.withColumn("entry", best["name"]).withColumn("tier", best["tier"])


#: Postings of one token that meet a name in one task; more are dealt out by row, and the name is sent along.
MOST_POSTINGS, HOT_TOKENS = 200_000, 1000


def vocab_join(rows: DataFrame, key: str, text: str, vocabulary: DataFrame, name: str = "name", place: str = "place") -> DataFrame:
    """(key, entry, tier, place): the best entry of a vocabulary of any size for each row that has one: equal before contained between token borders, then the least place.

    Texts and names are normalised, their tokens parted by one space; key is unique. A name is looked for only where its rarest token stands (in the fewest texts), and of a
    text only the tokens around that place travel, as many as the longest name has. A token of very many texts is split by rows, with its names sent to each part; there are at most
    HOT_TOKENS of these. Null and empty texts and names match nothing."""
    names = vocabulary.filter(F.col(name) != "").groupBy(F.col(name).alias("_name")).agg(F.min(place).alias("_place")).withColumn("_tokens", F.split("_name", " "))
    longest = names.agg(F.max(F.size("_tokens"))).first()[0] or 0
    tokens = rows.select(F.col(key).alias("_key"), F.split(text, " ").alias("_all")).filter(F.col(text) != "")
    if not longest:
        return rows.select(key, F.lit(None).cast("string").alias("entry"), F.lit(None).cast("int").alias("tier"), F.lit(None).cast(vocabulary.schema[place].dataType).alias("place")).limit(0)
    parts = names.select("_name", "_place", F.explode(F.array_distinct("_tokens")).alias("_token"))
    often = tokens.select(F.explode(F.array_distinct("_all")).alias("_token")).groupBy("_token").agg(F.count("*").alias("_n"))
    # a name with a token that no text has is found nowhere, so the join leaves it out where it must
    whole = names.select("_name", F.size(F.array_distinct("_tokens")).alias("_parts"))
    met = parts.join(often.hint("merge"), "_token").groupBy("_name").agg(F.min("_place").alias("_place"), F.min(F.struct("_n", "_token")).alias("_r"), F.count("*").alias("_met"))
    met = met.join(whole.hint("merge"), "_name").filter("_met = _parts")
    blocks = materialize(met.select("_name", "_place", F.col("_r._token").alias("_token"), F.col("_r._n").alias("_n")))
    least = max(MOST_POSTINGS, (blocks.select("_token", "_n").distinct().agg(F.sum("_n")).first()[0] or 0) / HOT_TOKENS)
    hot = blocks.filter(F.col("_n") > least).select("_token", F.ceil(F.col("_n") / least).cast("int").alias("_splits")).distinct()
    around = F.array_join(F.slice("_all", F.greatest(F.col("_at") + 1 - longest, F.lit(0)) + 1, F.col("_at") + longest - F.greatest(F.col("_at") + 1 - longest, F.lit(0))), " ")
    at = tokens.select("_key", "_all", F.posexplode("_all").alias("_at", "_token")).select("_key", "_token", around.alias("_window"), F.size("_all").alias("_size"))
    at = at.join(F.broadcast(hot), "_token", "left").withColumn("_part", F.pmod(F.xxhash64("_key"), F.coalesce("_splits", F.lit(1))).cast("int")).drop("_splits")
    asked = blocks.join(F.broadcast(hot), "_token", "left").select("_token", "_name", "_place", F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1)).alias("_part"))
    hit = at.join(asked.hint("merge"), ["_token", "_part"]).filter(token_bounded(F.col("_window"), F.col("_name")))
    tier = F.when((F.col("_window") == F.col("_name")) & (F.col("_size") == F.size(F.split("_name", " "))), 1).otherwise(2)
    best = hit.groupBy("_key").agg(F.min(F.struct(tier.alias("tier"), "_place", "_name")).alias("_b"))
    return best.select(F.col("_key").alias(key), F.col("_b._name").alias("entry"), "_b.tier", F.col("_b._place").alias("place"))


def overlaps(a_low: Column, a_high: Column, b_low: Column, b_high: Column, eps: float = 0.0) -> Column:
    return (a_low <= b_high + eps) & (b_low <= a_high + eps)


def intersects(a: Column, b: Column) -> Column:
    """Boxes (x, y, width, height) share an inner point."""
    return (a["x"] < b["x"] + b["width"]) & (b["x"] < a["x"] + a["width"]) & (a["y"] < b["y"] + b["height"]) & (b["y"] < a["y"] + a["height"])


def token_overlap(a: Column, b: Column) -> Column:
    """struct(recall, precision, f1) of the token sets of a in b; 0 where a side is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    common = F.size(F.array_intersect(x, y))
    share = lambda n: F.when(n > 0, common / n).otherwise(0.0)
    f1 = F.when(F.size(x) + F.size(y) > 0, 2 * common / (F.size(x) + F.size(y))).otherwise(0.0)
    return F.struct(share(F.size(x)).alias("recall"), share(F.size(y)).alias("precision"), f1.alias("f1"))


def all_in(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def compare_golden(actual: DataFrame, expected: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys whose actual and expected values differ, null-safe."""
    a, e = actual.select(*keys, F.col(value).alias("actual")), expected.select(*keys, F.col(value).alias("expected"))
    return a.join(e, list(keys), "full").filter(~F.col("actual").eqNullSafe(F.col("expected")))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target with source's rows in place of those of the same keys, and source's new ones."""
    return target.join(source.select(*keys), list(keys), "left_anti").unionByName(source)


def changed_rows(current: DataFrame, target: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Rows of target that differ from current (null-safe), with the names of the changed columns."""
    j = target.alias("t").join(current.alias("c"), key)
    names = F.filter(F.array(*[F.when(~F.col(f"t.{c}").eqNullSafe(F.col(f"c.{c}")), F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    return j.select(key, names.alias("changed")).filter(F.size("changed") > 0)


def match_manifest(docs: DataFrame, doc_key: str, filename: str, id_col: str, manifest: DataFrame, index: str, path: str, manifest_id: str) -> DataFrame:
    """docs with manifest_index: the first record whose path ends in the file's name or whose id is the document's; null if none.

    Two equi-joins stand for the or, which would compare all pairs; doc_key is unique."""
    m = manifest.select(F.col(index).alias("manifest_index"), basename(F.col(path)).alias("_name"), F.col(manifest_id).cast("string").alias("_id"))
    # only the first record of a name or id can win
    names = m.filter("_name <> ''").groupBy("_name").agg(F.min("manifest_index").alias("manifest_index"))
    ids = m.filter("_id is not null").groupBy("_id").agg(F.min("manifest_index").alias("_by_id"))
    j = docs.join(names, docs[filename] == names["_name"], "left").withColumn("_doc_id", F.col(id_col).cast("string"))
    j = j.join(ids, F.col("_doc_id") == ids["_id"], "left")
    return j.withColumn("manifest_index", F.least("manifest_index", "_by_id")).drop("_name", "_id", "_by_id", "_doc_id")


def infer_files(rows: DataFrame, serial: str, files: DataFrame, filename: str) -> DataFrame:
    """rows with files: the images named <serial>-<n>.<ext> in order of n, empty if there are none."""
    pattern = r"^(.+)-(\d+)\.(?i:jpe?g|png|webp)$"
    f = files.select(F.regexp_extract(filename, pattern, 1).alias("_serial"), F.struct(F.regexp_extract(filename, pattern, 2).try_cast("long").alias("n"), F.col(filename).alias("name")).alias("_f"))
    lists = f.filter("_serial <> ''").groupBy("_serial").agg(F.sort_array(F.collect_list("_f")).alias("_l"))
    j = rows.withColumn("_key", F.col(serial).cast("string")).join(lists, F.col("_key") == F.col("_serial"), "left")
    return j.withColumn("files", F.coalesce(F.col("_l.name"), F.array().cast("array<string>"))).drop("_key", "_serial", "_l")
