"""Registered queries of the library on the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe import tables
from veriframe.functions import parsers as P
from veriframe.functions import text as X
from veriframe.operators import evidence, external, grounding, joins, latest, lifecycle, roles
from veriframe.plans import catalogue
from veriframe.sources import forms, ingest
from veriframe.streaming import progress, stages

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def placed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table with the place of each row in it, for SQL that takes the first row of equals or adds doubles up in the table's order."""
    return t(spark, d, name).withColumn("place", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_event_per_user(spark, d):
    return latest.latest_per_key(t(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).drop("ts")


def _verdicts(spark, d):
    v = F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "needs_review").when(F.col("l_linestatus") == "O", "not_required").otherwise("pass_with_note")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("verdict"))


_V = "with v as (select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 5 when l_returnflag = 'A' then 4 when l_linestatus = 'O' then 1 else 3 end s from lineitem) "


@query(_V + "select l_orderkey, case max(s) when 5 then 'fail' when 4 then 'needs_review' when 3 then 'pass_with_note' else 'pass' end overall from v group by 1")
def worst_of_per_order(spark, d):
    return latest.worst_of(_verdicts(spark, d), ["l_orderkey"], "verdict")


@query(_V + "select l_orderkey, l_linenumber, case s when 5 then 'fail' when 4 then 'needs_review' when 3 then 'pass_with_note' else 'not_required' end verdict from v qualify row_number() over (partition by l_orderkey order by s desc, l_linenumber) = 1")
def worst_finding_per_order(spark, d):
    return latest.worst_row(_verdicts(spark, d), ["l_orderkey"], "verdict", ["l_linenumber"])


def _verdict_of_order(o):
    verdict = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "pass").when(F.col("o_orderstatus") == "P", "needs_review")
    return o.withColumn("verdict", verdict).withColumn("decision", F.when(F.col("o_orderpriority").startswith("1"), "approved"))


def _history(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer").selectExpr("c_custkey o_custkey", "c_name", "c_mktsegment"), "o_custkey", "left")
    return _verdict_of_order(o)


@query("select case when o_orderpriority like '1%' then 'decided' when o_orderstatus not in ('F','O','P') then 'unchecked' when o_orderstatus = 'O' then 'ready' else 'review' end tab, count(*) n from orders group by 1")
def history_tabs(spark, d):
    h = _verdict_of_order(t(spark, d, "orders"))
    return latest.tally(h.withColumn("tab", lifecycle.tab_for(F.col("verdict"), F.col("decision"))), ["tab"])


@query("select o_orderkey, c_name, o_totalprice from orders left join customer on c_custkey = o_custkey where contains(lower(c_name), '7') order by o_totalprice desc, o_orderkey desc limit 100")
def history_sorted(spark, d):
    h = lifecycle.search(_history(spark, d), ["c_name"], "7")
    return lifecycle.sort_history(h, "o_totalprice", "desc", "o_orderkey", ["o_totalprice"], "o_orderdate").select("o_orderkey", "c_name", "o_totalprice").limit(100)


@query('select event_type, count(value) "count", round(min(value),2) "min", round(quantile_disc(value,0.5),2) p50, round(quantile_disc(value,0.95),2) p95, round(max(value),2) "max", round(avg(value),2) "avg" from events group by 1')
def latency_summary_by_type(spark, d):
    return latest.distribution(t(spark, d, "events"), ["event_type"], "value")


@query("""select event_type, 'k' stage, count(v) "count", round(min(v),2) "min", round(quantile_disc(v,0.5),2) p50, round(quantile_disc(v,0.95),2) p95, round(max(v),2) "max", round(avg(v),2) "avg" from (select event_type, cast(json_extract_string(props,'$.k') as double) v from events) group by 1""")
def stage_distribution(spark, d):
    e = t(spark, d, "events").select("event_type", F.from_json("props", "map<string,double>").alias("m"))
    return latest.map_distribution(e, ["event_type"], "m")


@query("select o_custkey batch, count(*) total, count(*) filter (where o_orderstatus = 'F') done, cast(round(count(*) filter (where o_orderstatus = 'F') * 100 / count(*)) as int) percent, case when count(*) filter (where o_orderstatus = 'F') < count(*) then 'processing' else 'completed' end status from orders group by 1")
def progress_by_batch(spark, d):
    return latest.batch_progress(t(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F"])


@query("select event_id, lag(event_id) over (partition by user_id, event_type order by ts, event_id) reused from events")
def reuse_asof(spark, d):
    return latest.reuse_asof(t(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id").select("event_id", "reused")


@query("""with r as (select l_partkey % 3000 as key, count(*) refs from lineitem group by 1), f as (select p_partkey as key, count(*) ups from part group by 1), j as (select coalesce(r.key, f.key) as key, refs, ups from r full join f on r.key = f.key)
select key, 'missing' kind from j where ups is null union all select key, 'orphan' from j where refs is null union all select key, 'duplicate_upload' from j where ups > 1 union all select key, 'duplicate_reference' from j where refs > 1""")
def reference_reconcile(spark, d):
    refs = t(spark, d, "lineitem").select((F.col("l_partkey") % 3000).alias("ref"))
    return joins.reconcile(refs, "ref", t(spark, d, "part"), "p_partkey")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def unlabelled_documents(spark, d):
    return joins.missing_from(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id").select("doc_id")


@query("""select p_partkey, case when abs(p_size-5)<=1 then 5.0::double when abs(p_size-12)<=1 then 12.0::double when abs(p_size-40)<=1 then 40.0::double end fill, case when p_retailprice > 0 and p_retailprice < 950 then 'low' when p_retailprice > 950 and p_retailprice < 1500 then 'middle' when p_retailprice > 1500 then 'high' end bucket from part""")
def band_and_bucket(spark, d):
    return t(spark, d, "part").select("p_partkey", joins.band_match(F.col("p_size"), [5, 12, 40], 1).alias("fill"), joins.bucket_match(F.col("p_retailprice"), [("low", 0.0, 950.0), ("middle", 950.0, 1500.0), ("high", 1500.0, float("inf"))]).alias("bucket"))


@query("""with v(i, name) as (values (0,'STANDARD'),(1,'PROMO'),(2,'ECONOMY ANODIZED'),(3,'STEEL')), p as (select p_partkey, trim(regexp_replace(upper(p_type),'[^A-Z0-9%]+',' ','g')) x from part),
m as (select p_partkey, name, i, case when x = name then 1 when contains(' '||x||' ', ' '||name||' ') then 2 end tier from p, v)
select p_partkey, arg_min(name, tier*10+i) entry, cast(min(tier) as int) tier from m group by 1""")
def vocab_lookup(spark, d):
    p = t(spark, d, "part").select("p_partkey", X.match_norm(F.col("p_type")).alias("x"))
    return joins.vocab_lookup(p, F.col("x"), ["STANDARD", "PROMO", "ECONOMY ANODIZED", "STEEL"]).drop("x")


@query("""with p as (select p_partkey, trim(regexp_replace(regexp_replace(lower(p_name),'[^a-z0-9 ]',' ','g'),' +',' ','g')) a, lag(trim(regexp_replace(regexp_replace(lower(p_name),'[^a-z0-9 ]',' ','g'),' +',' ','g'))) over (partition by p_brand order by p_name, p_partkey) b from part),
q as (select p_partkey, a, b, replace(a,' ','') x, replace(b,' ','') y from p)
select p_partkey, coalesce(length(x)>=6 and length(y)>=6 and len(string_split(a,' '))=len(string_split(b,' ')) and levenshtein(x,y) <= greatest(1, ceil(0.12*length(x))), false) near from q""")
def near_names(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("p_brand").orderBy("p_name", "p_partkey")
    p = t(spark, d, "part").withColumn("before", F.lag("p_name").over(w))
    return p.select("p_partkey", X.near_equivalent(F.col("p_name"), F.col("before")).alias("near"))


_TOK = "list_filter(string_split_regex(lower(text),'[^a-z0-9]+'), lambda w: w <> '')"


@query(f"""with a as (select conv_id, turn, list_distinct({_TOK}) x, lead(list_distinct({_TOK})) over (partition by conv_id order by turn) y from conversations)
select conv_id, turn, round(case when len(x)>0 then len(list_intersect(x,y))/len(x) else 0 end,6) recall, round(case when len(x)+len(y)>0 then 2*len(list_intersect(x,y))/(len(x)+len(y)) else 0 end,6) f1 from a where y is not null""")
def token_f1(spark, d):
    from pyspark.sql import Window as W

    tok = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    a = t(spark, d, "conversations").select("conv_id", "turn", tok.alias("x")).withColumn("y", F.lead("x").over(W.partitionBy("conv_id").orderBy("turn"))).filter("y is not null")
    return a.withColumn("o", joins.token_overlap(F.col("x"), F.col("y"))).select("conv_id", "turn", F.round("o.recall", 6).alias("recall"), F.round("o.f1", 6).alias("f1"))


@query(r"""select doc_id, substring(regexp_replace(regexp_replace(regexp_replace(text,'sk-[A-Za-z0-9_\-]{8,}','[REDACTED]','g'),'(?i)(api[_-]?key["''=:\s]+)[^"''\s,}]+','\1[REDACTED]','g'),'(?i)(authorization["''=:\s]+bearer\s+)[^"''\s,}]+','\1[REDACTED]','g'),1,500) redacted from documents""")
def redact_secrets(spark, d):
    return t(spark, d, "documents").select("doc_id", X.redact(F.col("text")).alias("redacted"))


@query(r"""with w as (select doc_id, regexp_extract_all(lower(text),'[a-z0-9'']+|\(\d+\)') s, regexp_extract_all(lower('Released under the MIT License'),'[a-z0-9'']+|\(\d+\)') x from documents)
select doc_id, cast(len(list_filter(x, lambda q: not list_contains(s,q))) as int) missing, cast(len(list_filter(s, lambda q: not list_contains(x,q))) as int) extra from w""")
def statement_diff(spark, d):
    wanted = P.statement_tokens(F.lit("Released under the MIT License"))
    # an array of one binds the words, so that they are made once and not for every word that is looked for
    both = lambda said: F.struct(F.size(P.bag_minus(wanted, said)).alias("missing"), F.size(P.bag_minus(said, wanted)).alias("extra"))
    return t(spark, d, "documents").select("doc_id", F.get(F.transform(F.array(P.statement_tokens(F.col("text"))), both), F.lit(0)).alias("r")).select("doc_id", "r.*")


@query("select md5(text) checksum, count(distinct source) owners from documents where text is not null group by 1 having count(distinct source) > 1")
def shared_checksum(spark, d):
    return latest.shared_keys(t(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("checksum"), "source"), "checksum", "source")


_R = "list_filter([case when quality < 1 then 'low_quality' end, case when toxic > 0 then 'toxic' end, case when n_chars < 50 then 'short' end], lambda x: x is not null)"


def _reasons(spark, d):
    j = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id")
    return j.select("doc_id", lifecycle.reasons({"low_quality": F.col("quality") < 1, "toxic": F.col("toxic") > 0, "short": F.col("n_chars") < 50}).alias("reasons"))


@query(f"select doc_id, array_to_string({_R}, ',') reasons from documents join labels using (doc_id) where len({_R}) > 0")
def quarantine_reasons(spark, d):
    return _reasons(spark, d).filter(F.size("reasons") > 0).withColumn("reasons", F.array_join("reasons", ","))


@query(f"select value, count(*) n from (select unnest({_R}) as value from documents join labels using (doc_id)) group by 1")
def reason_tally(spark, d):
    return latest.tally_elements(_reasons(spark, d), "reasons")


@query("""with n as (select lang, count(*) n from documents group by 1), q as (select lang, n, n * 100 / (select sum(n) from n) s from n),
r as (select lang, n, floor(s) f, row_number() over (order by floor(s) - s, lang) p, 100 - sum(floor(s)) over () l from q),
k as (select lang, least(n, f + case when p <= l then 1 else 0 end) quota from r),
x as (select doc_id, lang, row_number() over (partition by lang order by doc_id) rn from documents) select doc_id, x.lang from x join k on x.lang = k.lang where rn <= quota""")
def stratified_sample(spark, d):
    return latest.stratified_sample(t(spark, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 100)


@query("select lang, count(*) checked, count(*) filter (where toxic > 0) flagged, printf('%.1f', round(count(*) filter (where toxic > 0) * 100.0 / count(*), 1)) rate from documents join labels using (doc_id) group by 1")
def score_rates(spark, d):
    j = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("checked"), F.count_if(F.col("toxic") > 0).alias("flagged"))
    return j.withColumn("rate", lifecycle.rate(F.col("flagged"), F.col("checked")))


@query("""select p_partkey || '-MUT-BRAND' serial, 'BRAND' mutation, p_brand || ' X' as value from part union all select p_partkey || '-MUT-SIZE', 'SIZE', cast(p_size + 1 as varchar) from part where p_size > 25""")
def mutations(spark, d):
    return lifecycle.mutate(t(spark, d, "part"), "p_partkey", {"BRAND": (F.lit(True), F.concat("p_brand", F.lit(" X"))), "SIZE": (F.col("p_size") > 25, F.col("p_size") + 1)})


@query("select p_partkey, cast(p_size as double) percent, cast(p_size * 2 as double) proof, cast(p_size * 10 as double) milliliters from part")
def parsed_statements(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.concat(F.lit("ALC. "), "p_size", F.lit("% BY VOL ("), F.col("p_size") * 2, F.lit(" PROOF)")).alias("a"), F.concat("p_size", F.lit(" cL")).alias("v"))
    return p.select("p_partkey", P.parse_alcohol(F.col("a"))["percent"].alias("percent"), P.parse_alcohol(F.col("a"))["proof"].alias("proof"), P.parse_volume(F.col("v"))["milliliters"].alias("milliliters"))


@query("""select c_custkey, case when lower(c_mktsegment) not in ('building','machinery','household') then 1 else 0 end + case when c_acctbal < 0 or c_acctbal >= 100 then 1 else 0 end errors from customer""")
def ingest_errors(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_name")
    e = ingest.row_errors(ingest.err_required("c_name"), ingest.err_enum("c_mktsegment", ["building", "machinery", "household"]), ingest.err_percent("c_acctbal"))
    return c.select("c_custkey", F.size(e).alias("errors"))


@query("""with s as (select 'state' metric, o_orderstatus as name, cast(count(*) as double) as value from orders group by 2), w as (select count(o_orderkey) c, min(o_orderkey) a, quantile_disc(o_orderkey,0.5) b, quantile_disc(o_orderkey,0.95) x, max(o_orderkey) m from orders)
select * from s union all select 'wait','count',cast(c as double) from w union all select 'wait','min',cast(a as double) from w union all select 'wait','p50',cast(b as double) from w union all select 'wait','p95',cast(x as double) from w union all select 'wait','max',cast(m as double) from w""")
def attempt_report(spark, d):
    return lifecycle.attempt_report(t(spark, d, "orders"), "o_orderstatus", "o_orderkey")


@query("select s_suppkey, case when s_suppkey % 2 = 0 then 'new' else s_name end s_name from supplier union all select s_suppkey + 1000000, 'added' from supplier where s_suppkey % 10 = 0")
def upserted_suppliers(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", "s_name")
    new = s.filter("s_suppkey % 2 = 0").withColumn("s_name", F.lit("new")).union(s.filter("s_suppkey % 10 = 0").select(F.col("s_suppkey") + 1000000, F.lit("added")))
    return joins.upsert(s, new, ["s_suppkey"])


@query("select page_id, regexp_extract(html, '(?i)<html[^>]*lang=\"([a-z]+)\"', 1) lang, cast(len(regexp_extract_all(html, '<li>')) as int) items from pages")
def page_fields(spark, d):
    return t(spark, d, "pages").select("page_id", F.regexp_extract("html", '(?i)<html[^>]*lang="([a-z]+)"', 1).alias("lang"), F.regexp_count("html", F.lit("<li>")).alias("items"))


def _stream_of(spark, df: DataFrame) -> DataFrame:
    """A stream of a table that is written anew, a file a batch."""
    path = tables.new_path(spark, "arriving")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The table that a stream writes until all files are read."""
    spark = stream.sparkSession
    path, checkpoint = tables.new_path(spark, "stream"), tables.new_path(spark, "checkpoint")
    stages.to_table(stream, path, checkpoint, mode)
    return spark.read.parquet(path)


@query("select event_type, count(*) n from events group by 1")
def stream_progress(spark, d):
    """The running counts of a file stream once all files are read: each batch upserts the counts that it has changed."""
    counts = progress.stream_counts(_stream_of(spark, t(spark, d, "events").select("event_type").repartition(4)), ["event_type"])
    return stages.newest_of(_drained(counts, "update"), ["event_type"], ["n"])


@query("select event_id, event_type, case event_id % 10 when 7 then 'unstarted' when 8 then 'unfinished' else 'finished' end status, case when event_id % 10 not in (7, 8) then 60000::bigint end ms from events")
def stream_stage_pairs(spark, d):
    """Stages of events: all starts arrive in one file, then all ends a minute later, then one event long after; some repeat, of each tenth one the start or the end is missing."""
    e = t(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    k, later = F.col("event_id") % 10, lambda f, text: f.withColumn("at", F.col("at") + F.expr(f"interval {text}"))
    starts = e.filter(k != 7).withColumn("kind", F.lit("started"))
    ends = later(e.filter(k != 8).withColumn("kind", F.lit("finished")), "60 seconds")
    last = later(e.orderBy(F.col("at").desc(), "event_id").limit(1).select(F.lit(-1).cast(e.schema["event_id"].dataType).alias("event_id"), "event_type", "at").withColumn("kind", F.lit("started")), "100 days")
    path, table, checkpoint = (tables.new_path(spark, kind) for kind in ("arriving", "stream", "checkpoint"))
    for arriving in (starts.union(later(starts.filter(k == 3), "5 seconds")), ends.union(later(ends.filter(k == 4), "9 seconds")), last):
        arriving.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(starts.schema).parquet(path)
        stages.to_table(stages.pair_stages(stream, ["event_id", "event_type"], "kind", "at", timedelta(hours=2), "40 days"), table, checkpoint)  # goes on where the last run ended
    return spark.read.parquet(table).select("event_id", "event_type", "status", "ms")


@query("select distinct user_id, event_type from events where event_type <> 'error'")
def stream_first_seen(spark, d):
    """Observations that arrive in several files, each key kept once; failed ones never count."""
    e = t(spark, d, "events").filter("event_type <> 'error'").select("user_id", "event_type", "ts").repartition(3)
    return _drained(progress.stream_dedupe(_stream_of(spark, e), ["user_id", "event_type"], "ts", "100000 days")).select("user_id", "event_type")


@query("""with recursive w as (select l_orderkey k, l_partkey % 600 x, l_suppkey % 50 y, 6 + l_linenumber % 3 * 9 h, cast(l_linenumber as varchar) text, row_number() over (partition by l_orderkey order by l_suppkey % 50, l_partkey % 600, 6 + l_linenumber % 3 * 9, cast(l_linenumber as varchar)) i from lineitem),
f as (select k, i, 0 line, y t, y + h b from w where i = 1
 union all select w.k, w.i, f.line + n.new, case when n.new = 1 then w.y else least(f.t, w.y) end, case when n.new = 1 then w.y + w.h else greatest(f.b, w.y + w.h) end
 from f join w on w.k = f.k and w.i = f.i + 1, lateral (select case when abs((f.t + f.b) / 2.0 - (w.y + w.h / 2.0)) > 0.7 * greatest(w.h, f.b - f.t) then 1 else 0 end as new) n)
select f.k l_orderkey, f.line, string_agg(w.text, ' ' order by w.i) text, min(w.x) x, min(w.y) y, max(w.x + 40) - min(w.x) width, max(w.y + w.h) - min(w.y) height from f join w on w.k = f.k and w.i = f.i group by 1, 2""")
def line_builder(spark, d):
    words = t(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 600).alias("x"), (F.col("l_suppkey") % 50).alias("y"), F.lit(40).alias("width"), (6 + F.col("l_linenumber") % 3 * 9).alias("height"), F.col("l_linenumber").cast("string").alias("text"))
    return evidence.build_lines(words, ["l_orderkey"])


@query("""select o_orderkey, 'CUSTOMER ' || lpad(cast(c_custkey as varchar), 9, '0') entry, case when o_orderkey % 7 = 0 then 1 else 2 end tier, c_custkey place from orders join customer on c_custkey = o_custkey""")
def vocab_table_lookup(spark, d):
    """Texts of orders against the names of all customers, which are no literals but a table of any size."""
    name = lambda key: F.concat(F.lit("Customer#"), F.lpad(F.col(key).cast("string"), 9, "0"))
    said = F.when(F.col("o_orderkey") % 7 == 0, name("o_custkey")).otherwise(F.concat(F.lit("sold to the customer "), name("o_custkey"), F.lit(" on day "), F.col("o_orderkey").cast("string")))
    o = t(spark, d, "orders").select("o_orderkey", X.match_norm(said).alias("x"))
    return joins.vocab_join(o, "o_orderkey", "x", t(spark, d, "customer").select(X.match_norm(name("c_custkey")).alias("name"), F.col("c_custkey").alias("place")))


@query()
def span_locate(spark, d):
    """Where the part's type stands in its name and type read together."""
    p = t(spark, d, "part").select("p_partkey", F.split(X.match_norm(F.concat_ws(" ", "p_name", "p_type", "p_brand")), " ").alias("tokens"), X.match_norm(F.col("p_type")).alias("target"))
    return evidence.locate(p, "tokens", "target").select("p_partkey", "match.start", "match.n", "match.text", "match.score")


@query()
def rule_findings(spark, d):
    """The rule catalogue on records that the parts declare, and labels that say them in another way."""
    from veriframe.plans import rules

    p = t(spark, d, "part")
    abv = (F.col("p_size") % 50 + 5).cast("double")
    cols = {
        "beverage_type": F.element_at(F.array(F.lit("malt"), F.lit("wine"), F.lit("spirits")), (F.col("p_partkey") % 3 + 1).cast("int")), "imported": F.col("p_size") > 40, "brand_name": F.col("p_brand"), "label_brand_name": F.upper("p_brand"),
        "fanciful_name": F.col("p_name"), "label_fanciful_name": F.col("p_name"), "applicant_name_address": F.concat("p_name", F.lit(" LLC, Austin, TX")), "label_name_address": F.concat(F.lit("Bottled by "), "p_name", F.lit(", Austin, TX")),
        "country_of_origin": F.lit("France"), "label_country_of_origin": F.lit("Product of France"), "label_warning": F.when(F.col("p_size") % 5 > 0, rules.WARNING), "label_warning_bold": F.lit(True), "net_contents": F.lit("750 mL"), "label_net_contents": F.when(F.col("p_size") % 7 > 0, "750 ML"),
        "alcohol_content": abv, "actual_alcohol_content": abv + 0.2, "label_alcohol": F.concat(F.lit("ALC "), abv.cast("string"), F.lit("% BY VOL")), "label_class_type": F.col("p_type"), "vintage_year": F.lit(2019), "label_vintage": F.lit("2019"),
        "varietals": F.array(F.lit("merlot")), "appellation": F.lit("Napa Valley"), "label_appellation": F.lit("NAPA VALLEY"), "label_disclosures": F.array(F.lit("CONTAINS SULFITES")), "label_legible": F.lit(True), "label_confidence": F.lit(0.9),
        **{k: F.lit(None).cast("boolean") for k in rules.DISCLOSURES},
    }
    r = rules.evaluate(p.select("p_partkey", *[v.alias(k) for k, v in cols.items()]))
    return r.select("p_partkey", "overall", lifecycle.findings_text(F.col("findings")).alias("findings"), F.size("findings").alias("n_findings"))


@query("select event_id, lag(event_id) over w reused, case when lag(user_id) over w <> user_id then lag(user_id) over w end duplicate_of from events window w as (partition by event_type, floor(value) order by ts, event_id)")
def reuse_across_owners(spark, d):
    e = t(spark, d, "events").withColumn("bucket", F.floor("value"))
    return latest.reuse_with_owner(e, ["event_type", "bucket"], ["ts", "event_id"], "event_id", "user_id").select("event_id", "reused", "duplicate_of")


@query("""with m as (select c_custkey as i, c_name as name, cast(c_custkey + 7 as varchar) id from customer) select o_orderkey, least((select min(i) from m where name = 'Customer#' || lpad(cast(o_custkey as varchar), 9, '0')), (select min(i) from m where id = cast(o_custkey as varchar))) manifest_index from orders""")
def manifest_match(spark, d):
    m = t(spark, d, "customer").select("c_custkey", F.concat(F.lit("scans/"), "c_name").alias("path"), (F.col("c_custkey") + 7).alias("id"))
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("file"))
    return joins.match_manifest(o, "o_orderkey", "file", "o_custkey", m, "c_custkey", "path", "id").select("o_orderkey", "manifest_index")


@query("select o_orderkey, count(l_orderkey) n, coalesce(string_agg(o_orderkey || '-' || l_linenumber || '.png', '|' order by l_linenumber), '') files from orders left join lineitem on o_orderkey = l_orderkey group by 1")
def files_of_serial(spark, d):
    files = t(spark, d, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit(".png")).alias("name"))
    got = joins.infer_files(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", files, "name")
    return got.select("o_orderkey", F.size("files").cast("long").alias("n"), F.array_join("files", "|").alias("files"))


@query("""with a as (select l_orderkey k, l_linenumber i, case l_returnflag when 'R' then 'front' when 'A' then 'bck' else 'scan' end || l_linenumber || case when l_quantity < 5 then '.pdf' else '.jpg' end as name,
 case when l_returnflag = 'R' then 3 else 0 end + case when l_linestatus = 'F' then 2 else 0 end f, case when l_returnflag = 'A' then 3 else 0 end + case when l_linestatus = 'O' then 2 else 0 end b from lineitem),
r as (select * from a where name like '%.jpg'), fr as (select * from r qualify row_number() over (partition by k order by (f > 0 or b > 0) desc, f - b desc, f desc, i) = 1),
bk as (select r.* from r join fr on r.k = fr.k and r.i <> fr.i where r.b > r.f qualify row_number() over (partition by r.k order by r.b - r.f desc, r.b desc, r.i) = 1)
select fr.k l_orderkey, fr.name front, bk.name back from fr left join bk on fr.k = bk.k""")
def front_and_back(spark, d):
    word = F.when(F.col("l_returnflag") == "R", "front").when(F.col("l_returnflag") == "A", "bck").otherwise("scan")
    name = F.concat(word, F.col("l_linenumber").cast("string"), F.when(F.col("l_quantity") < 5, ".pdf").otherwise(".jpg"))
    a = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", name.alias("name"), F.when(F.col("l_linestatus") == "F", "Brand (front)").otherwise("Back").alias("kind"))
    return roles.pick_front_back(a, ["l_orderkey"], "l_linenumber", "name", "kind")


@query("""with r as (select l_orderkey, l_linenumber % 2 as field, l_linenumber as page, case l_returnflag when 'R' then 'present' when 'A' then 'ambiguous' else 'absent' end status from lineitem)
select l_orderkey, field, status, page from r qualify row_number() over (partition by l_orderkey, field order by case status when 'present' then 0 when 'ambiguous' then 1 else 2 end, page) = 1""")
def adjudications(spark, d):
    status = F.when(F.col("l_returnflag") == "R", "present").when(F.col("l_returnflag") == "A", "ambiguous").otherwise("absent")
    r = t(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 2).alias("field"), status.alias("status"), F.col("l_linenumber").alias("page"))
    return grounding.merge_adjudications(r, ["l_orderkey"], "field", "status", "page")


@query()
def grounded_names(spark, d):
    """The part's type on a page that says its name, brand and type, each a line."""
    line = lambda x: F.struct(F.col(x).alias("text"))
    p = t(spark, d, "part").select("p_partkey", F.array(line("p_name"), line("p_brand"), line("p_type")).alias("words"), F.col("p_type").alias("target"))
    return grounding.best_window(p, "words", "target").select("p_partkey", "match.start", "match.stop", "match.text", "match.score", "match.fused")


@query("""select c_custkey, 'C-' || lpad(cast(c_custkey as varchar), 6, '0') serial_number, c_name brand_name, case when c_custkey % 3 > 0 then 'Blend ' || c_nationkey end fanciful_name, c_name || ', Nation ' || c_nationkey applicant_name_address,
 case when c_mktsegment = 'BUILDING' then 'IMPORTED ' else '' end || c_mktsegment || ' WHISKY' declared_class_type, c_mktsegment = 'BUILDING' imported, 'spirits' beverage_type from customer""")
def form_texts(spark, d):
    """Forms that the customers would have filled in, read back."""
    c = t(spark, d, "customer")
    pad = lambda left, right: F.concat(F.rpad(left, 58, " "), right)
    lines = [pad(F.lit("4. SERIAL NUMBER"), F.lit(forms.APPLICANT)), pad(F.concat(F.lit("   C-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")), F.col("c_name")), pad(F.lit(""), F.lit("(Required)")),
             pad(F.lit(""), F.concat(F.lit("Nation "), "c_nationkey")), F.lit(forms.BRAND), F.lit(""), F.concat(F.lit("  "), "c_name"), F.lit(forms.FANCIFUL),
             F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit(" Blend "), "c_nationkey")).otherwise("9. FORMULA"), F.lit(forms.CLASS),
             F.concat(F.lit("  "), F.when(F.col("c_mktsegment") == "BUILDING", "IMPORTED ").otherwise(""), "c_mktsegment", F.lit(" WHISKY")), F.lit(""), F.lit("AFFIX COMPLETE SET OF LABELS")]
    docs = c.select("c_custkey", F.concat_ws("\n", *lines).alias("text"), F.lit("form.pdf").alias("filename"))
    return forms.parse_form_text(docs).select("c_custkey", "serial_number", "brand_name", "fanciful_name", "applicant_name_address", "declared_class_type", "imported", "beverage_type")


@query("select s_suppkey, 'NATION ' || s_nationkey origin, case when s_suppkey % 4 > 0 then 1990 + s_suppkey % 30 end vintage from supplier")
def detail_pages(spark, d):
    year = F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit("Vintage "), 1990 + F.col("s_suppkey") % 30)).otherwise("none")
    s = t(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("<tr><td><b>Origin Code:</b></td>\n<td>&nbsp;NATION "), "s_nationkey", F.lit(" </td></tr>\n<tr><td>Wine Vintage:</td>\n<td>"), year, F.lit("</td></tr>")).alias("html"))
    return forms.parse_detail_pages(s).select("s_suppkey", "origin", "vintage")


@query("""select p_partkey, case when p_partkey % 10 = 0 then 'not_a_form' when p_partkey % 10 = 1 then 'unknown_product' end error,
 case when p_partkey % 10 > 1 then 'P-' || p_partkey end serial_number, case when p_partkey % 10 > 1 then p_brand || ' & Co' end brand_name, case when p_partkey % 10 > 1 and p_size % 2 = 0 then p_name end fanciful_name,
 case when p_partkey % 10 > 1 then case p_partkey % 3 when 0 then 'wine' when 1 then 'malt' else 'spirits' end end beverage_type, case when p_partkey % 10 > 1 then p_size > 25 end imported,
 case when p_partkey % 10 > 1 then p_brand || ' LLC, Plant ' || p_size end applicant_name_address, case when p_partkey % 10 > 1 then p_type end declared_class_type,
 case when p_partkey % 10 > 1 then 2 end n_images from part""")
def registry_forms(spark, d):
    """Form pages of a registry that the parts would have, read back; every tenth is no form, another has no product."""
    k = F.col("p_partkey")
    product = F.when(k % 10 == 1, "Other").when(k % 3 == 0, "Wine").when(k % 3 == 1, "Malt Beverage").otherwise("Distilled Spirits")
    box = lambda what, value, on: F.concat(F.lit(f'<input type="checkbox" alt="{what}: '), value, F.lit('" '), F.when(on, "checked").otherwise(""), F.lit(">"))
    image = lambda n: F.concat(F.lit(f"{forms.IMAGE} Front<br><img src='/{forms.ATTACHMENT}.do?f={n}-"), k, F.lit("'>"))
    cell = lambda *x: F.concat(F.lit("<td>"), *[F.lit(v) if isinstance(v, str) else v for v in x], F.lit("</td>"))
    page = F.concat(F.lit("<p>PART I - APPLICATION</p><table><tr>"), cell(f"<div>{forms.SERIAL} <i>(Required)</i></div><div>P-", k, "</div>"), cell(f"{forms.BRAND} (Required)<br> ", F.col("p_brand"), " &amp; Co"),
                    F.lit("</tr><tr>"), cell(box(forms.PRODUCT, product, F.lit(True)), box(forms.SOURCE, F.lit(forms.IMPORTED), F.col("p_size") > 25)),
                    cell(f"{forms.FANCIFUL} (If any)\n", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("")),
                    F.lit("</tr><tr>"), cell(f"<div>{forms.APPLICANT}</div><div>", F.col("p_brand"), "\n LLC</div><div>Plant ", F.col("p_size"), "</div>"),
                    cell(forms.CLASS), cell(F.col("p_type"), " EXPIRATION DATE"), F.lit("</tr></table>"), image("a"), image("b"))
    pages = t(spark, d, "part").select("p_partkey", F.when(k % 10 == 0, "<p>Not found</p>").otherwise(page).alias("html"))
    rows = forms.registry_rows(pages, "p_partkey").withColumn("n_images", F.when(F.col("error").isNull(), F.size("images")))
    return rows.drop("images", "varietals", "appellation")


@query("""with v(kind, i, name) as (values ('malt',0,'standard'),('malt',1,'promo'),('malt',1,'brushed'),('wine',0,'economy anodized'),('wine',1,'steel'),('wine',2,'economy'),('spirits',0,'small plated brass')),
p as (select p_partkey, lower(p_type) x, case p_partkey % 3 when 0 then 'malt' when 1 then 'wine' else 'spirits' end kind from part),
m as (select p_partkey, i, case when x = name then 1 when contains(' '||x||' ', ' '||name||' ') then 2 end tier from p join v using (kind))
select p.p_partkey, e.entry from p left join (select p_partkey, arg_min(i, tier*10+i) entry from m where tier is not null group by 1) e using (p_partkey)""")
def designation_lookup(spark, d):
    names = {"malt": [["standard"], ["promo", "brushed"]], "wine": [["economy anodized"], ["steel"], ["economy"]], "spirits": [["small plated brass"]]}
    entries = [{"commodity": k, "entry": i, "names": n, "kind": "type", "sufficient": "true"} for k, of in names.items() for i, n in enumerate(of)]
    kind = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", catalogue.lookup(catalogue.folded(F.col("p_type")), kind, entries)["entry"].alias("entry"))


@query("""with s as (select l_orderkey, case l_linenumber when 1 then 'brand_name' else 'class_type_designation' end slot, l_linenumber from lineitem where l_linenumber in (1, 2) and l_linestatus = 'F'),
f as (select l_orderkey, case l_linenumber when 1 then 'brand_name' else 'class_type_designation' end slot, case l_returnflag when 'R' then 5 when 'A' then 4 else 2 end v from lineitem where l_linenumber <= 4)
select l_orderkey, slot, case max(v) when 5 then 'fail' when 4 then 'needs_review' else 'pass' end verdict, count(*) n_checks from s join f using (l_orderkey, slot) group by 1, 2""")
def finding_overlay(spark, d):
    li = t(spark, d, "lineitem")
    slot = F.when(F.col("l_linenumber") == 1, "brand_name").otherwise("class_type_designation")
    box = F.struct(*[F.lit(i).alias(n) for i, n in enumerate(("x", "y", "width", "height"))])
    slots = li.filter("l_linenumber in (1, 2)").select("l_orderkey", slot.alias("field"), F.lit("text").alias("text"), F.lit(1).alias("page"), box.alias("bbox"), F.when(F.col("l_linestatus") == "F", "ocr").otherwise("model").alias("bbox_source"))
    check = F.element_at(F.array(*map(F.lit, ("brand_name", "class_type_designation", "designation_minimum_abv", "declared_class_type"))), F.col("l_linenumber").cast("int"))
    verdict = F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "needs_review").otherwise("pass")
    none = F.lit(None).cast("string")
    finding = F.struct(check.alias("field"), verdict.alias("verdict"), none.alias("expected"), none.alias("extracted"), none.alias("citation"), none.alias("note"))
    findings = li.filter("l_linenumber <= 4").select("l_orderkey", finding.alias("finding"))
    return external.overlay(slots, findings, ["l_orderkey"]).select("l_orderkey", "slot", "verdict", "n_checks")
