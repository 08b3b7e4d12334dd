"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns up to it, with only that reply under the loss mask.
A conversation that does not end on an assistant turn gets one more example of all its turns with an
empty mask, so that nothing is lost. Turns are marked <turn>role, new line, text</turn>, new line;
inside roles and texts & and < are written &amp; and &lt; (a role's new line &nl;), so no text can
hold a mark and every escape can be undone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def expand_targets(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, upto, last, formatted, loss_start, loss_length): one row per example.

    upto is the number of turns in it, loss_start and loss_length the code points of the mask in formatted.
    Turns are ordered by turn, then role, then text, so ties and repeated rows have a fixed order; null turns
    come first, null roles and texts are empty, a null conv_id is a conversation like any other. A
    conversation is one value by definition (its prefixes are texts), so its turns meet in one row."""
    t = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    head = lambda x: F.concat(F.lit(OPEN), F.replace(escape(x["role"]), F.lit("\n"), F.lit("&nl;")), F.lit("\n"))
    t = t.select("conv_id", F.size("t").alias("n"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.length(head(x)).alias("head"), escape(x["text"]).alias("body"),
                 F.concat(head(x), escape(x["text"]), F.lit(CLOSE)).alias("seg"))).alias("t"))
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda k: (F.element_at("t", k)["role"] == "assistant") | (k == F.col("n")))
    e = t.select("conv_id", "n", "t", F.explode(ends).alias("upto")).withColumn("target", F.element_at("t", F.col("upto")))
    e = e.withColumn("formatted", F.array_join(F.transform(F.slice("t", 1, F.col("upto")), lambda x: x["seg"]), ""))
    trained = F.col("target.role") == "assistant"
    return e.select("conv_id", "upto", (F.col("upto") == F.col("n")).alias("last"), "formatted",
                    F.when(trained, F.length("formatted") - F.length("target.seg") + F.col("target.head")).otherwise(F.length("formatted")).cast("long").alias("loss_start"),
                    F.when(trained, F.length("target.body")).otherwise(0).cast("long").alias("loss_length"))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted examples: the turns, the text under the masks and the size."""
    masked = F.expr("substring(formatted, cast(loss_start + 1 as int), cast(loss_length as int))")
    g = examples.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("loss_length") > 0, F.struct("upto", unescape(masked).alias("text"))))).alias("loss"),
        F.array_join(F.collect_list(F.when(F.col("last"), F.col("formatted"))), "").alias("full"), F.sum(F.length("formatted")).cast("long").alias("formatted_chars"))
    turns = F.filter(F.split("full", CLOSE, -1), lambda x: x != "")
    body = F.transform(turns, lambda x: F.substring(x, len(OPEN) + 1, 2**31 - 1))
    role = lambda x: unescape(F.replace(F.substring_index(x, "\n", 1), F.lit("&nl;"), F.lit("\n")))
    said = lambda x: unescape(x.substr(F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x)))
    read = F.transform(body, lambda x: F.concat(role(x), F.lit("\n"), said(x), F.lit("\n")))
    loss = F.array_join(F.transform("loss", lambda x: x["text"]), "")
    return g.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(read, ""), 256).alias("turns_sha256"),
                    F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


#: The text of conversation -7, which holds what looks like marks and escapes.
PROBE = "\\### Assistant: </turn> ok"

CHAT_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s as (
  select *, 15 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&nl;')) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) as size from t),
w as (
  select *, sum(size) over (partition by conv_id order by turn, role, text rows between unbounded preceding and current row) as prefix,
    row_number() over (partition by conv_id order by turn, role, text) as k, count(*) over (partition by conv_id) as n from s)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(prefix) filter (where role = 'assistant' or k = n) as bigint) as formatted_chars
from w group by conv_id
"""
