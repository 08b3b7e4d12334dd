"""The trie of conversation prefixes, with count-min screening of prefix digests.

A prefix is a running digest of its turns. All digests are counted in a count-min sketch, which never counts too few:
an estimate of one proves that no other conversation has the prefix, nor any longer one of it, so its rows
are made where they stand. Only prefixes that may be shared are shuffled and grouped exactly.

Sums over subtrees need no walk up the tree. A conversation that is not the smallest member of a node was the smallest of none above
it, so from one depth on (its first) it stands for every node that it is in. What it saves in a node is the text between that node and
its first depth, and a node's leaves are its members that stand for a childless node; both are sums over a node's members."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.shared import CRC_SQL, Scratch, sha256_of_chunks
from veriframe.operators import scan

#: Cells of each of the sketch's rows for every prefix, and the most there are: beyond, more prefixes are grouped exactly that did not need it.
CELLS, MOST_CELLS, SKETCH_ROWS = 4, 1 << 25, 3
#: Cells of a block of the sketch, which travels by itself.
PART = 1 << 16
#: Depths of a conversation that meet its values in one task.
STRETCH = 1024
#: A parent with more children than this share of the nodes is broadcast (there are at most 1 / HEAVY of them), others are joined by key.
HEAVY = 1e-4


def numbered(turns: DataFrame, scratch: Scratch, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, k, t1, t2, chars, block): turns numbered from 1 in the order of turn (nulls first), role and text, with a 128-bit digest of role and text.

    Null roles and texts are empty; rows without a conv_id are of no conversation. A conversation of any length is split between tasks."""
    t = turns.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    b = scan.blocks(t, ["conv_id"], ["turn", "role", "text"])
    scratch.tables.append(b)
    sha = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    half = lambda at: F.conv(F.substring("sha", at, 16), 16, -10).cast("long")
    got = scan.running(b, ["conv_id"], ["turn", "role", "text"], k=("sum", F.lit(1))).withColumn("sha", sha)
    return scratch.keep(got.select("conv_id", F.col("k").cast("int").alias("k"), half(1).alias("t1"), half(17).alias("t2"), F.length("text").alias("chars"), "block"))


def _lanes(pos: Column, t1: Column, t2: Column) -> tuple[Column, Column]:
    """What a turn adds to the two halves of its prefix's digest, by exclusive or: it depends on the place."""
    return F.xxhash64(pos, t1, t2), F.xxhash64(t2, F.lit(11), pos, t1)


def rebuilt_prefixes(rows: DataFrame, scratch: Scratch, base_of: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Prefixes of the conversations whose first `heads` (up to `most`) turns are those of the conversation base_of (columns of conv_id).

    Gives prefixes (conv_id, depth, d1, d2, p1, p2, chars, chars_to, last), p1 and p2 being the parent's digest, chars_to the code points down
    to there and last whether the conversation ends there; and conversations (conv_id, depth, chars). heads of 0 takes conversations as they are."""
    convs = rows.groupBy("conv_id").agg(F.max("k").alias("n")).withColumns({"h": heads, "base": base_of})
    first = rows.filter(F.col("k") <= most)
    first = first.join(convs.filter("h > 0").select(F.col("base").alias("conv_id")).distinct().hint("merge"), "conv_id", "left_semi")
    first = first.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "t1", "t2", "chars"))).alias("turns"))  # at most `most` numbers each
    convs = convs.join(first.withColumnRenamed("conv_id", "base").hint("merge"), "base", "left").withColumn("turns", F.slice(F.coalesce("turns", F.array().cast(first.schema["turns"].dataType)), 1, F.col("h")))
    zero = F.lit(0).cast("long")
    step = lambda at, x: F.struct(*[(at[f"d{i}"].bitwiseXOR(lane)).alias(f"d{i}") for i, lane in enumerate(_lanes(x["k"], x["t1"], x["t2"]), 1)], (at["chars_to"] + x["chars"]).alias("chars_to"))
    start = F.struct(zero.alias("d1"), zero.alias("d2"), zero.alias("chars_to"))
    upto = F.transform(F.sequence(F.lit(0), F.size("turns")), lambda i: F.aggregate(F.slice("turns", 1, i), start, step))
    convs = scratch.keep(convs.withColumns({"nb": F.size("turns"), "upto": upto}).withColumn("depth", (F.col("nb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("int")))
    shared = convs.select("conv_id", "depth", "upto", F.posexplode("turns").alias("at", "x"))
    own, before = F.get("upto", F.col("at") + 1), F.get("upto", "at")
    shared = shared.select("conv_id", (F.col("at") + 1).alias("pos"), own["d1"].alias("d1"), own["d2"].alias("d2"), before["d1"].alias("p1"), before["d2"].alias("p2"), "x.chars", own["chars_to"].alias("chars_to"), (F.col("at") + 1 == F.col("depth")).alias("last"))
    # each block of a conversation's own turns gets its conversation's values once
    whole = F.element_at("upto", -1)
    heads_of = rows.groupBy("conv_id", "block").agg(F.max("k").alias("upto_k")).join(convs.select("conv_id", "n", "h", "nb", "depth", whole.alias("s")).hint("merge"), "conv_id").filter("upto_k > h").drop("upto_k", "n")
    tail = rows.join(heads_of.hint("merge"), ["conv_id", "block"]).filter("k > h").withColumn("pos", F.col("nb") + F.col("k") - F.col("h"))
    l1, l2 = _lanes(F.col("pos"), F.col("t1"), F.col("t2"))
    tail = scratch.keep(tail.select("conv_id", "block", "pos", "depth", "chars", "s", l1.alias("l1"), l2.alias("l2")))
    ran = scan.running(tail, ["conv_id"], ["pos"], x1=("xor", F.col("l1")), x2=("xor", F.col("l2")), c=("sum", F.col("chars").cast("long")))
    d1, d2 = F.col("x1").bitwiseXOR(F.col("s.d1")), F.col("x2").bitwiseXOR(F.col("s.d2"))
    ran = ran.select("conv_id", "pos", d1.alias("d1"), d2.alias("d2"), d1.bitwiseXOR(F.col("l1")).alias("p1"), d2.bitwiseXOR(F.col("l2")).alias("p2"), "chars", (F.col("c") + F.col("s.chars_to")).alias("chars_to"), (F.col("pos") == F.col("depth")).alias("last"))
    prefixes = scratch.keep(shared.union(ran).withColumnRenamed("pos", "depth"))
    text = prefixes.filter("last").select("conv_id", F.col("chars_to").alias("chars"))
    ends = scratch.keep(convs.select("conv_id", "depth").join(text.hint("merge"), "conv_id", "left").withColumn("chars", F.coalesce("chars", F.lit(0).cast("long"))))
    return prefixes, ends


class CountMin:
    """Counts up to two, in SKETCH_ROWS rows of `cells` (a power of two) cells: packed bits of 'once or more' and of 'twice or more'."""

    def __init__(self, cells: int, once: np.ndarray, twice: np.ndarray):
        self.cells, self.once, self.twice = cells, once, twice

    @staticmethod
    def places(d1: np.ndarray, d2: np.ndarray, cells: int) -> np.ndarray:
        """The cell of each digest in each row, as numbers in all rows' cells strung together."""
        a, b = d1.astype(np.int64).view(np.uint64), d2.astype(np.int64).view(np.uint64) | np.uint64(1)
        return np.stack([((a + np.uint64(r) * b) & np.uint64(cells - 1)).astype(np.int64) + r * cells for r in range(SKETCH_ROWS)])

    def single(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """Whether the estimate of each digest, the least of its rows, is at most one."""
        at = self.places(d1, d2, self.cells)
        return (((self.twice[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1) == 0).any(axis=0)


def sketch(prefixes: DataFrame, n: int) -> CountMin:
    """The sketch of n digests. Tasks count their own rows and send the cells in use; blocks of cells are added up by key; the driver gets at most
    SKETCH_ROWS * MOST_CELLS / 4 bytes (24 MB)."""
    cells = min(MOST_CELLS, max(PART, 1 << (CELLS * max(n, 1) - 1).bit_length()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(SKETCH_ROWS * cells, np.uint8)
        for pdf in batches:
            at = CountMin.places(pdf["d1"].to_numpy(), pdf["d2"].to_numpy(), cells).ravel()
            cell, often = np.unique(at, return_counts=True)
            held[cell] = np.minimum(held[cell] + np.minimum(often, 2).astype(np.uint8), 2)
        parts = held.reshape(-1, PART)
        for p in np.flatnonzero(parts.any(axis=1)):
            one, two = (np.flatnonzero(parts[p] == v).astype("<u2") for v in (1, 2))
            yield pd.DataFrame({"part": [int(p)], "one": [one.tobytes()], "two": [two.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = None, np.zeros(PART, np.uint8)
        packed = lambda: pd.DataFrame({"part": [part], "once": [np.packbits(held >= 1).tobytes()], "twice": [np.packbits(held >= 2).tobytes()]})
        for pdf in batches:
            for p, one, two in zip(pdf["part"], pdf["one"], pdf["two"]):
                if p != part:
                    if part is not None:
                        yield packed()
                    part, held = p, np.zeros(PART, np.uint8)
                one = np.frombuffer(one, "<u2")
                held[one] = np.minimum(held[one] + 1, 2)
                held[np.frombuffer(two, "<u2")] = 2
        if part is not None:
            yield packed()

    parts = prefixes.select("d1", "d2").mapInPandas(count, "part int, one binary, two binary").repartition("part").sortWithinPartitions("part")
    once, twice = (np.zeros((SKETCH_ROWS * cells // PART, PART // 8), np.uint8) for _ in range(2))
    for r in parts.mapInPandas(add, "part int, once binary, twice binary").collect():  # bounded by the sketch
        once[r.part], twice[r.part] = np.frombuffer(r.once, np.uint8), np.frombuffer(r.twice, np.uint8)
    return CountMin(cells, once.ravel(), twice.ravel())


def trie(prefixes: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, proven (emitted without exact grouping).

    prefixes and convs as rebuilt_prefixes gives them. Without conversations there is no node; conversations without turns are members of the root alone."""
    spark = prefixes.sparkSession
    n_prefixes, r = prefixes.count(), convs.agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).first()
    if not r.n:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, proven boolean")
    shared_sketch = spark.sparkContext.broadcast(sketch(prefixes, n_prefixes))

    def screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared_sketch.value
        for pdf in batches:
            yield pdf.assign(single=s.single(pdf["d1"].to_numpy(), pdf["d2"].to_numpy()), parent_single=s.single(pdf["p1"].to_numpy(), pdf["p2"].to_numpy()) & (pdf["depth"].to_numpy() > 1))

    kinds = ", ".join(f"{c} {t}" for c, t in prefixes.dtypes)
    rows = scratch.keep(prefixes.mapInPandas(screen, f"{kinds}, single boolean, parent_single boolean"))
    single, rest = rows.filter("single"), rows.filter("not single")
    groups = rest.groupBy("d1", "d2", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), (F.min("chars_to") - F.min("chars")).alias("before"))
    groups = scratch.keep(groups)
    # the nodes whose parent may be shared; all others follow a node of their own conversation
    open_single = single.filter("not parent_single").select("d1", "d2", "depth", "conv_id", "p1", "p2", (F.col("chars_to") - F.col("chars")).alias("before"), "last")
    nodes = groups.select("depth", "conv_id", "p1", "p2", "before").union(open_single.select("depth", "conv_id", "p1", "p2", "before"))
    leaf = groups.filter("n_convs = n_ends").select("conv_id").union(single.filter("last").select("conv_id"))
    none = F.lit(None)
    of_conv = nodes.select("conv_id", "depth", "before", F.lit(0).alias("leaf")).union(leaf.select("conv_id", none.cast("int"), none.cast("long"), F.lit(1)))
    of_conv = of_conv.groupBy("conv_id").agg(F.min_by("before", "depth").alias("before"), F.max("leaf").alias("leaf"))
    values = convs.join(of_conv.hint("merge"), "conv_id", "left").select("conv_id", "depth", F.coalesce("before", "chars").alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    values = scratch.keep(values)
    stretches = values.select("conv_id", "saved", "leaf", F.explode(F.sequence(F.lit(0), F.floor(F.col("depth") / STRETCH).cast("int"))).alias("stretch"))
    sums = rest.withColumn("stretch", F.floor(F.col("depth") / STRETCH).cast("int")).join(stretches.hint("merge"), ["conv_id", "stretch"])
    sums = sums.groupBy("d1", "d2", "depth").agg((F.sum("saved") - F.min_by("saved", "conv_id")).alias("saved"), F.sum("leaf").alias("n_leaves"))
    ends = _ends(rest, convs, scratch)
    children = scratch.keep(nodes.groupBy("p1", "p2", F.col("depth").alias("at")).agg(F.count("*").alias("n_children")))
    key = ["d1", "d2", "depth"]
    named = groups.join(sums.hint("merge"), key).join(ends.hint("merge"), key, "left")
    named = named.join(children.select(F.col("p1").alias("d1"), F.col("p2").alias("d2"), (F.col("at") - 1).alias("depth"), "n_children").hint("merge"), key, "left")
    empty = F.sha2(F.lit(""), 256)
    saved = F.col("saved") - (F.col("n_convs") - 1) * F.col("before")
    out = ["conv_id", "depth", "p1", "p2", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "proven"]
    named = named.select("conv_id", "depth", "p1", "p2", "n_convs", F.coalesce("n_children", F.when(F.col("n_convs") > F.col("n_ends"), 1).otherwise(0)).alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.coalesce("sha256", empty).alias("ends_sha256"), F.lit(False).alias("proven"))
    alone = F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(empty)
    own = lambda d: d.select("conv_id", "depth", "p1", "p2", F.lit(1).alias("n_convs"), (~F.col("last")).cast("int").alias("n_children"), F.lit(1).alias("n_leaves"), F.lit(0).alias("saved_tokens"), alone.alias("ends_sha256"), F.lit(True).alias("proven"))
    final = lambda d, parent: d.withColumn("parent_conv_id", parent)
    tails = final(own(single.filter("parent_single")), F.col("conv_id"))
    joined = named.union(own(open_single))
    top = final(joined.filter("depth = 1"), F.lit(r.least))
    below, parents = joined.filter("depth > 1"), groups.select("d1", "d2", F.col("depth").alias("at"), F.col("conv_id").alias("parent"))
    heavy = children.filter((F.col("n_children") > HEAVY * n_prefixes) & (F.col("n_children") > STRETCH)).select(F.col("p1").alias("d1"), F.col("p2").alias("d2"), (F.col("at") - 1).alias("at"))
    heavy = scratch.keep(parents.join(F.broadcast(heavy), ["d1", "d2", "at"]))  # at most 1 / HEAVY rows, as the children of all are nodes
    same = (F.col("p1") == F.col("d1")) & (F.col("p2") == F.col("d2")) & (F.col("depth") == F.col("at") + 1)
    parent = F.coalesce("parent", "conv_id")  # a parent that was proven to be of one conversation
    hot = final(below.join(F.broadcast(heavy), same), parent)
    cold = final(below.join(F.broadcast(heavy), same, "left_anti").join(parents.hint("merge"), same, "left"), parent)
    root = values.agg(F.min("conv_id").alias("conv_id"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), F.count("*").alias("n_convs"), F.lit(nodes.filter("depth = 1").count()).alias("n_children"),
                      F.greatest(F.sum("leaf"), F.lit(1)).alias("n_leaves"), (F.sum("saved") - F.min_by("saved", "conv_id")).alias("saved_tokens"))
    root = root.withColumns({"ends_sha256": F.lit((ends.filter("depth = 0").select("sha256").first() or [None])[0]), "proven": F.lit(False)})
    root = final(root.withColumn("ends_sha256", F.coalesce("ends_sha256", empty)), F.lit(None).cast("long"))
    every = root.select(*out, "parent_conv_id")
    for part in (tails, top, hot, cold):
        every = every.unionByName(part.select(*out, "parent_conv_id"))
    long = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return every.select(*[F.col(c).cast("long").alias(c) for c in long], "ends_sha256", "proven")


def _ends(rest: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """(d1, d2, depth, sha256) of the ids of conversations that end at a node, in order; those without turns end at the root (0, 0, 0)."""
    ids = rest.filter("last").select("d1", "d2", "depth", "conv_id").union(convs.filter("depth = 0").selectExpr("0L d1", "0L d2", "0 depth", "conv_id"))
    key = ["d1", "d2", "depth"]
    b = scan.blocks(ids, key, ["conv_id"])
    scratch.tables.append(b)
    chunks = b.groupBy(*key, "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))  # of one block alone
    return scratch.keep(sha256_of_chunks(chunks, key, "block", "ids", ","))


def prefix_trie(turns: DataFrame, base_of: Column | None = None, heads: Column | None = None, most: int = 0, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations of turns, as trie() describes it.

    With base_of and heads (columns of conv_id) a conversation's first heads turns are replaced by those of base_of before. Turns of one number are
    ordered by role, then text, and repeated rows are turns of their own; null roles and texts are empty; rows without a conv_id count
    for none; texts of any length are whole in their digest. Columns of turns that are not named do not matter. Conversation ids are
    whole numbers."""
    scratch = Scratch()
    zero = F.lit(0)
    rows = numbered(turns, scratch, conv, turn, role, text)
    prefixes, convs = rebuilt_prefixes(rows, scratch, F.col("conv_id") if base_of is None else base_of, zero if heads is None else heads, most)
    return scratch.finish(trie(prefixes, convs, scratch))


TRIE_SQL = f"""
with t as (select conv_id c, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) k from conversations where conv_id is not null),
h as (select c, {CRC_SQL.format(s="c::varchar")} % 6 h from (select distinct c from t)),
b as (select h.c, t.k pos, t.r, t.x from h join t on t.c = h.c - h.c % 100 and t.k <= h.h),
n as (select h.c, h.h, count(b.c) nb from h left join b on h.c = b.c group by 1, 2),
u as (select * from b union all select t.c, n.nb + t.k - n.h, t.r, t.x from t join n on t.c = n.c and t.k > n.h),
m as (select c, 0 depth, '' path, 0 chars from h union all select c, pos, string_agg(md5(length(r) || ':' || r || x), '/') over (partition by c order by pos), length(x) from u),
e as (select c, max(depth) last, arg_max(path, depth) path from m group by 1),
g as (select m.path, m.depth, min(m.c) c, count(*) n, any_value(m.chars) chars, coalesce(string_agg(case when e.last = m.depth then m.c::varchar end, ',' order by m.c), '') ends from m join e on m.c = e.c group by 1, 2),
p as (select g.*, m.path parent from g left join m on m.c = g.c and m.depth = g.depth - 1),
k as (select parent path, count(*) n from p where parent is not null group by 1),
v as (select m.path, sum((g.n - 1) * g.chars) saved, count(*) filter (where k.n is null) leaves from g join m on m.c = g.c and m.depth <= g.depth left join k on k.path = g.path group by 1)
select p.c conv_id, p.depth::bigint depth, q.c parent_conv_id, p.n n_convs, coalesce(k.n, 0) n_children, v.leaves n_leaves, v.saved::bigint saved_tokens, sha256(p.ends) ends_sha256
from p left join g q on q.path = p.parent left join k on k.path = p.path join v on v.path = p.path
"""
