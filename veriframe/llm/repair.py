"""Repair of conversations' structure by generalised LR parsing with weighted edits.

The role grammar's LR automaton is built from its productions. A parse goes over a conversation's turns with a graph-structured stack:
every top is an automaton's state with a link to the rest of its stack, which other tops may share. A turn is kept, given another role or deleted, and turns
are inserted before it, each at its cost; equal tops merge into the one of the least (cost, audit). That loses nothing: stacks of one top go on alike in
this grammar, and two audits of one turn and one top are never each other's beginnings, as they would differ by inserted turns alone and so in cost.

A conversation of any length is cut into stretches, which are parsed side by side from every top that they may begin with; what is carried from one
stretch to the next is a cost and a rank for each top."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.shared import CRC_SQL, Scratch, sha256_of_chunks
from veriframe.operators import scan

#: Terminals are the roles' initials; the first production is the start.
GRAMMAR = [("Talk", ()), ("Talk", ("Pairs",)), ("Talk", ("s", "Pairs")), ("Pairs", ("Pair",)), ("Pairs", ("Pairs", "Pair")), ("Pair", ("u", "a"))]
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turns of a stretch.
STRETCH = 1024
WHITE = " \t\n\x0b\x0c\r"


class Automaton:
    """LR(0) automaton of a grammar: shift(stack, terminal) gives the stack after it and all reductions, or None."""

    def __init__(self, grammar: list[tuple[str, tuple[str, ...]]]):
        self.grammar, self.start = grammar, grammar[0][0]
        names = {left for left, _ in grammar}

        def closure(items: frozenset) -> frozenset:
            items = set(items)
            while True:
                more = {(i, 0) for p, dot in items if dot < len(grammar[p][1]) for i, (left, _) in enumerate(grammar) if left == grammar[p][1][dot]} - items
                if not more:
                    return frozenset(items)
                items |= more

        self.states = [closure(frozenset((i, 0) for i, (left, _) in enumerate(grammar) if left == self.start))]
        self.goto: dict[tuple[int, str], int] = {}
        for at, state in enumerate(self.states):
            for symbol in sorted({grammar[p][1][dot] for p, dot in state if dot < len(grammar[p][1])}):
                to = closure(frozenset((p, dot + 1) for p, dot in state if dot < len(grammar[p][1]) and grammar[p][1][dot] == symbol))
                if to not in self.states:
                    self.states.append(to)
                self.goto[at, symbol] = self.states.index(to)
        self.terminals = sorted({x for _, right in grammar for x in right} - names)
        done = [[grammar[p] for p, dot in sorted(s) if dot == len(grammar[p][1])] for s in self.states]
        self.accepting = {i for i, ps in enumerate(done) if any(left == self.start for left, _ in ps)}
        self.reduce = {i: ps[0] for i, ps in enumerate(done) if ps and ps[0][0] != self.start}
        self.stacks = self._stacks()

    def shift(self, stack: tuple, terminal: str) -> tuple | None:
        """stack: (state, rest of the stack)."""
        to = self.goto.get((stack[0], terminal))
        if to is None:
            return None
        stack = (to, stack)
        while stack[0] in self.reduce:
            left, right = self.reduce[stack[0]]
            for _ in right:
                stack = stack[1]
            stack = (self.goto[stack[0], left], stack)
        return stack

    def _stacks(self) -> dict[int, tuple]:
        """A stack for every top that can stand between two turns. Left recursion keeps all stacks of this grammar short, so there are few."""
        seen, found, open_ = set(), {}, [(0, None)]
        while open_:
            stack = open_.pop(0)
            seen.add(stack)
            found.setdefault(stack[0], stack)
            open_ += [to for t in self.terminals if (to := self.shift(stack, t)) and to not in seen and to not in open_]
        return found


LR = Automaton(GRAMMAR)

Parse = tuple[int, str, str, tuple]  # cost, audit, script, stack


def inserts(tops: dict[int, Parse]) -> dict[int, Parse]:
    """tops and all that inserted turns make of them, each as cheap as it can be."""
    tops, fresh = dict(tops), dict(tops)
    while fresh:
        found: dict[int, Parse] = {}
        for cost, audit, script, stack in fresh.values():
            for t in ROLES:
                if to := LR.shift(stack, t):
                    new = (cost + INSERT, audit + "I", script + t, to)
                    if to[0] not in tops or new[:2] < tops[to[0]][:2]:
                        tops[to[0]] = found[to[0]] = new
        fresh = found
    return tops


def parse(letters: str, top: int = 0) -> dict[int, Parse]:
    """The best parse of a stretch from a top to every top, without inserted turns behind its last turn.

    A letter is a turn: s, u, a for roles of these initials, o for others, capitals for truncated texts and x for a turn that must go. In an audit K, R, D, I are
    kept, rerole, deleted, inserted; a script says the same in the letters K, U or A (rerole), D, u or a (insert)."""
    tops = {top: (0, "", "", LR.stacks[top])}
    for letter in letters:
        new: dict[int, Parse] = {}

        def add(cost: int, audit: str, script: str, stack: tuple | None) -> None:
            if stack and (stack[0] not in new or (cost, audit) < new[stack[0]][:2]):
                new[stack[0]] = (cost, audit, script, stack)

        late = TRUNCATED if letter.isupper() else 0
        for cost, audit, script, stack in inserts(tops).values():
            add(cost + DELETE, audit + "D", script + "D", stack)
            if letter != "x":
                add(cost + late, audit + "K", script + "K", LR.shift(stack, letter.lower()))
                for t in ROLES:
                    add(cost + late + REROLE, audit + "R", script + t.upper(), LR.shift(stack, t))
        tops = new
    return tops


def ending(top: int) -> tuple[int, str, str] | None:
    """The cheapest inserted turns that end a conversation at this top: cost, audit, script."""
    done = [p[:3] for s, p in inserts({top: (0, "", "", LR.stacks[top])}).items() if s in LR.accepting]
    return min(done) if done else None


@lru_cache(maxsize=200_000)
def _short(letters: str, first: bool) -> tuple:
    return _table(letters, first)


def _table(letters: str, first: bool) -> tuple:
    return tuple((top, to, *p[:3]) for top in ([0] if first else LR.stacks) for to, p in parse(letters, top).items())


TABLE = "array<struct<top: int, to: int, cost: long, audit: string, script: string>>"


def stretch_table(letters: pd.Series, first: pd.Series) -> pd.Series:
    """Every way through a stretch; the first stretch of a conversation begins at the start alone."""
    fields = ("top", "to", "cost", "audit", "script")
    return pd.Series([[dict(zip(fields, row)) for row in (_short if len(x) <= 32 else _table)(x, f)] for x, f in zip(letters, first)])


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(conv, stretch, top, to, tail): the way through the stretches of each conversation; tail is what is inserted behind the last.

    For each top a cost and the rank of its audit are carried, and of each stretch the top that each top came from."""
    conv, at, back, names = None, {}, [], []

    def ended() -> Iterator[tuple]:
        ways = [((cost + end[0], rank, end[1]), top, end[2]) for top, (cost, rank) in at.items() if (end := ending(top))]
        _, to, tail = min(ways)
        way = []
        for came in reversed(back):
            way.append((came[to], to))
            to = came[to]
        for n, ((top, to), name) in enumerate(zip(reversed(way), names)):
            yield conv, name, top, to, tail if n == len(way) - 1 else ""

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv", "stretch", "top", "to", "tail"])

    for pdf in batches:
        out = []
        for c, name, ways in zip(pdf["conv"], pdf["stretch"], pdf["ways"]):
            if c != conv:
                if conv is not None:
                    out.extend(ended())
                conv, at, back, names = c, {0: (0, 0)}, [], []
            best: dict[int, tuple] = {}
            for w in ways:
                if w["top"] in at:
                    cost, rank = at[w["top"]]
                    new = (cost + w["cost"], rank, w["audit"], w["top"])
                    if w["to"] not in best or new < best[w["to"]]:
                        best[w["to"]] = new
            order = {to: n for n, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
            at = {to: (p[0], order[to]) for to, p in best.items()}
            back.append({to: p[3] for to, p in best.items()})
            names.append(name)
        yield frame(out)
    if conv is not None:
        yield frame(list(ended()))


@dataclass
class Repaired:
    """conversations: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. turns: conv, stretch, place, role, text, action (K, R or I) of the repaired ones."""

    conversations: DataFrame
    turns: DataFrame


def conv_key(conv: Column) -> Column:
    """Ids as texts, so that a null id is a conversation like any other."""
    return F.coalesce(conv.cast("string"), F.lit("null"))


def repair(turns: DataFrame, scratch: Scratch, conv: str = "conv", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """Repairs conversations: turns in the order of turn (nulls first), role and text; conv is a text that is not null.

    Blank turns and those whose role and text were said before must go; a turn's first fault (blank, duplicate, truncated) counts. Null roles and texts are one space.
    A role whose initial is none of s, u, a, the empty one too, is legal nowhere. Repeated rows are duplicates; a conversation may have any number of turns of any
    length; conversations without turns have no row; other columns do not matter."""
    t = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    order = ["turn", "role", "text"]
    b = scan.blocks(t, ["conv"], order)
    scratch.tables.append(b)
    initial = F.substring("role", 1, 1)
    said = F.rtrim("text", F.lit(WHITE))
    rows = scan.running(b, ["conv"], order, k=("sum", F.lit(1)), before=("prior", F.struct(initial.alias("initial"), F.col("turn"))))
    pair = F.concat("before.initial", initial)
    rows = rows.withColumns({
        "k": F.col("k").cast("long"), "stretch": F.floor((F.col("k") - 1) / STRETCH).cast("long"), "initial": initial, "blank": said == "", "late": ~F.substring(said, -1, 1).isin(".", "!", "?"),
        "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)), "new_turn": F.col("turn").isNotNull() & ~F.coalesce(F.col("turn") == F.col("before.turn"), F.lit(False)),
        "sha": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)})
    rows = scratch.keep(rows.drop("before", "block"))
    first = rows.groupBy("conv", "sha").agg(F.min("k").alias("k")).select("conv", "k", F.lit(True).alias("fresh"))
    marked = rows.drop("role", "text", "sha").join(first.hint("merge"), ["conv", "k"], "left").withColumn("repeated", ~F.col("blank") & F.col("fresh").isNull())
    late = ~F.col("blank") & ~F.col("repeated") & F.col("late")
    own = F.when(F.col("initial").isin(*LR.terminals), F.col("initial")).otherwise("o")
    letter = F.when(F.col("blank") | F.col("repeated"), "x").when(late, F.upper(own)).otherwise(own)
    count = lambda c, name: F.count_if(c).cast("long").alias(name)
    # of a stretch, STRETCH letters and the counts; a conversation's counts are sums of its stretches'
    some = marked.groupBy("conv", "stretch").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", letter.alias("l")))), lambda x: x["l"]), "").alias("letters"),
        count(F.col("blank"), "blank"), count(F.col("repeated"), "duplicate"), count(late, "truncated"), count(F.col("illegal"), "illegal"), count(F.col("new_turn"), "turns"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    some = scratch.keep(some.withColumn("ways", F.pandas_udf(stretch_table, TABLE)("letters", F.col("stretch") == 0)).drop("letters"))
    paths = some.select("conv", "stretch", "ways").repartition("conv").sortWithinPartitions("conv", "stretch").mapInPandas(_paths, "conv string, stretch long, top int, to int, tail string")
    chosen = F.filter("ways", lambda w: (w["top"] == F.col("top")) & (w["to"] == F.col("to")))[0]
    ways = some.join(paths.hint("merge"), ["conv", "stretch"]).withColumn("way", chosen)
    ways = scratch.keep(ways.drop("ways", "top", "to"))
    tail_cost = INSERT * F.length("tail")
    audit = F.transform(F.sort_array(F.collect_list(F.struct("stretch", F.concat("way.audit", F.repeat(F.lit("I"), F.length("tail"))).alias("a")))), lambda x: x["a"])
    convs = ways.groupBy("conv").agg(F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
                                     F.sum(F.col("way.cost") + tail_cost).cast("long").alias("cost"), F.array_join(audit, "").alias("audit"))
    steps = F.regexp_extract_all("script", F.lit("([ua]*[KUAD])"), F.lit(1))
    name = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    put = lambda inits: F.transform(F.filter(F.split(inits, ""), lambda c: c != ""), lambda c: F.struct(F.element_at(name, c).alias("role"), F.lit("").alias("text"), F.lit("I").alias("action")))

    def apply(x: Column, step: Column) -> Column:
        act = F.substring(step, -1, 1)
        kept = F.struct(F.when(act == "K", x["role"]).otherwise(F.element_at(name, F.lower(act))).alias("role"), x["text"].alias("text"), F.when(act == "K", "K").otherwise("R").alias("action"))
        return F.concat(put(F.regexp_extract(step, "^([ua]*)", 1)), F.filter(F.array(kept), lambda _: act != "D"))

    texts = rows.groupBy("conv", "stretch").agg(F.sort_array(F.collect_list(F.struct("k", "role", "text"))).alias("rows"))
    joined = texts.join(ways.select("conv", "stretch", F.col("way.script").alias("script"), "tail").hint("merge"), ["conv", "stretch"])
    made = joined.select("conv", "stretch", F.posexplode(F.concat(F.flatten(F.zip_with("rows", steps, apply)), put(F.col("tail")))).alias("place", "x"))
    return Repaired(convs, made.select("conv", "stretch", "place", "x.*"))


def damage(turns: DataFrame) -> DataFrame:
    """Rows with faults, told by crc32('conv_id:turn') % 20: 0 is dropped, 1 has an empty text, 2 none of . ! ?, 3 stands twice, 4 is the user's. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    t = turns.select(conv_key(F.col("conv_id")).alias("conv"), "turn", kind.alias("kind"), space("role").alias("role"), space("text").alias("text")).filter("kind <> 0")
    t = t.withColumns({"text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")), "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return t.withColumn("_", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv", "turn", "role", "text")


def repair_damaged(turns: DataFrame) -> DataFrame:
    """Every conversation of turns, damaged and repaired: the counts, cost and audit, and the digest of the repaired turns. The digest goes along one conversation's text, as it must."""
    scratch = Scratch()
    done = repair(damage(turns), scratch)
    line = F.concat("role", F.lit(":"), "text")
    lines = done.turns.groupBy("conv", "stretch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    sha = sha256_of_chunks(lines, ["conv"], "stretch", "lines", "\n")
    every = turns.select(conv_key(F.col("conv_id")).alias("conv"), F.col("conv_id").alias("id")).groupBy("conv").agg(F.first("id").alias("conv_id"))
    out = every.join(done.conversations.hint("merge"), "conv", "left").join(sha.hint("merge"), "conv", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return scratch.finish(out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


REPAIR_SQL = r"""
with recursive o as (select coalesce(conv_id::varchar, 'null') c, conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') x, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') s from conversations),
z as (select *, {CRC} % 20 kind from o),
d as (select c, turn, case when kind = 4 then 'user' else r end r, case kind when 1 then '' when 2 then translate(x, '.!?', '') else x end x from z, range(2) q(i) where kind <> 0 and (i = 0 or kind = 3)),
n as (select *, row_number() over (partition by c order by turn nulls first, r, x) k, rtrim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) e from d),
f as (select *, e = '' blank, row_number() over (partition by c, r, x order by k) > 1 again, right(e, 1) not in ('.', '!', '?') late, lag(r[1]) over (partition by c order by k) || r[1] pair from n),
l as (select c, k, r, x, r[1] i, blank or again gone, case when late and not blank and not again then 1 else 0 end late from f),
ins(a, b, cost, audit, rep) as (values (0,0,0,'',''),(0,2,2,'I',chr(10)||'user:'),(0,3,4,'II',chr(10)||'user:'||chr(10)||'assistant:'),(1,1,0,'',''),(1,2,2,'I',chr(10)||'user:'),(1,3,4,'II',chr(10)||'user:'||chr(10)||'assistant:'),(2,2,0,'',''),(2,3,2,'I',chr(10)||'assistant:'),(3,3,0,'',''),(3,2,2,'I',chr(10)||'user:')),
sh(a, i, b) as (values (0,'s',1),(0,'u',2),(1,'u',2),(2,'a',3),(3,'u',2)),
p as (select c, 0::bigint k, 0 st, 0 cost, '' audit, '' rep from (select distinct c from l)
 union all
 select c, any_value(k), st, min(cost), arg_min(audit, {'cost': cost, 'audit': audit}), arg_min(rep, {'cost': cost, 'audit': audit}) from (
  select p.c, l.k, w.b st, p.cost + ins.cost + w.cost cost, p.audit || ins.audit || w.audit audit, p.rep || ins.rep || w.line rep
  from p join ins on ins.a = p.st join l on l.c = p.c and l.k = p.k + 1
  join lateral (select ins.b b, 3 cost, 'D' audit, '' line union all
   select sh.b, l.late, 'K', chr(10) || l.r || ':' || l.x from sh where sh.a = ins.b and sh.i = l.i and not l.gone union all
   select sh.b, 2 + l.late, 'R', chr(10) || case sh.i when 'u' then 'user' else 'assistant' end || ':' || l.x from sh where sh.a = ins.b and sh.i <> 's' and not l.gone) w on true) group by c, st),
e as (select p.c, p.cost + ins.cost cost, p.audit || ins.audit audit, p.rep || ins.rep rep from p join ins on ins.a = p.st and ins.b in (0, 3) where p.k = (select max(k) from l where l.c = p.c)),
b as (select c, arg_min(e, {'cost': cost, 'audit': audit}) v from e group by 1),
g as (select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (blank) blank, count(*) filter (not blank and again) duplicate, count(*) filter (not blank and not again and late) truncated, count(*) filter (pair not in ('su', 'ua', 'au')) illegal from f group by 1)
select a.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, coalesce(v.cost, 0)::bigint cost, coalesce(v.audit, '') audit, sha256(coalesce(substr(v.rep, 2), '')) repaired_sha256
from (select distinct c, conv_id from o) a left join g on a.c = g.c left join b on a.c = b.c
""".replace("{CRC}", CRC_SQL.format(s="s"))
