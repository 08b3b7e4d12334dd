"""Prefix trie and structure repair against brute force, their SQL, and on odd input."""

import functools
import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from veriframe.llm import repair, trie
from veriframe.llm.queries import ORACLE_SQL, QUERIES
from veriframe.llm.shared import Scratch, shared_dir

DIR = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def turns(spark, rows):
    clash = {c: F.lit("x") for c in ("block", "k", "depth", "chars", "stretch", "letters", "n", "conv")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clash)


def nulls_first(*key):
    return tuple((k is not None, k) for k in key)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_structure_repair"])
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got = QUERIES[name](spark, DIR)
    want = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want.fetchall()))


def brute_trie(convs):
    """convs: id -> turns. All nodes by their prefixes."""
    nodes = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaf = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below), len(leaf),
                    sum((len(nodes[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(rng, n):
    pool = [("user", "a"), ("assistant", "bb"), ("user", None), (None, "ccc"), (None, None), ("user", "é" * 4)]
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5])):
            rows.append((c * 3, None if rng.random() < 0.1 else t, *pool[min(len(pool) - 1, int(rng.expovariate(1)))]))
    return rows + rows[:3] + [(None, 0, "user", "of none"), *[(7, t, "user", f"long {t}") for t in range(40)], *[(8, t, "user", f"long {t}") for t in range(25)]]


def ordered(rows):
    convs = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: nulls_first(r[1], r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    return convs


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, monkeypatch, small):
    rows = conversations(random.Random(5), 60)
    if small:  # a sketch that is far too small, short stretches, every parent heavy: the same nodes
        for name, value in {"PART": 64, "MOST_CELLS": 64, "STRETCH": 2, "HEAVY": 0.0}.items():
            monkeypatch.setattr(trie, name, value)
    got = trie.prefix_trie(turns(spark, rows))
    want = brute_trie(ordered(rows))
    assert sorted(map(tuple, got.drop("proven").collect()), key=str) == want
    proven = got.filter("proven").count()
    alone = sum(r[3] == 1 for r in want)
    assert proven < 0.8 * alone if small else proven > 0.9 * alone
    assert got.filter("proven and n_convs > 1").count() == 0


def test_trie_rebuilt(spark):
    rows = [(c, t, "user", f"{c % 3} {t}") for c in (0, 1, 2, 3, 100, 101, 205, 206) for t in range(c % 7)] + [(301, 0, "user", "x"), (302, 0, "user", "x")]
    convs = ordered(rows)
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    conv = F.col("conv_id")
    got = trie.prefix_trie(turns(spark, rows), conv - conv % 100, (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int"), 5)
    assert sorted(map(tuple, got.drop("proven").collect()), key=str) == brute_trie(built)


def test_trie_without_turns(spark):
    none = turns(spark, []).select("conv_id", "turn", "role", "text", "block")
    assert trie.prefix_trie(none).count() == 0
    assert trie.prefix_trie(turns(spark, [(None, 1, "user", "x")])).count() == 0
    conv = F.col("conv_id")
    got = trie.prefix_trie(turns(spark, [(5, 0, "user", "x"), (6, 0, "user", "y")]), F.lit(4).cast("long"), F.lit(3), 5)
    assert [tuple(r)[:7] for r in got.drop("proven").collect()] == [(5, 0, None, 2, 0, 1, 0)] and conv is not None
    assert got.first().ends_sha256 == hashlib.sha256(b"5,6").hexdigest()


def test_sketch_never_counts_too_few(spark):
    df = spark.range(5000).selectExpr("xxhash64(id div 2) d1", "xxhash64(id div 2, 1) d2").union(spark.range(3000).selectExpr("xxhash64(id, 7) d1", "xxhash64(id, 8) d2"))
    s = trie.sketch(df, 8000)
    p = df.groupBy("d1", "d2").count().toPandas()
    single = s.single(p["d1"].to_numpy(), p["d2"].to_numpy())
    assert not single[(p["count"] == 2).to_numpy()].any() and single[(p["count"] == 1).to_numpy()].mean() > 0.9


def brute_repair(rows):
    """rows: (role, text) after damage, in order. Counts, cost, audit and repaired rows, by the cheapest rest from every state."""
    seen, faults = set(), []
    for r, x in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", x)
        faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    move = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "T", ("T", "u"): "U"}
    word = {"u": "user", "a": "assistant"}

    @functools.cache
    def rest(i, state, room):
        best = [(0, "", ())] if i == len(rows) and state in "0T" else []
        if room:
            best += [(2 + c, "I" + a, ((word[t], ""), *o)) for t in "ua" if (state, t) in move for c, a, o in [rest(i, move[state, t], room - 1)]]
        if i < len(rows):
            (r, x), f = rows[i], faults[i]
            best += [(3 + c, "D" + a, o) for c, a, o in [rest(i + 1, state, 3)]]
            if f not in ("blank", "duplicate"):
                late = int(f == "truncated")
                if r and (state, r[0]) in move:
                    best += [(late + c, "K" + a, ((r, x), *o)) for c, a, o in [rest(i + 1, move[state, r[0]], 3)]]
                best += [(2 + late + c, "R" + a, ((word[t], x), *o)) for t in "ua" if (state, t) in move for c, a, o in [rest(i + 1, move[state, t], 3)]]
        return min(best, default=(10**9, "", ()))

    cost, audit, out = rest(0, "0", 3)
    return [faults.count(f) for f in ("blank", "duplicate", "truncated")], cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()


@pytest.mark.parametrize("stretch", [1024, 3, 1])
def test_repair(spark, monkeypatch, stretch):
    monkeypatch.setattr(repair, "STRETCH", stretch)
    rng = random.Random(stretch)
    roles = ["user", "assistant", "system", "User", "", None, "sudo", "tool"]
    texts = ["Yes.", "No", " \t", "", None, "Really?! ", "línea…", "Stop!\n", "a.b"]
    rows = []
    for c in range(90):
        for t in range(rng.choice([1, 2, 4, 7, 12])):
            rows.append((c, rng.choice([t, t, t, t + 1, None]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.6 else f"{rng.random()}."))
    rows += [(None, 0, "user", "of the null conversation."), (None, 1, "assistant", "Yes."), *[(500, t, "user" if t % 3 else "assistant", f"{t}." if t % 5 else "cut") for t in range(60)]]
    scratch = Scratch()
    t = turns(spark, rows).withColumn("key", repair.conv_key(F.col("conv_id")))
    done = repair.repair(t, scratch, conv="key")
    got = {r.conv: r for r in done.conversations.collect()}
    texts = {}
    for r in sorted(done.turns.collect(), key=lambda r: (r.conv, r.stretch, r.place)):
        texts.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    by = {}
    for c, turn, r, x in rows:
        by.setdefault("null" if c is None else str(c), []).append((turn, " " if r is None else r, " " if x is None else x))
    assert sorted(got) == sorted(by)
    for c, rs in by.items():
        rs.sort(key=lambda r: nulls_first(*r))
        faults, cost, audit, sha = brute_repair([r[1:] for r in rs])
        known = [r[0] for r in rs if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        g = got[c]
        assert (g.gaps, [g.blank, g.duplicate, g.truncated], g.illegal, g.cost, g.audit) == (gaps, faults, illegal, cost, audit), (c, rs)
        assert hashlib.sha256("\n".join(texts.get(c, [])).encode()).hexdigest() == sha


def test_repair_of_nothing(spark):
    none = turns(spark, []).select("conv_id", "turn", "role", "text")
    assert repair.repair_damaged(none).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    r = repair.repair_damaged(turns(spark, [(gone, 0, "user", "x")])).first()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_equal_tops_go_on_alike():
    """Merging by the top alone is right: every stack of one top takes the same terminals and ends alike."""
    seen, open_ = set(), [(0, None)]
    while open_:
        stack = open_.pop()
        seen.add(stack)
        open_ += [to for t in repair.LR.terminals if (to := repair.LR.shift(stack, t)) and to not in seen]
    assert len(seen) < 20
    for a in seen:
        for b in seen:
            if a[0] == b[0]:
                assert [bool(repair.LR.shift(a, t)) for t in "sua"] == [bool(repair.LR.shift(b, t)) for t in "sua"]
    assert [w for w in ("", "ua", "sua", "uaua", "suaua") if repair.parse(w) and any(p[0] == 0 and k in repair.LR.accepting for k, p in repair.parse(w).items())] == ["", "ua", "sua", "uaua", "suaua"]


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_quality_rules", "op13_structure_repair"])
def test_only_the_result_is_left(spark, name):
    at = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    QUERIES[name](spark, DIR)
    assert len(set(os.listdir(at)) - before) == 1
