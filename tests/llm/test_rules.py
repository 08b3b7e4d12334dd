"""Quality rules: counts against a plain version, votes and their model against brute force, and odd input."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from veriframe.llm import rules
from veriframe.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_counts():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["a ", "b ", "a\n", "\n", "é  ", "#x ", "\x1c", " ", "w<|> ", "\t\r\x0b\x0c", "日本 "]) for _ in range(rng.randrange(120)))
        m = rules.measure(t)
        assert tuple(m[c] for c in COLUMNS) == plain(t), repr(t)
    assert tuple(rules.measure(None)[c] for c in COLUMNS) == (0, 0, 0, 0, 0)
    long = "x y z " * 200_000
    assert tuple(rules.measure(long)[c] for c in COLUMNS) == (600_000, 600_000, 0, 0, 600_000)


def test_windows_of_one_hash(monkeypatch):
    words = [str(i % 9).encode() for i in range(50)] + [b"new", b"words"] + [str(i % 7).encode() for i in range(20)]
    want = rules.repeated_words(words)
    assert want == plain(" ".join(w.decode() for w in words))[4]
    monkeypatch.setattr(rules, "mix", lambda ids: np.zeros(len(ids), np.uint64))
    assert rules.repeated_words(words) == want


def test_model_by_brute_force():
    """The posterior is Bayes' rule on all rules' votes, and no step lowers the posterior's objective."""
    rng = np.random.default_rng(0)
    n, m = 4000, len(rules.RULES)
    good = rng.random(n) < 0.8
    right = np.stack([rng.uniform(0.9, 0.99, m), rng.uniform(0.3, 0.8, m)], axis=1)
    says = np.where(rng.random((n, m)) < np.where(good[:, None], right[:, 0], right[:, 1]), 1, -1) * np.where(good[:, None], 1, -1)
    says = np.where(rng.random((n, m)) < 0.1, 0, says)
    pats, count = np.unique(says, axis=0, return_counts=True)
    model = rules.expectation_maximisation(pats, count.astype(float))
    assert abs(model.good - good.mean()) < 0.03 and np.abs(model.right - right).max() < 0.1
    for row in pats[:50]:
        a, b = model.good, 1 - model.good
        for v, (g, h) in zip(row, model.right):
            a, b = a * (g if v == 1 else 1 - g if v == -1 else 1), b * (h if v == -1 else 1 - h if v == 1 else 1)
        assert abs(model.posterior(row[None, :])[0] - a / (a + b)) < 1e-9
    assert (model.posterior(says) >= 0.5).astype(bool).__eq__(good).mean() > 0.97
    few = [rules.expectation_maximisation(pats, count.astype(float), rounds=r).likelihood(pats, count) for r in (1, 3, 10, 100)]
    assert few == sorted(few)


def test_query_is_the_plain_version(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op12_quality_rules"](spark, DIR).collect()}
    assert len(got) == len(docs)
    votes = {d.doc_id: "".join(rules.SIGNS[f(rules.measure(d.text))] for f in rules.RULES.values()) for d in docs}
    p = rules.fit(sorted(Counter(votes.values()).items()))[1]
    for d in docs:
        r, want = got[d.doc_id], plain(d.text)
        assert tuple(r[c] for c in COLUMNS) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed and r.kept == (not failed and p[votes[d.doc_id]] >= 0.5)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    fine = [i for i, l in labels.items() if l.quality == 1 and i in got and not got[i].base_failed]
    poor = [i for i, l in labels.items() if l.quality == 0 and i in got]
    assert sum(got[i].kept for i in fine) >= 0.98 * len(fine) and sum(got[i].kept for i in poor) <= 0.3 * len(poor)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (None, "a b c"), (4, "word " * 30), (4, "word " * 30), (5, " ".join(f"w{i}" for i in range(200_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"votes": F.lit("+"), "n_words": F.lit(1), "m": F.lit(2)})
    out = rules.judge(docs)
    assert out.columns[:8] == ["doc_id", *COLUMNS, "base_failed", "kept"] and out.count() == 7
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].base_failed and not got[i].kept for i in (1, 2, 3, None, 4)) and got[5].kept and got[5].n_words == 200_000
    assert rules.judge(docs.limit(0)).count() == 0
