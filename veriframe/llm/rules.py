"""Quality rules as weak supervision.

Each rule votes good or bad on a document, or abstains. Votes are counted by pattern over all documents, expectation-maximisation on these counts
estimates how often each rule is right about good and about bad documents, and a document's posterior probability of being good follows from its pattern."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.shared import Scratch

WINDOW = 5
SYMBOLS, WHITE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
UPPER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
LETTERS = UPPER + UPPER.lower()
ENDS = tuple(c.encode() for c in ".!?:;\"'”»。…")
#: Bytes that are marks: printable ASCII without letters and digits.
MARK = np.array([33 <= c <= 126 and not chr(c).isalnum() for c in range(256)])
MARKS = bytes(np.flatnonzero(MARK).tolist())


def mix(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words found twice or more. Windows are compared by hashes first, equal hashes by their words."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    mixed = mix(ids)
    h = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[i : n + i]
    order = np.argsort(h, kind="stable")
    twin = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(twin):
        return 0
    a, b = order[twin], order[twin + 1]
    span = np.arange(WINDOW)
    if (ids[a[:, None] + span] == ids[b[:, None] + span]).all():
        found = np.union1d(a, b)
    else:  # two windows of one hash: count them as they are
        often = Counter(zip(*[words[i : n + i] for i in range(WINDOW)]))
        found = np.array([i for i, w in enumerate(zip(*[words[i : n + i] for i in range(WINDOW)])) if often[w] > 1], np.int64)
    if not len(found):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> dict[str, float]:
    """What the rules look at, of a whole text; a null text is one without words."""
    raw = (text or "").encode()
    words = raw.split()
    less = lambda drop: len(raw) - len(raw.translate(None, drop))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    some = max(1, n)
    held = np.frombuffer(raw, np.uint8)
    return {
        "n_words": n, "word_chars": len(text or "") - less(WHITE), "n_symbols": less(SYMBOLS), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated_words(words), "lines": len(lines),
        "letters": less(LETTERS), "upper": less(UPPER) / max(1, less(LETTERS)), "digits": less(DIGITS) / max(1, len(raw)), "doubled": float((MARK[held[1:]] & (held[1:] == held[:-1])).sum() / some),
        "stutter": sum(map(bytes.__eq__, words, words[1:])) / some, "ended": sum(x.rstrip().endswith(ENDS) for x in lines) / max(1, len(lines)), "lettered": len(raw.translate(None, MARKS).split()) / some, "longest": float(max(map(len, words), default=0)),
    }


Vote = Callable[[dict[str, float]], int]


def between(value: Callable[[dict], float], good: tuple[float, float], fair: tuple[float, float], when: Callable[[dict], bool] = lambda m: True) -> Vote:
    """1 within good, -1 outside fair, 0 between the two or where the rule has nothing to go by."""

    def vote(m: dict[str, float]) -> int:
        if not when(m):
            return 0
        v = value(m)
        return 1 if good[0] <= v <= good[1] else 0 if fair[0] <= v <= fair[1] else -1

    return vote


INF = float("inf")
#: Rules by name. Each needs no other one to be right: it is a vote, not a filter.
RULES: dict[str, Vote] = {
    "length": between(lambda m: m["n_words"], (50, 100_000), (20, INF)),
    "word_length": between(lambda m: m["word_chars"] / m["n_words"], (3.5, 9), (2.5, 12), lambda m: m["n_words"] >= 10),
    "symbols": between(lambda m: m["n_symbols"] / m["n_words"], (0, 0.02), (0, 0.1), lambda m: m["n_words"] > 0),
    "lines": between(lambda m: m["n_dup_lines"] / m["lines"], (0, 0.1), (0, 0.3), lambda m: m["lines"] >= 3),
    "windows": between(lambda m: m["n_repeat_words"] / m["n_words"], (0, 0.05), (0, 0.15), lambda m: m["n_words"] >= 30),
    "capitals": between(lambda m: m["upper"], (0, 0.15), (0, 0.4), lambda m: m["letters"] >= 20),
    "digits": between(lambda m: m["digits"], (0, 0.05), (0, 0.2), lambda m: m["n_words"] > 0),
    "lettered": between(lambda m: m["lettered"], (0.95, 1), (0.8, 1), lambda m: m["n_words"] > 0),
    "doubled": between(lambda m: m["doubled"], (0, 0.02), (0, 0.1), lambda m: m["n_words"] > 0),
    "stutter": between(lambda m: m["stutter"], (0, 0.02), (0, 0.1), lambda m: m["n_words"] >= 10),
    "ended": between(lambda m: m["ended"], (0.5, 1), (0.1, 1), lambda m: m["lines"] >= 3),
    "longest": between(lambda m: m["longest"], (0, 60), (0, 1000), lambda m: m["n_words"] > 0),
}
SIGNS = {1: "+", 0: "0", -1: "-"}


@dataclass
class Votes:
    """good: the share of good documents; right: of each rule, how often it votes good on good documents and bad on bad ones, where it votes."""

    good: float
    right: np.ndarray  # rules x (good, bad)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of being good, of rows of votes (1, 0, -1)."""
        say = np.log(np.stack([self.right, 1 - self.right], axis=2))  # rules x class x (right, wrong)
        log = np.log([self.good, 1 - self.good])[None, :] + (votes == 1) @ np.stack([say[:, 0, 0], say[:, 1, 1]], axis=1) + (votes == -1) @ np.stack([say[:, 0, 1], say[:, 1, 0]], axis=1)
        return 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -700, 700)))

    def likelihood(self, votes: np.ndarray, n: np.ndarray) -> float:
        say = np.log(np.stack([self.right, 1 - self.right], axis=2))
        log = np.log([self.good, 1 - self.good])[None, :] + (votes == 1) @ np.stack([say[:, 0, 0], say[:, 1, 1]], axis=1) + (votes == -1) @ np.stack([say[:, 0, 1], say[:, 1, 0]], axis=1)
        return float((n * np.logaddexp(log[:, 0], log[:, 1])).sum())


#: What is believed before any vote, as counts: most documents are good; a rule is seldom wrong about a good one (right, wrong), and finds some of the bad ones alone, as each looks at one thing (right, wrong).
PRIOR_DOCS, PRIOR_RIGHT, PRIOR_WRONG = (8.0, 2.0), (49.0, 3.0), (1.0, 7.0)


def expectation_maximisation(votes: np.ndarray, n: np.ndarray, rounds: int = 500, enough: float = 1e-9) -> Votes:
    """From rows of votes, each of n documents. Priors keep every share between 0 and 1 and fix which class is the good one; abstentions say nothing."""
    m = votes.shape[1]
    right, wrong = np.array(PRIOR_RIGHT), np.array(PRIOR_WRONG)
    model = Votes(PRIOR_DOCS[0] / sum(PRIOR_DOCS), np.tile(right / (right + wrong), (m, 1)))
    for _ in range(rounds):
        p = model.posterior(votes)
        w = np.stack([n * p, n * (1 - p)])
        up, down = w @ (votes == 1), w @ (votes == -1)  # class x rules
        good = (w[0].sum() + PRIOR_DOCS[0]) / (n.sum() + sum(PRIOR_DOCS))
        new = Votes(float(good), (np.stack([up[0], down[1]], axis=1) + right) / ((up + down).T + right + wrong))
        moved = max(abs(new.good - model.good), float(np.abs(new.right - model.right).max(initial=0)))
        model = new
        if moved < enough:
            break
    return model


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        m = measure(t)
        out.append((*[int(m[c]) for c in COUNTS], "".join(SIGNS[r(m)] for r in RULES.values())))
    return pd.DataFrame(out, columns=[*COUNTS, "votes"])


def fit(patterns: list[tuple[str, int]]) -> tuple[Votes, dict[str, float]]:
    """The model, and the posterior of each pattern of signs, from the patterns' counts."""
    votes = np.array([[{"+": 1, "0": 0, "-": -1}[c] for c in p] for p, _ in patterns], int).reshape(len(patterns), len(RULES))
    model = expectation_maximisation(votes, np.array([c for _, c in patterns], float))
    return model, dict(zip([p for p, _ in patterns], model.posterior(votes).tolist()))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def judge(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept, votes (a sign for each rule) and p_good of every row.

    All rows vote, those of null and repeated ids too; a null or empty text has no words, so it fails. Texts are measured whole, at any length. The driver gets patterns of votes with
    their counts: at most 3 to the number of rules, whatever the number of documents. An empty table gives an empty result."""
    scratch = Scratch()
    rows = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), F.pandas_udf(measured, ", ".join(f"{c} long" for c in COUNTS) + ", votes string")(F.col(text_col)).alias("m")).select("doc_id", "m.*"))
    patterns = sorted((r.votes, r.n) for r in rows.groupBy("votes").agg(F.count("*").alias("n")).collect())
    spark = docs.sparkSession
    table = spark.createDataFrame(list(fit(patterns)[1].items()) if patterns else [], "votes string, p_good double")
    out = rows.join(F.broadcast(table), "votes")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return scratch.finish(out.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("p_good") >= threshold)).alias("kept"), "votes", "p_good"))
