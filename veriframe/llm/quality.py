"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade >= k) = 1 / (1 + exp(theta_k - w.x)): one weight vector over hashed text features, and a threshold
for every grade, kept in order. The expected grade ranks documents and a tail probability selects them."""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the fit: labelled rows, by a hash of their id.
SAMPLE_ROWS = 8_000
BITS = 14
DOUBLED = re.compile(r"([^\w\s])\1")
UPPER, DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
LETTERS = UPPER + UPPER.lower()


def shape(text: str, words: list[str]) -> dict[str, float]:
    """Whole-text measures that are hashed by their steps."""
    n, raw = max(1, len(words)), text.encode()
    size = max(1, len(raw))
    less = lambda drop: size - len(raw.translate(None, drop))
    lines = text.split("\n")
    same = sum(map(operator.eq, words, words[1:]))
    return {
        "words": math.log2(n), "upper": 10 * less(UPPER) / max(1, less(LETTERS)), "digit": 20 * less(DIGIT) / size, "pipe": 10 * text.count("|") / n,
        "doubled": 10 * len(DOUBLED.findall(text)) / n, "repeat": 20 * same / n, "lines": 10 * (1 - len(set(lines)) / len(lines)),
        "unique": 10 * len(set(words)) / n / (1 + math.log2(n)), "length": len(text) / n,
    }


def features(text: str | None, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed indices and values: words by their share, measures by their steps. A null text is an empty one."""
    words = (text or "").split()
    if len(known) > 300_000:
        known.clear()
    mask = (1 << BITS) - 1
    for w in set(words).difference(known):
        known[w] = xxhash.xxh32_intdigest(w) & mask
    steps = shape(text or "", words)
    named = [xxhash.xxh32_intdigest(f"{k}={round(v)}" if v >= 0.05 else f"{k}=none") & mask for k, v in steps.items()]
    index = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    index, count = np.unique(index, return_counts=True)
    value = np.sqrt(count / max(1, len(words)))
    return np.r_[index, np.array(named, np.int64)], np.r_[0.5 * value, np.ones(len(named))]


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    def tails(self, text: str | None, known: dict[str, int]) -> np.ndarray:
        """P(grade >= each of the grades but the lowest)."""
        i, v = features(text, known)
        return 1 / (1 + np.exp(np.clip(self.thresholds - (self.weights[i] * v).sum(), -50, 50)))


def loss(p: np.ndarray, idx: np.ndarray, val: np.ndarray, start: np.ndarray, of: np.ndarray, y: np.ndarray, k: int, ridge: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with its ridge, and the gradient. p: weights, first threshold, logs of the steps to the next ones.

    idx, val: features of all rows, of which row r begins at start[r]; of: the row of each; y: places of the grades; k: thresholds."""
    cut = 1 << BITS
    steps = np.exp(p[cut + 1 :])
    theta = np.r_[p[cut], p[cut] + np.cumsum(steps)]
    eta = np.add.reduceat(p[idx] * val, start)
    tail = 1 / (1 + np.exp(np.clip(theta - eta[:, None], -50, 50)))
    full = np.c_[np.ones(len(y)), tail, np.zeros(len(y))]
    like = np.maximum(full[np.arange(len(y)), y] - full[np.arange(len(y)), y + 1], 1e-9)
    # d like / d (eta - theta_j): upper edge of its own grade +, lower edge -
    sign = (y[:, None] == np.arange(1, k + 1)).astype(float) - (y[:, None] == np.arange(k))
    g = -(sign * tail * (1 - tail)) / like[:, None] / len(y)
    g_eta, g_theta = g.sum(axis=1), -g.sum(axis=0)
    grad = np.r_[np.bincount(idx, val * g_eta[of], minlength=cut)[:cut] + ridge * p[:cut], g_theta.sum(), np.cumsum(g_theta[::-1])[::-1][1:] * steps]
    return float(-np.log(like).mean() + ridge / 2 * (p[:cut] ** 2).sum()), grad


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], grades: list[int], rounds: int = 200, rate: float = 0.1, ridge: float = 1e-4) -> Ordinal:
    """rows: features of each text. Maximum likelihood by Adam; thresholds stay ordered as a first one and positive steps."""
    levels = sorted(set(grades))
    k = max(1, len(levels) - 1)
    if len(levels) < 2:
        return Ordinal(np.zeros(1 << BITS), np.full(k, -5.0), levels or [0])
    y = np.searchsorted(levels, grades)
    idx, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    size = np.array([len(r[0]) for r in rows])
    start, of = np.r_[0, np.cumsum(size)[:-1]], np.repeat(np.arange(len(rows)), size)
    cut = 1 << BITS
    p = np.zeros(cut + k)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        grad = loss(p, idx, val, start, of, y, k, ridge)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Ordinal(p[:cut], np.r_[p[cut], p[cut] + np.cumsum(np.exp(p[cut + 1 :]))], levels)


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Ordinal:
    """ratings: (doc_id, grade). At most SAMPLE_ROWS rated documents are fitted; rows without grade or id are left out.

    A document that is rated or stands in docs more than once counts each time; without two different grades (an empty table
    too) every document has the one grade there is. Texts are hashed by the tasks that read them; features alone come to the driver."""
    ids = ratings.select(F.col(id_col).alias("doc_id"), F.col(grade_col).cast("int").alias("grade")).filter("doc_id is not null and grade is not null")
    ids = ids.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(SAMPLE_ROWS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id").select("text", "grade")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            made = [features(t, known) for t in pdf["text"]]
            yield pd.DataFrame({"grade": pdf["grade"], "index": [i.astype("<u2").tobytes() for i, _ in made], "value": [v.astype("<f4").tobytes() for _, v in made]})

    got = rows.mapInPandas(hashed, "grade int, index binary, value binary").toArrow()
    index, value = ([np.frombuffer(x, kind) for x in got[c].to_pylist()] for c, kind in (("index", "<u2"), ("value", "<f4")))
    return fit_rows([(i.astype(np.int32), v) for i, v in zip(index, value)], got["grade"].to_pylist())


def scorer(model: Ordinal, spark) -> "callable":
    """A column function: text -> struct(expected_grade, p_tail); p_tail: the probability of more than the lowest grade."""
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        m = shared.value
        gaps = np.diff(m.grades) if len(m.grades) > 1 else np.zeros(1)
        for texts in batches:
            tails = [m.tails(t, known) for t in texts]
            yield pd.DataFrame({"expected_grade": [float(m.grades[0] + (gaps * t).sum()) for t in tails], "p_tail": [float(t[0]) for t in tails]})

    return F.pandas_udf(score, "expected_grade double, p_tail double")


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from the labels table: its quality; null is no rating."""
    return labels.select("doc_id", F.col("quality").alias("grade"))


def score_quality(docs: DataFrame, ratings: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, p_tail, kept) of whole texts; null and empty texts are scored by their shape. All rows stay, those of null or repeated ids too."""
    model = fit(docs, ratings, id_col, text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), scorer(model, docs.sparkSession)(F.col(text_col)).alias("r"))
    return out.select("doc_id", "r.expected_grade", "r.p_tail", (F.col("r.p_tail") >= threshold).alias("kept"))
