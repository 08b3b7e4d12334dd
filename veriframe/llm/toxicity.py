"""Toxicity by maximum-scoring segments.

Tokens get log-odds of toxic against other labelled documents, smoothed by Dirichlet priors (a word's prior
follows its prefix); a linear scan finds every maximal segment of each text. Under the clean documents'
token scores a segment's largest score has an extreme-value law, whose lambda and K turn scores into
expected counts; these are fitted to the labels by a logistic curve."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.llm.shared import discard, materialize, words_of

#: Bound of the fit: labelled rows, by a hash of their id. All tokens of these rows have a weight.
SAMPLE_ROWS = 20_000
PREFIX = 6  # bytes
#: Documents that the prior of a word and of a prefix counts as.
PSEUDO, PREFIX_PSEUDO = 2.0, 2.0
#: Standard deviations of its posterior by which every log-odds is drawn towards none.
DOUBT = 1.5
#: A word that stands so few words before says nothing again: runs of one word are no passage.
REPEATED = 64
#: What every token costs, so that a text scores below zero where nothing is known of it.
COST = 0.2
#: A segment is significant if so few are expected by chance in a text of its length.
EXPECTED = 0.05
#: Scores are counted in steps of this width when the law of chance is fitted.
STEP = 0.02
#: Words whose weight a worker remembers before it starts anew.
KEPT = 400_000


def token_key(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token) - (1 << 63)


@dataclass
class Toxicity:
    """keys, weights: sorted hashes of words, and of prefixes of PREFIX bytes (with a star), and their log-odds."""

    keys: np.ndarray
    weights: np.ndarray
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, 0.0)
    known: dict = field(default_factory=dict, repr=False, compare=False)

    def _learn(self, words: set[bytes]) -> None:
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = list(words)
        if not new:
            return
        if not len(self.keys):
            self.known.update(dict.fromkeys(new, -COST))
            return

        def look(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            key = np.fromiter(map(token_key, tokens), np.int64, len(tokens))
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return self.keys[at] == key, self.weights[at].astype(float)

        own, weight = look(new)
        rest, prior = look([w[:PREFIX] + b"*" for w in new])
        weight = np.where(own, weight, np.where(rest, np.clip(prior, -3, 3), 0.0)) - COST
        self.known.update(zip(new, weight.tolist()))

    def token_scores(self, words: list[bytes]) -> np.ndarray:
        """Log-odds less COST of each word; a word that was not seen has its prefix's, or none. Near repeats of a word cost, but do not add."""
        self._learn(set(words))
        s, last = np.fromiter(map(self.known.__getitem__, words), float, len(words)), {}
        for at in np.flatnonzero(s > 0).tolist():
            w = words[at]
            if at - last.get(w, -REPEATED) < REPEATED:
                s[at] = -COST
            last[w] = at
        return s

    def segments(self, s: np.ndarray) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (start, end, score) of the token scores, in linear time."""
        total = np.r_[0.0, np.cumsum(s)]
        found: list[list] = []  # start, end, sum before, sum after, index of the last one with a smaller sum before
        for at in np.flatnonzero(s > 0).tolist():
            x = [at, at + 1, total[at], total[at + 1], -1]
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][2] >= x[2]:
                    j = found[j][4]
                x[4] = j
                if j < 0 or found[j][3] >= x[3]:
                    found.append(x)
                    break
                x[0], x[2] = found[j][0], found[j][2]
                del found[j:]
        return [(a, b, r - l) for a, b, l, r, _ in found]

    def significant(self, n_words: int, segments: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """The segments of fewer than EXPECTED by chance, with -log10 of the expected count."""
        out = []
        for a, b, score in segments:
            e = self.k * n_words * math.exp(-self.lam * score)
            if e < EXPECTED:
                out.append((a, b, -math.log10(max(e, 1e-300))))
        return out

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and the significant segments."""
        words = words_of(text)
        return len(words), self.significant(len(words), self.segments(self.token_scores(words)))

    @staticmethod
    def features(found: list[tuple[int, int, float]]) -> tuple[float, float, float, float]:
        """Of the significant segments: the strongest and the second, all together, and how many."""
        first, second = sorted([*(x for *_, x in found), 0.0, 0.0])[:-3:-1]
        return first**0.5, second**0.5, math.log1p(sum(x for *_, x in found)), math.log1p(len(found))

    def probability(self, features: tuple[float, ...]) -> float:
        a, *b = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + sum(x * y for x, y in zip(b, features))))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    """Learns from rows whose crc32 of the id as text mod 5 is not 0: at most SAMPLE_ROWS of them, by a hash of their id.

    The law of chance and the curve are fitted on scores that each half of the rows gets from the other half's
    weights, as a text's own rare words would else speak for its label. Without rows of both labels nothing is toxic."""
    ids = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    ids = ids.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE_ROWS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id")
    rows = materialize(rows.select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")))
    n = {(r.toxic, r.half): r["count"] for r in rows.groupBy("toxic", "half").count().collect()}
    if not all(n.get((y, h)) for y in (0, 1) for h in (0, 1)):
        return Toxicity(np.zeros(0, np.int64), np.zeros(0, np.float32), curve=(-3.0, 0.0, 0.0, 0.0, 0.0))
    models = _weights(rows, n)
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def chance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, int], int] = {}
        for pdf in batches:
            for t, half in zip(pdf["text"], pdf["half"]):
                m = shared.value[1 - half]
                s = m.token_scores(words_of(t))
                for kind, values in (("token", s), ("segment", np.array([x for *_, x in m.segments(s)]))):
                    for v, c in zip(*np.unique(np.round(values / STEP).astype(np.int64), return_counts=True)):
                        seen[kind, int(v)] = seen.get((kind, int(v)), 0) + int(c)
        yield pd.DataFrame([(*k, c) for k, c in seen.items()], columns=["kind", "step", "n"])

    counts = rows.filter("toxic = 0").mapInPandas(chance, "kind string, step long, n long").groupBy("kind", "step").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # one row per step
    lam, k = _law(*[(p["step"].to_numpy() * STEP, p["n"].to_numpy(float)) for p in (counts[counts["kind"] == x] for x in ("token", "segment"))])
    for m in models:
        m.lam, m.k = lam, k
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = [Toxicity.features(shared.value[1 - half].passages(t)[1]) for t, half in zip(pdf["text"], pdf["half"])]
            yield pd.DataFrame(f, columns=names).assign(toxic=pdf["toxic"].to_numpy())

    names = ["first", "second", "total", "often"]
    got = rows.mapInPandas(features, "first double, second double, total double, often double, toxic int").toArrow().to_pandas()  # at most SAMPLE_ROWS
    discard(rows)
    model = models[2]
    model.curve = tuple(float(v) for v in _logistic(np.c_[np.ones(len(got)), got[names]], got["toxic"].to_numpy(float)))
    return model


def _weights(rows: DataFrame, n: dict[tuple[int, int], int]) -> list[Toxicity]:
    """Models of the rows of half 0, of half 1, and of all rows."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[bytes, list[int]] = {}
            for t, y, half in zip(pdf["text"], pdf["toxic"], pdf["half"]):
                words = set(words_of(t))
                for w in words | {w[:PREFIX] + b"*" for w in words}:
                    seen.setdefault(w, [0, 0, 0, 0])[2 * half + y] += 1
            made = [(token_key(w), token_key(w[:PREFIX] + b"*") if not w.endswith(b"*") else None, *c) for w, c in seen.items()]
            out = pd.DataFrame(made, columns=["token", "prefix", *names])
            out["prefix"] = out["prefix"].astype("Int64")
            yield out

    names = ["clean0", "bad0", "clean1", "bad1"]
    counts = rows.mapInPandas(tokens, "token long, prefix long, clean0 long, bad0 long, clean1 long, bad1 long")
    counts = materialize(counts.groupBy("token", "prefix").agg(*[F.sum(c).alias(c) for c in names]).selectExpr("*", "clean0 + clean1 clean2", "bad0 + bad1 bad2"))
    size = {h: (n[0, h], n[1, h]) for h in (0, 1)}
    size[2] = (size[0][0] + size[1][0], size[0][1] + size[1][1])

    def odds(h: int, share, pseudo: float) -> Column:
        """Log-odds, drawn to none by DOUBT deviations; share: the prior's part that is toxic."""
        n0, n1 = size[h]
        prior = pseudo / (n0 + n1)
        bad, clean = F.col(f"bad{h}") + share * (2 * prior * n1), F.col(f"clean{h}") + (1 - share) * (2 * prior * n0)
        x = F.log(bad / n1) - F.log(clean / n0)
        return F.signum(x) * F.greatest(F.lit(0.0), F.abs(x) - DOUBT * F.sqrt(1 / bad + 1 / clean))

    half = F.lit(0.5)
    prefixes = counts.filter("prefix is null").select(F.col("token").alias("prefix"), *[odds(h, half, PREFIX_PSEUDO).alias(f"w{h}") for h in size])
    clipped = lambda h: F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.coalesce(F.col(f"w{h}"), F.lit(0.0))))
    words = counts.filter("prefix is not null").join(prefixes.hint("merge"), "prefix", "left")
    words = words.select("token", *[odds(h, 1 / (1 + F.exp(-clipped(h))), PSEUDO).cast("float").alias(f"w{h}") for h in size])
    table = words.unionByName(prefixes.select(F.col("prefix").alias("token"), *[F.col(f"w{h}").cast("float").alias(f"w{h}") for h in size]))
    table = materialize(table)
    got = table.toArrow()  # numbers alone, bounded by the tokens of SAMPLE_ROWS texts
    discard(counts, table)
    order = np.argsort(got["token"].to_numpy())
    keys = got["token"].to_numpy()[order]
    return [Toxicity(keys, got[f"w{h}"].to_numpy()[order]) for h in (0, 1, 2)]


def _law(token: tuple[np.ndarray, np.ndarray], segment: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """(lambda, K) from scores and how often clean texts have them: lambda is the positive root of the mean of exp(lambda * score) = 1."""
    score, often = np.r_[token[0], max(token[0].max(initial=0.0), 1.0)], np.r_[token[1], 1.0]  # one more than was seen
    lo, hi = 1e-3, 20.0
    for _ in range(60):
        lam = (lo + hi) / 2
        mean = (np.exp(np.minimum(lam * score, 700)) * often).sum() / often.sum()
        lo, hi = (lam, hi) if mean < 1 else (lo, lam)
    best, times = segment
    k = (np.exp(np.minimum(lo * best, 50)) * times).sum() / max(1.0, times.sum()) if len(best) else 1.0
    k *= (times.sum() + 1) / token[1].sum() if token[1].sum() else 1.0
    return lo, float(min(max(k, 1e-6), 1.0))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by Newton steps, each halved until the loss falls (labels may be separable)."""
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * v @ v)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def scorer(model: Toxicity, spark) -> "callable":
    """A column function: text -> struct(score, n_words, passages); null and empty texts have no passages."""
    shared = spark.sparkContext.broadcast(model)

    def score(texts: pd.Series) -> pd.DataFrame:
        m, out = shared.value, []
        for t in texts:
            n, found = m.passages(t)
            out.append((m.probability(m.features(found)), n, [{"start": a, "end": b, "evidence": x} for a, b, x in found]))
        return pd.DataFrame(out, columns=["score", "n_words", "passages"])

    return F.pandas_udf(score, "score double, n_words long, passages array<struct<start: long, end: long, evidence: double>>")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages) of whole texts. Scores come from the text alone.

    A null or empty text has the score of no toxic passage; without both labels to learn from every score is 0.5 at
    most. Repeated rows and null ids keep their rows (a null id is not held out)."""
    model = fit(docs, labels, id_col, text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), scorer(model, docs.sparkSession)(F.col(text_col)).alias("r"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("r.score").alias("score"), F.when(F.col("r.score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("r.passages").cast("long").alias("n_passages"))


def is_toxic(docs: DataFrame, model: Toxicity, text_col: str = "text", threshold: float = 0.5) -> Column:
    return scorer(model, docs.sparkSession)(F.col(text_col))["score"] >= threshold
