"""Embedding near-duplicates by randomised-rotation binary codes.

Every unit vector is rotated at random and kept as its signs plus one correction factor f, the
cosine between vector and signs. For a pair, <signs(o), q> / f is an unbiased estimate of their inner
product whose error is within e * sqrt((1 - f^2) / f^2 / (D - 1)) but with small probability; of q a byte for each
component is kept. Pairs whose upper bound stays under the threshold are left; only rows of the other pairs fetch their
vectors, and these pairs are recomputed exactly. Groups of code bits are the index: two vectors are compared
where they agree on one group of bits of one rotation. Equal vectors are one class with a count, compared once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.shared import compare_buckets, connected_components, forest, materialize, spread_hot

#: Rows in a bucket to aim at; larger ones are cut into blocks of BLOCK rows.
BUCKET, BLOCK = 256, 512
#: Share of pairs just at the threshold that must meet in some bucket.
RECALL = 0.999
#: Width of the confidence interval, in standard deviations of the estimate.
EPSILON = 3.0


def rotation(dim: int, n: int, seed: int = 1) -> np.ndarray:
    """n random orthogonal dim x dim matrices, the same everywhere."""
    g = np.random.default_rng(seed * 1_000_003 + dim).standard_normal((n, dim, dim))
    return np.stack([np.linalg.qr(x)[0] for x in g])


def _classes(good: DataFrame) -> DataFrame:
    """good: (vec_id, v, label, h, g), the last two hashes of label and vector. One row for each vector and label: cid, its smallest id low, how many ids n."""
    ids = good.select("h", "g", "vec_id").distinct().groupBy("h", "g").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    one = good.withColumnRenamed("vec_id", "low").join(materialize(ids).hint("merge"), ["h", "g", "low"]).dropDuplicates(["h", "g"])
    return materialize(one.withColumn("cid", F.monotonically_increasing_id()))


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept); links have equal labels and a cosine of threshold or more.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows of null label or id link
    with nothing (n_links 0, component_id their own id); vectors of other dimensions don't link either. Ties need
    no order. A repeated row keeps its row, but is one vector: it neither links with itself nor counts twice; rows of one id with
    different vectors are different vectors. The estimates only dismiss pairs; every link is decided by the cosine in
    double precision. Ids are whole numbers; columns of other names are passed over; an empty table gives no rows."""
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    fit = F.expr("coalesce(vec_id is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0), false)")
    good = base.filter(fit).withColumns({"h": F.xxhash64("label", "v"), "g": F.hash("v", "label")})
    reps = _classes(good)
    largest = reps.groupBy("label", F.size("v").alias("dim")).count().agg(F.max("count")).first()[0] or 0
    k = max(0, math.ceil(math.log2(max(largest, 1) / BUCKET)))
    agree = (1 - math.acos(threshold) / math.pi) ** k
    tables = 1 if k == 0 else math.ceil(math.log(1 - RECALL) / math.log(1 - agree))
    keys = ["lab", "dim", "tab", "bucket"]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                if dim not in made:
                    turns = max(1, math.ceil(k * tables / dim))
                    rest = np.arange(turns * dim)
                    made[dim] = rotation(dim, turns), np.stack([rest[(t * k + np.arange(k)) % len(rest)] for t in range(tables)])
                turns, bits = made[dim]
                turned = np.concatenate([unit(part["v"]) @ r for r in turns], axis=1)
                own = turned[:, :dim]
                step = np.abs(own).max(axis=1) / 127
                group = ((turned > 0)[:, bits] * (1 << np.arange(k, dtype=np.int64))).sum(axis=2) if k else np.zeros((len(part), 1), np.int64)
                out = {"cid": part["cid"].to_numpy(), "lab": part["lab"].to_numpy(), "dim": dim, "factor": np.abs(own).sum(axis=1) / math.sqrt(dim), "step": step,
                       "signs": [x.tobytes() for x in np.packbits(own > 0, axis=1)], "query": [x.tobytes() for x in np.rint(own / step[:, None]).astype(np.int8)], "groups": [r.tobytes() for r in group]}
                for t in range(tables):
                    yield pd.DataFrame(out | {"tab": t, "bucket": group[:, t]})

    rows = reps.select("cid", F.xxhash64("label").alias("lab"), "v").mapInPandas(
        encode, "cid long, lab long, dim int, factor double, step double, signs binary, query binary, groups binary, tab int, bucket long")

    def codes(pdf: pd.DataFrame) -> dict:
        out = {c: pdf[c].to_numpy() for c in ("cid", "factor", *keys)} | {"groups": np.frombuffer(b"".join(pdf["groups"]), np.int64).reshape(len(pdf), -1), "of": {}}
        for dim in np.unique(out["dim"]):
            at = np.flatnonzero(out["dim"] == dim)
            signs = np.unpackbits(np.frombuffer(b"".join(pdf["signs"].iloc[at]), np.uint8).reshape(len(at), -1), axis=1, count=int(dim)).astype(np.float32) * 2 - 1
            query = np.frombuffer(b"".join(pdf["query"].iloc[at]), np.int8).reshape(len(at), dim) * pdf["step"].to_numpy(np.float32)[at, None]
            place = np.zeros(len(pdf), np.int64)
            place[at] = np.arange(len(at))
            out["of"][int(dim)] = place, signs / np.float32(math.sqrt(dim)), query
        return out

    def undecided(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(i), bool)
        fresh = np.flatnonzero(first_meeting(x, i, j))
        for dim, (place, signs, query) in x["of"].items():
            at = fresh[x["dim"][i[fresh]] == dim]
            for cut in range(0, len(at), 100_000):
                now = at[cut : cut + 100_000]
                f = x["factor"][i[now]]
                estimate = np.einsum("nd,nd->n", signs[place[i[now]]], query[place[j[now]]]) / f
                ok[now] = estimate + EPSILON * np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / max(dim - 1, 1)) >= threshold
        return ok

    def wanted(x: dict, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        some = np.union1d(i, j)
        return pd.DataFrame({c: x[c][some] for c in (*keys, "cid")} | {"groups": [g.tobytes() for g in x["groups"][some]]})

    parts = spread_hot(rows, keys, "cid", BLOCK)
    asked = materialize(compare_buckets(parts, keys, codes, undecided, wanted, "lab long, dim int, tab int, bucket long, cid long, groups binary").distinct())
    exact = spread_hot(asked, keys, "cid", BLOCK).join(reps.select("cid", "n", "v").hint("merge"), "cid")

    def units(pdf: pd.DataFrame) -> dict:
        out = {c: pdf[c].to_numpy() for c in ("cid", "n", "tab", "dim")} | {"groups": np.frombuffer(b"".join(pdf["groups"]), np.int64).reshape(len(pdf), -1), "of": {}}
        for dim in np.unique(out["dim"]):
            at = np.flatnonzero(out["dim"] == dim)
            place = np.zeros(len(pdf), np.int64)
            place[at] = np.arange(len(at))
            out["of"][int(dim)] = place, unit(pdf["v"].iloc[at])
        return out

    def linked(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(i), bool)
        fresh = np.flatnonzero(first_meeting(x, i, j))
        for dim, (place, v) in x["of"].items():
            at = fresh[x["dim"][i[fresh]] == dim]
            for cut in range(0, len(at), 100_000):
                now = at[cut : cut + 100_000]
                ok[now] = np.einsum("nd,nd->n", v[place[i[now]]], v[place[j[now]]]) >= threshold
        return ok

    def emit(x: dict, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        size = len(x["cid"])
        links = np.bincount(np.r_[i, j], np.r_[x["n"][j], x["n"][i]], size).astype(np.int64)
        member, root = forest(size, i, j)
        low = np.arange(size)
        low[member] = root
        some = np.flatnonzero(links)
        return pd.DataFrame({"cid": x["cid"][some], "other": x["cid"][low[some]], "links": links[some]})

    found = materialize(compare_buckets(exact, keys, units, linked, emit, "cid long, other long, links long"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = materialize(connected_components(found.selectExpr("cid a", "other b")))
    narrow = reps.select("cid", "h", "g", "low", "n")
    named = narrow.join(comp.withColumnRenamed("node", "cid").hint("merge"), "cid", "left").join(links.hint("merge"), "cid", "left")
    named = materialize(named.select("h", "g", "low", F.coalesce("component", "cid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links")))
    least = materialize(named.groupBy("component").agg(F.min("low").alias("component_id")))
    named = materialize(named.join(least.hint("merge"), "component").select("h", "g", "n_links", "component_id"))
    own = good.select("vec_id", "h", "g").join(named.hint("merge"), ["h", "g"]).select("vec_id", "n_links", "component_id")
    rest = base.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length one; each is divided by its largest component first, so that no square runs over or under."""
    x = np.stack(vectors.to_numpy())
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def first_meeting(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The pairs that share no bucket in an earlier table: a pair counts once."""
    earlier = (x["groups"][i] == x["groups"][j]) & (np.arange(x["groups"].shape[1]) < x["tab"][i][:, None])
    return ~earlier.any(axis=1)
