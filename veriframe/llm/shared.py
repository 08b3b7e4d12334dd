"""What the training-data operators share: the shared folder, size-checked joins,
connected components and the comparison of rows that meet in a bucket."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.tables import Scratch, discard, materialize, new_path, shared_dir  # noqa: F401  the operators here take them from this module

#: A side with at most so many narrow rows (an id or two, under 64 MB) is broadcast.
BROADCAST_ROWS = 2_000_000


def join_small(left: DataFrame, right: DataFrame, on, how: str, rows: int | None = None) -> DataFrame:
    """left join right (a written table of narrow rows): broadcast only when right's counted rows stay under BROADCAST_ROWS."""
    n = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if n <= BROADCAST_ROWS else right.hint("merge"), on, how)


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns a, b of links -> one row (node, component) per linked node, component being its smallest reachable node.

    Large-star and small-star steps alternate until nothing changes. Minima are combined before the shuffle and written
    out, so that the join of a node with many links reads plain tables and may be split between tasks; tables of
    earlier steps are deleted."""
    e = materialize(edges.filter("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
    seen = None
    while True:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m"))
        large = materialize(both.join(low.hint("merge"), "u").filter("v > u").selectExpr("v a", "m b").distinct())
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least.hint("merge"), "a").filter("b <> m").selectExpr("b a", "m b")
        before, e = e, materialize(small.union(least).distinct())
        discard(before, low, large, least)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.selectExpr("a node", "b component").union(e.selectExpr("b", "b").distinct())
        seen = now


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 links (member, root) that connect the same nodes as the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if (new == label).all():
            member = np.flatnonzero(label != np.arange(n))
            return member, label[member]
        label = new


def spread_hot(rows: DataFrame, keys: list[str], id_col: str, limit: int) -> DataFrame:
    """Adds part and block, so that rows of one (keys, part) are at most about 2 * limit.

    A bucket of over limit rows is cut into blocks by a hash of id_col, and each pair of blocks
    is a part: two rows of a bucket meet in exactly one part (diagonal parts: the same block)."""
    hot = materialize(rows.groupBy(*keys).count().filter(F.col("count") > limit)
                      .withColumn("blocks", F.ceil(F.col("count") / limit).cast("int")).drop("count"))
    n_hot = hot.count()
    none = F.lit(0)
    if not n_hot:
        return rows.withColumns({"part": none.cast("long"), "block": none})
    j = join_small(rows, hot, keys, "left", n_hot).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    j = j.withColumn("block", F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int"))
    j = j.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.least("block", "other").cast("long") * F.col("blocks") + F.greatest("block", "other")
    return j.withColumn("part", part).drop("blocks", "other")


def compare_buckets(
    rows: DataFrame, keys: list[str], prepare: Callable[[pd.DataFrame], dict],
    linked: Callable[[dict, np.ndarray, np.ndarray], np.ndarray],
    emit: Callable[[dict, np.ndarray, np.ndarray], pd.DataFrame], schema: str, pairs_at_once: int = 1_000_000,
) -> DataFrame:
    """Compares all rows of each bucket (keys, part) inside tasks; only what emit makes of the links leaves a task.

    prepare(pdf) makes arrays of some whole buckets, linked(arrays, i, j) says which pairs of row
    numbers link, emit(arrays, i, j) turns links into rows. Buckets are bounded by spread_hot, batches are cut between buckets."""
    on = [*keys, "part"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None or not len(held) else pd.concat([held, pdf], ignore_index=True)
            k = pdf[on]
            new = (k.values[1:] != k.values[:-1]).any(axis=1)
            cut = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            held = pdf.iloc[cut:].reset_index(drop=True)
            if cut:
                yield from whole(pdf.iloc[:cut].reset_index(drop=True))
        if held is not None and len(held):
            yield from whole(held)

    def whole(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        k, arrays = pdf[on].values, prepare(pdf)
        first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
        size = np.diff(np.r_[first, len(pdf)])
        end = np.repeat(first + size, size)
        block = pdf["block"].to_numpy()
        crossed = np.repeat(np.maximum.reduceat(block, first) != np.minimum.reduceat(block, first), size)
        i_all, j_all, found = [], [], 0
        idx = np.flatnonzero(np.arange(len(pdf)) + 1 < end)
        d = 1
        while len(idx):
            for at in range(0, len(idx), pairs_at_once):
                i = idx[at : at + pairs_at_once]
                j = i + d
                ok = ~crossed[i] | (block[i] != block[j])
                i, j = i[ok], j[ok]
                hit = linked(arrays, i, j)
                i_all.append(i[hit])
                j_all.append(j[hit])
                found += int(hit.sum())
            if found > 4 * pairs_at_once:
                yield emit(arrays, np.concatenate(i_all), np.concatenate(j_all))
                i_all, j_all, found = [], [], 0
            d += 1
            idx = idx[idx + d < end[idx]]
        if found:
            yield emit(arrays, np.concatenate(i_all), np.concatenate(j_all))

    return rows.repartition(*on).sortWithinPartitions(*on).mapInPandas(run, schema)


#: Bytes of words: A-Z in lower case, digits, a-z and all of UTF-8 beyond ASCII; everything else parts words.
WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case; none of null."""
    return text.encode().translate(WORD_BYTES).split() if text else []


def sha256_of_chunks(chunks: DataFrame, keys: list[str], order: str, chunk: str, separator: str = "") -> DataFrame:
    """keys (none of them null), sha256: the digest of each key's chunks in order, with the separator between two. A task goes along the bytes of a key and keeps none of them."""
    schema = ", ".join(f"{k} {t}" for k, t in chunks.select(*keys).dtypes)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, h = None, None
        for pdf in batches:
            done = []
            for *k, text in zip(*[pdf[c] for c in keys], pdf[chunk]):
                if k != key:
                    if key is not None:
                        done.append((*key, h.hexdigest()))
                    key, h = k, hashlib.sha256()
                else:
                    h.update(separator.encode())
                h.update(text.encode())
            yield pd.DataFrame(done, columns=[*keys, "sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, h.hexdigest())], columns=[*keys, "sha256"])

    return chunks.select(*keys, order, chunk).repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(digest, f"{schema}, sha256 string")


#: Unsigned CRC-32 in DuckDB's SQL of a text {s} of digits and signs.
CRC_SQL = "xor(list_reduce([4294967295::bigint] || list_transform(string_split({s}, ''), lambda x: ord(x)::bigint), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint)"
