"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are cut into segments on a ring. If two differ in at most t bits, then from some
segment on every chain of l consecutive segments differs in at most l * t / m bits (m segments).
Rows meet where a whole segment is equal; the chains from there must keep within their proportional
budgets before the full Hamming check is made. Links stay inside tasks, which give back at most a
spanning forest, so groups of copies never expand to all pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.shared import (
    compare_buckets, connected_components, discard, forest, join_small, materialize, spread_hot,
)

BUCKET_ROWS = 1024
#: Near copies by similarity: rows in a bucket to aim at and to compare at once, and rows with their shingles to compare at once.
WIDE_BUCKET, WIDE_BUCKET_ROWS, VERIFY_ROWS = 8192, 8192, 512
#: Share of pairs just at the similarity that meet in no segment.
MISSED = 0.002
#: Lanes of 64 bits in a chain, and the standard deviations of its differing bits that it may be above the expected share.
CHAINS = ((1, 4.3), (4, 5.0))
SLACK = 4.5


def _words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits; bit k is set if over half the XXH64 (seed 42) of the word shingles have it; 0 without words."""
    words = _words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[: len(words) - shingle] + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, of whole texts; null and blank texts have 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, shingle) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, fp long")


def _mask(lo: int, width: int) -> int:
    return ((1 << width) - 1) << lo


def hamming_links(fps: DataFrame, max_distance: int = 2) -> DataFrame:
    """fps: distinct longs fp. (a, b): links that connect the same fingerprints as all pairs at max_distance or less."""
    m = max_distance + 1
    cuts = [64 * k // m for k in range(m + 1)]
    # bits at the high end are masked on the signed long, so no shift carries the sign
    vals = F.array(*[F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit(_mask(0, hi - lo) if hi - lo < 63 else -1)) for lo, hi in zip(cuts, cuts[1:])])
    rows = fps.select("fp", F.posexplode(vals).alias("seg", "val"))
    rows = spread_hot(rows, ["seg", "val"], "fp", BUCKET_ROWS)
    masks = np.array([_mask(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])], dtype=np.uint64)

    def prepare(pdf: pd.DataFrame) -> dict:
        return {"fp": pdf["fp"].to_numpy().view(np.uint64), "seg": pdf["seg"].to_numpy()}

    def linked(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        diff, seg = x["fp"][i] ^ x["fp"][j], x["seg"][i]
        ok, total = np.ones(len(i), bool), np.zeros(len(i), np.int64)
        for step in range(1, m):  # the chain from the equal segment on; its whole length is the full check
            total += np.bitwise_count(diff & masks[(seg + step) % m])
            ok &= total * m <= (step + 1) * max_distance
        return ok

    def emit(x: dict, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        member, root = forest(len(x["fp"]), i, j)
        fp = x["fp"].view(np.int64)
        return pd.DataFrame({"a": fp[member], "b": fp[root]})

    return compare_buckets(rows, ["seg", "val"], prepare, linked, emit, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id); fingerprints link at max_distance or fewer differing bits.

    component_id is the smallest doc_id reachable by links, itself included. Documents without words share
    fingerprint zero and link like any other; a repeated row keeps its own row; null ids are kept and never named."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle))
    each = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    comp = connected_components(hamming_links(each.select("fp"), max_distance))
    named = materialize(each.join(comp.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = materialize(named.groupBy("component").agg(F.min("low").alias("component_id")))
    of_fp = materialize(named.select("fp", "component").join(least.hint("merge"), "component").select("fp", "component_id"))
    discard(named, least, each)
    out = fps.join(of_fp.hint("merge"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_GOLDEN = 0x9E3779B97F4A7C15
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(text: str | None, shingle: int, lanes: int, known: dict[bytes, int]) -> tuple[bytes, int]:
    """64 * lanes bits by majority over the distinct word shingles, zero without words; and the digest of the set of shingles."""
    words = _words(text)
    if not words:
        return bytes(8 * lanes), _digest(np.zeros(0, np.uint64))
    if len(known) > 400_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w, 7)
    x = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(x) - shingle + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(shingle, len(x))):
            h = _mix(h * np.uint64(3) + x[k : k + n] + np.uint64(_GOLDEN))
        h = np.unique(h)
        digest = _digest(h)
        n, ones = len(h), np.zeros((8 * lanes, 8), np.int64)
        salt = np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(_GOLDEN)
        place = np.arange(8 * lanes, dtype=np.int64) * 256
        for at in range(0, n, 4096):
            byte = _mix(h[at : at + 4096, None] + salt).astype("<u8").view(np.uint8)
            ones += np.bincount((byte + place).ravel(), minlength=256 * 8 * lanes).reshape(-1, 256) @ _BITS
    return np.packbits(2 * ones > n, axis=1, bitorder="little").tobytes(), digest


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Distinct word shingles as 64-bit hashes, sorted; a shorter text is one shingle, a text without words has none."""
    words = [xxhash.xxh64_intdigest(w, 7) for w in _words(text)]
    x = np.array(words, np.uint64)
    n = max(1, len(x) - shingle + 1) if len(x) else 0
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(shingle, len(x))):
            h = _mix(h * np.uint64(3) + x[k : k + n] + np.uint64(_GOLDEN))
    return np.unique(h)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets as distinct values; 0 of two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def segmenting(rows: int, share: float) -> tuple[int, int, int]:
    """(bits, m, lanes): width and number of segments for so many rows, of which pairs differ in share of their bits.

    A segment is wide enough for WIDE_BUCKET rows a bucket, and there are enough for all but MISSED of the pairs to be equal in one."""
    bits = max(12, math.ceil(math.log2(max(rows, 1) / WIDE_BUCKET)))
    m = math.ceil(math.log(MISSED) / math.log(1 - (1 - share) ** bits))
    return bits, m, math.ceil(m * bits / 64)


def _within(bits: int, share: float, deviations: float) -> int:
    return int(bits * share + deviations * np.sqrt(bits * share * (1 - share)))


def candidate_links(each: DataFrame, bits: int, m: int, lanes: int, share: float) -> DataFrame:
    """each: (low, fp), ids and fingerprints. (a, b): a spanning forest, for every bucket, of the rows whose chains and whole fingerprints keep their budgets."""
    start = F.expr(f"seg * {bits}")
    rows = each.select("low", "fp", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("seg"))
    five = F.conv(F.hex(F.substring(F.concat("fp", "fp"), (start / 8).cast("int") + 1, F.lit(5))), 16, 10).cast("long")
    val = F.expr(f"shiftright(five, 40 - {bits} - seg * {bits} % 8)").bitwiseAND(F.lit((1 << bits) - 1))
    rows = rows.withColumn("five", five).select("low", "fp", (F.col("seg").cast("long") * (1 << bits) + val).alias("val"))
    rows = spread_hot(rows, ["val"], "low", WIDE_BUCKET_ROWS)
    chains = [(n, _within(64 * n, share, d)) for n, d in CHAINS if n < lanes]
    most = _within(64 * lanes, share, SLACK)

    def prepare(pdf: pd.DataFrame) -> dict:
        fp = np.frombuffer(b"".join(pdf["fp"]), dtype="<u8").reshape(len(pdf), lanes)
        first = ((pdf["val"].to_numpy() >> bits) * bits // 64 + 1) % lanes  # the lane behind the equal segment
        return {"fp": fp, "first": first, "start": fp[np.arange(len(fp)), first], "low": pdf["low"].to_numpy()}

    def linked(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if not chains:
            return distance(x["fp"], i, j) <= most
        left = np.flatnonzero(np.bitwise_count(x["start"][i] ^ x["start"][j]) <= chains[0][1])
        for n, budget in chains[1:]:
            lane = (x["first"][i[left], None] + np.arange(n)) % lanes
            diff = x["fp"][i[left, None], lane] ^ x["fp"][j[left, None], lane]
            left = left[np.bitwise_count(diff).sum(axis=1, dtype=np.int64) <= budget]
        ok = np.zeros(len(i), bool)
        ok[left] = distance(x["fp"], i[left], j[left]) <= most
        return ok

    def emit(x: dict, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        member, root = forest(len(x["low"]), i, j)
        return pd.DataFrame({"a": x["low"][member], "b": x["low"][root]})

    return compare_buckets(rows, ["val"], prepare, linked, emit, "a long, b long").filter("a <> b").distinct()


def distance(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64)


def verified_links(members: DataFrame, texts: DataFrame, lanes: int, share: float, shingle: int, similarity: float) -> DataFrame:
    """members: (low, fp, same, cluster). (a, b): links that connect the same rows as all pairs of a cluster with that Jaccard similarity.

    A row's shingles are sent to its cluster, once for each part of a large one. Pairs go from the nearest
    fingerprints on; those whose rows are connected already need no check, and what a task gives back is a forest."""
    ids = members.select("low", "same")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [shingles(t, shingle) for t in pdf["text"]]
            yield pd.DataFrame({"low": pdf["doc_id"], "same": [_digest(h) for h in made], "set": [h.astype("<u8").tobytes() for h in made]})

    some = join_small(texts, ids.select("low").distinct(), F.col("doc_id") == F.col("low"), "left_semi")
    found = some.mapInPandas(sets, "low long, same long, set binary").dropDuplicates(["low", "same"])
    rows = spread_hot(members, ["cluster"], "low", VERIFY_ROWS).join(found.hint("merge"), ["low", "same"])
    most = _within(64 * lanes, share, SLACK)

    def prepare(pdf: pd.DataFrame) -> dict:
        made = [np.frombuffer(x, "<u8") for x in pdf["set"]]
        return {"fp": np.frombuffer(b"".join(pdf["fp"]), dtype="<u8").reshape(len(pdf), lanes), "set": made, "n": np.array([len(x) for x in made]), "low": pdf["low"].to_numpy()}

    def linked(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, k = x["n"][i], x["n"][j]
        ok = np.minimum(n, k) >= similarity * np.maximum(n, k)  # no set of another size can be as similar
        left = np.flatnonzero(ok)
        ok[left] = distance(x["fp"], i[left], j[left]) <= most
        return ok

    def emit(x: dict, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        order = np.argsort(distance(x["fp"], i, j), kind="stable")
        i, j, label = i[order], j[order], np.arange(len(x["low"]))
        a, b = [], []
        while len(i):
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            # the nearest pair of every group, and the nearest pairs besides
            now = np.union1d(np.unique(label[i], return_index=True)[1], np.arange(min(len(i), 64)))
            ok = np.array([jaccard(x["set"][p], x["set"][q]) >= similarity for p, q in zip(i[now], j[now])], bool)
            a.append(i[now][ok])
            b.append(j[now][ok])
            member, root = forest(len(label), np.r_[np.arange(len(label)), a[-1]], np.r_[label, b[-1]])
            label[member] = root
            i, j = np.delete(i, now), np.delete(j, now)
        member, root = forest(len(label), np.concatenate(a), np.concatenate(b))
        return pd.DataFrame({"a": x["low"][member], "b": x["low"][root]})

    return compare_buckets(rows, ["cluster"], prepare, linked, emit, "a long, b long")


def _digest(h: np.ndarray) -> int:
    """One long for a set of shingles."""
    return xxhash.xxh64_intdigest(h.astype("<u8").tobytes(), 3) - (1 << 63)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of the documents whose word shingles are similar to another's; ids are whole numbers.

    Sets of Jaccard similarity s have a cosine of 2s / (1 + s) or more, whose angle is the most that is expected as
    share of differing bits. Two rows meet where a segment is equal (all but MISSED of the pairs at s do); the
    chains of lanes from there on, and at last all bits, must keep within that share and a few standard deviations. The
    connected rows are clusters of candidates, in which links are decided by exact Jaccard. Documents of equal shingles (those
    without words too) are one group by that alone. Rows of one id are one document; those of null id, and documents
    alone in their group, get no row. Long texts are hashed whole; an empty table gives no rows."""
    _whole_ids(docs, id_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    bits, m, lanes = segmenting(texts.count(), share)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for pdf in batches:
            made = [wide_fingerprint(t, shingle, lanes, known) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": [f for f, _ in made], "same": [s for _, s in made]})

    fps = materialize(texts.mapInPandas(run, "doc_id long, fp binary, same long"))
    each = materialize(fps.groupBy("same", "fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    near = materialize(connected_components(candidate_links(each.select("low", "fp"), bits, m, lanes, share)).toDF("low", "cluster"))
    members = materialize(each.select("low", "fp", "same").join(near.hint("merge"), "low"))
    links = verified_links(members, texts, lanes, share, shingle, similarity)
    comp = materialize(connected_components(links))
    named = each.join(comp.hint("merge"), F.col("low") == F.col("node"), "left")
    named = materialize(named.filter("node is not null or n > 1").select("same", "fp", F.coalesce("component", "low").alias("component_id")))
    out = materialize(fps.join(named.hint("merge"), ["same", "fp"]).select("doc_id", "component_id"))
    discard(fps, each, near, members, comp, named)
    return out


def _whole_ids(docs: DataFrame, id_col: str) -> None:
    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids must be whole numbers, but {id_col} is {kind}")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near copies: the one of the smallest id. Rows of null id stay; columns are unchanged."""
    drop = materialize(similar_groups(docs, id_col, text_col, shingle, similarity).filter("doc_id <> component_id")
                       .select(F.col("doc_id").alias("__near_copy")).distinct())
    return join_small(docs, drop, docs[id_col] == drop["__near_copy"], "left_anti")
