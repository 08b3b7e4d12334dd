"""Benchmark decontamination by an FM-index per training shard.

A shard's words are coded by the benchmark's vocabulary; all other words part it into runs, and runs too
short to hold any test phrase are left out. The runs' suffix order gives the Burrows-Wheeler transform, whose
wavelet matrix answers ranks; all phrases are searched backward at once, their occurrences are located
by sampled suffix positions, and the covered words of each document are merged into removal spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.shared import WORD_BYTES, discard, materialize, words_of

#: Characters of benchmark text that one pass over the documents searches for; larger benchmarks take more passes.
BLOCK_CHARS = 4_000_000
#: Every so many positions of a run are sampled, and each run's first.
SAMPLE = 16


class FmIndex:
    """Index of runs of codes 1..sigma; runs are parted by 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        """text: codes, each run followed by one 0."""
        n = len(text)
        gap = text == 0
        rank = text.astype(np.int64)
        rank[gap] = sigma + 1 + np.arange(int(gap.sum()))  # each its own symbol: no match crosses a gap
        k, top = 1, 0
        while True:
            after = np.full(n, -1, np.int64)
            after[:-k or None] = rank[k:] if k < n else -1
            key = rank * (int(rank.max()) + 2) + after + 1
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.r_[0, np.cumsum(key[1:] != key[:-1])] if n else 0
            if n == 0 or (top := int(rank[order[-1]])) == n - 1 or k >= n:
                break
            k *= 2
        self.n, self.sa = n, order
        before = np.where(order > 0, text[order - 1], 0) if n else text
        self.c = np.r_[0, np.cumsum(np.bincount(text[~gap], minlength=sigma + 1))]  # c[x]: codes below x come first
        self.bwt, self.bits = before.astype(np.int64), max(1, int(sigma).bit_length())
        self.ones, self.zeros, x = [], [], self.bwt
        for level in reversed(range(self.bits)):
            bit = (x >> level & 1).astype(bool)
            self.ones.append(np.r_[0, np.cumsum(bit)])
            self.zeros.append(n - int(bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])
        start = np.r_[True, gap[:-1]] if n else gap
        sampled = start | (np.arange(n) % SAMPLE == 0)
        self.sampled = sampled[order]
        self.place = np.cumsum(self.sampled) - 1
        self.position = order[self.sampled]
        del self.sa  # only the samples stay

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i symbols of the transform are code, for each pair, by the wavelet matrix."""
        start = np.zeros(len(i), np.int64)
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros):
            one = (code >> level & 1).astype(bool)
            si, ii = ones[start], ones[i]
            start, i = np.where(one, zeros + si, start - si), np.where(one, zeros + ii, i - ii)
        return i - start

    def search(self, phrases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (lo, hi) of each phrase; phrases: codes, padded by 0 on the right to one width."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(1, phrases.shape[1] + 1):
            on = np.flatnonzero((size >= step) & (lo < hi))
            code = phrases[on, size[on] - step]
            lo[on], hi[on] = self.c[code] + self.rank(code, lo[on]), self.c[code] + self.rank(code, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The text positions of rows, by steps to the next sample before them."""
        out, at, steps = np.zeros(len(row), np.int64), np.arange(len(row)), 0
        while len(at):
            hit = self.sampled[row]
            out[at[hit]] = self.position[self.place[row[hit]]] + steps
            at, row = at[~hit], row[~hit]
            code = self.bwt[row]
            row = self.c[code] + self.rank(code, row)
            steps += 1
        return out


class Phrases:
    """The windows of some benchmark items, coded by their own vocabulary."""

    def __init__(self, items: list[tuple[str, str]], words: int):
        self.vocab: dict[bytes, int] = {}
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        codes, of, sizes = [], [], []
        for item, text in items:
            c = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], np.int32)
            if len(c):
                made = np.zeros((max(1, len(c) - words + 1), words), np.int32)
                size = min(len(c), words)
                made[:, :size] = np.lib.stride_tricks.sliding_window_view(c, size)
                codes.append(made)
                of.append(np.full(len(made), number[item]))
                sizes.append(np.full(len(made), size))
        codes = np.concatenate(codes) if codes else np.zeros((0, words), np.int32)
        of, sizes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (of, sizes))
        # one row of packed codes for each window, and the items that have it behind one another
        self.codes, first, same = np.unique(codes, axis=0, return_index=True, return_inverse=True)
        self.size = sizes[first].astype(np.int64)
        self.least = int(self.size.min()) if len(self.size) else 1
        self.owner, self.owned = np.unique(np.c_[same.ravel(), of], axis=0).T.astype(np.int64)

    def items_of(self, windows: np.ndarray) -> list[str]:
        lo, hi = np.searchsorted(self.owner, windows), np.searchsorted(self.owner, windows, side="right")
        return [self.items[k] for k in sorted({k for a, b in zip(lo, hi) for k in self.owned[a:b].tolist()})]

    def find(self, docs: list[np.ndarray]) -> list[tuple[list[list[int]], list[str]]]:
        """Of each document (codes of its words): merged spans of hit words (start, end), and the items."""
        out: list[tuple[list[list[int]], list[str]]] = [([], [])] * len(docs)
        if not docs or not len(self.size):
            return out
        all_codes = np.concatenate([x for d in docs for x in (d, [0])]).astype(np.int64)
        first = np.r_[0, np.cumsum([len(d) + 1 for d in docs])]
        edge = np.flatnonzero(np.diff(np.r_[0, all_codes > 0, 0]))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= self.least
        begin, end = begin[long], end[long]
        if not len(begin):
            return out
        size = end - begin + 1
        origin = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        text = all_codes[origin]
        text[np.cumsum(size) - 1] = 0
        index = FmIndex(text, len(self.vocab))
        lo, hi = index.search(self.codes, self.size)
        count = hi - lo
        if not count.sum():
            return out
        which = np.repeat(np.arange(len(lo)), count)
        row = np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count) + np.repeat(lo, count)
        at = origin[index.locate(row)]
        doc = np.searchsorted(first, at, side="right") - 1
        order = np.lexsort((at, doc))
        at, doc, which = at[order], doc[order], which[order]
        cut = np.r_[0, np.flatnonzero(np.diff(doc)) + 1, len(doc)]
        for a, b in zip(cut[:-1], cut[1:]):
            spans: list[list[int]] = []
            for s, e in zip((at[a:b] - first[doc[a]]).tolist(), (at[a:b] - first[doc[a]] + self.size[which[a:b]]).tolist()):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(e, spans[-1][1])
                else:
                    spans.append([s, e])
            out[doc[a]] = spans, self.items_of(np.unique(which[a:b]))
        return out

    def codes_of(self, text: str | None) -> np.ndarray:
        words, get = words_of(text), self.vocab.get
        return np.array([get(w, 0) for w in words], np.int64)

    def cut(self, text: str) -> str:
        """cut_spans again until nothing is found, as a cut joins words."""
        while spans := self.find([self.codes_of(text)])[0][0]:
            text = cut_spans(text, spans)
        return text


def cut_spans(text: str, spans: list[list[int]]) -> str:
    """text without the words of spans and what stands between them."""
    raw = text.encode()
    kept = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[0, kept.astype(np.int8), 0]))
    parts, at = [], 0
    for s, e in spans:
        parts.append(raw[at : edge[2 * s]])
        at = int(edge[2 * e - 1])
    return b"".join([*parts, raw[at:]]).decode()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """How many blocks of about BLOCK_CHARS characters hold the items with words, and the blocks, each read when it is asked for."""
    b = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("item is not null and text is not null").distinct()
    n = 1 + (b.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS
    return n, ([tuple(r) for r in b.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k).collect()] for k in range(n))


def find_leaks(docs: DataFrame, benchmark: DataFrame, words: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items): the merged spans of words that benchmark windows hit, and the items found.

    A window is words consecutive words of an item, or a shorter item as a whole; items and documents that are null
    or have no words have none. Items of one text are all found; repeated rows are searched again. Documents
    are not shuffled: each batch of a partition is a shard. A benchmark of more than one block is searched block by
    block, and what each finds is written out before the next is read."""
    kind = docs.schema[id_col].dataType.simpleString()
    return _found(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, words, item_col, item_text_col, f"doc_id {kind}, text string").drop("text")


def _found(out: DataFrame, benchmark: DataFrame, words: int, item_col: str, item_text_col: str, schema: str, keep_text: bool = False) -> DataFrame:
    n, blocks = _blocks(benchmark, item_col, item_text_col)
    for k, items in enumerate(blocks):
        phrases = out.sparkSession.sparkContext.broadcast(items)
        before, last = (out if k else None), k == n - 1 and not keep_text

        def run(batches: Iterator[pa.RecordBatch], k=k, last=last, phrases=phrases) -> Iterator[pa.RecordBatch]:
            p = Phrases(phrases.value, words)
            for b in batches:
                codes = [p.codes_of(t.as_py()) for t in b.column(1)]
                found = p.find(codes)
                if k:
                    found = [_merged(f, s, i) for f, s, i in zip(found, b.column(3).to_pylist(), b.column(4).to_pylist())]
                cols = [b.column(0), pa.nulls(b.num_rows, pa.string()) if last else b.column(1), pa.array([len(c) for c in codes], pa.int64()),
                        pa.array([f[0] for f in found], pa.list_(pa.list_(pa.int64()))), pa.array([f[1] for f in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "n_words", "spans", "items"])

        out = out.mapInArrow(run, f"{schema}, n_words long, spans array<array<long>>, items array<string>")
        if k < n - 1:
            out = materialize(out)
            phrases.unpersist()
            if before is not None:
                discard(before)
    return out


def _merged(found: tuple, spans: list, items: list) -> tuple[list[list[int]], list[str]]:
    out: list[list[int]] = []
    for s, e in sorted([*found[0], *spans]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return out, sorted({*found[1], *items})


def remove_leaks(docs: DataFrame, benchmark: DataFrame, words: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with every hit span cut out of its text; all rows and columns stay, and clean texts are unchanged.

    All hit words of a text go at once, and what is left is searched again, until no window of the whole benchmark is found: a
    cut may join words to a new one. A benchmark of several blocks gives the same texts as one block: each round
    searches all blocks before it cuts, and further rounds take only the texts that were cut."""
    n, blocks = _blocks(benchmark, item_col, item_text_col)
    if n == 1:
        phrases = docs.sparkSession.sparkContext.broadcast(next(blocks))
        return docs.withColumn(text_col, _cutter(phrases, words)(F.col(text_col)))
    cutter = F.pandas_udf(_cut_all, "string")
    clean, rest = [], docs
    while True:
        packed = rest.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), F.col(text_col).alias("text"))
        schema = packed.schema["doc_id"].dataType.simpleString()
        found = materialize(_found(packed, benchmark, words, item_col, item_text_col, f"doc_id {schema}, text string", keep_text=True))
        clean.append(found.filter("size(spans) = 0").select("doc_id.*"))
        hit = found.filter("size(spans) > 0")
        if hit.isEmpty():
            break
        rest = materialize(hit.select(*[cutter("text", "spans").alias(c) if c == text_col else F.col("doc_id").getField(c).alias(c) for c in docs.columns]))
    out = clean[0]
    for part in clean[1:]:
        out = out.union(part)
    return out


def _cut_all(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([cut_spans(t, [list(x) for x in s]) for t, s in zip(texts, spans)], dtype=object)


def _cutter(phrases, words: int):
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = Phrases(phrases.value, words)
        for texts in batches:
            found = p.find([p.codes_of(t) for t in texts])
            yield pd.Series([p.cut(t) if f[0] else t for t, f in zip(texts, found)], dtype=object)

    return F.pandas_udf(clean, "string")
