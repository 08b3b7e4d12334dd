"""Packing by lexical retrieval: a sharded BM25 inverted index fills each window with its seed's neighbours.

Partitions are cut into shards. Windows that a document fills alone are emitted at once; what is left
of each document enters its shard's index. A seed's rarest terms are looked up in the index, then its others while
the window has room, and the best unused neighbours fill its window greedily; only where no text shares a term with
the seed does the next unused text follow. The last one is cut where the window is full, and its rest is
the next seed. What does not fill a window moves on to the partition's next shard, and at the end it
is cut into powers of two, which need no padding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.tokens import Ids

K1, B = 1.2, 0.75


class Bm25:
    """Inverted index of a shard: postings by term, with their BM25 weights."""

    def __init__(self, texts: list[np.ndarray]):
        self.n = len(texts)
        size = np.array([len(t) for t in texts])
        key = np.concatenate(texts).astype(np.int64) + (np.repeat(np.arange(self.n), size) << 16)
        key, tf = np.unique(key, return_counts=True)
        doc, term = key >> 16, key & 0xFFFF
        df = np.bincount(term, minlength=65536)
        self.idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        self.idf[df < 2] = 0  # a term of one text has no neighbours
        self.start = np.r_[0, np.cumsum(df)]
        self.first = np.searchsorted(doc, np.arange(self.n + 1))
        self.terms = term
        order = np.argsort(term, kind="stable")
        weight = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / size.mean()))
        self.doc, self.weight = doc[order].astype(np.int32), weight[order]

    def search(self, seed: int, used: np.ndarray, query_terms: int, most: int) -> Iterator[int]:
        """All unused texts with a positive score, most at a time by falling score; ties by their order.

        The seed asks with its query_terms rarest terms. When no text of a positive score is left, it asks on with twice
        as many of its next terms, which add to the scores, until it has asked with all."""
        t = self.terms[self.first[seed] : self.first[seed + 1]]
        t = t[self.idf[t] > 0]
        t = t[np.argsort(-self.idf[t], kind="stable")]
        score, at = np.zeros(self.n), 0
        while at < len(t):
            spans = [slice(self.start[x], self.start[x + 1]) for x in t[at : at + query_terms]]
            score += np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
            at += query_terms
            query_terms *= 2
            while True:
                free = (score > 0) & ~used
                free[seed] = False
                top = np.flatnonzero(free)
                if not len(top):
                    break
                if len(top) > most:
                    top = top[np.argpartition(-score[top], most)[:most]]
                top = top[np.lexsort((top, -score[top]))]
                yield from top.tolist()
                score[top] = -np.inf  # given once; further terms do not bring them back

    def neighbours(self, seed: int, used: np.ndarray, query_terms: int, most: int) -> list[int]:
        """The first of search, at most most of them."""
        return list(islice(self.search(seed, used, query_terms, most), most))


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, shard_docs: int = 2048, query_terms: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its ids and end_id, so null and empty texts are one token; repeated rows are packed again.
    Every id lies in exactly one piece. A sequence has window ids, or a smaller power of two at the end of a
    partition. Nothing is shuffled: a lost task packs the same rows of its partition again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(path)
        sequence = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        pool: list[list] = []  # [doc_id, doc_tokens, start, ids not placed yet]

        def place(piece: list, length: int, offset: int) -> None:
            take = piece[3][:length]
            out.append((piece[0], piece[2], length, zlib.crc32(take.astype("<u4").tobytes()), piece[1], sequence, offset))
            piece[2] += length
            piece[3] = piece[3][length:]

        def fill() -> None:
            """Makes windows of the pool while it holds one."""
            nonlocal sequence, pool
            left = sum(len(p[3]) for p in pool)
            if left < window:
                return
            index = Bm25([p[3] for p in pool])
            used = np.zeros(len(pool), bool)
            seed, lowest = None, 0
            while left >= window:
                if seed is None:
                    while used[lowest]:
                        lowest += 1
                    seed = lowest
                at, turn, near = 0, [seed], index.search(seed, used, query_terms, 64)
                while at < window:
                    if turn:
                        k = turn.pop()
                    else:
                        k = next(near, None)
                        if k is None:  # no neighbours are left: the next unused text
                            while used[lowest]:
                                lowest += 1
                            k = lowest
                    if used[k]:
                        continue
                    n = min(window - at, len(pool[k][3]))
                    place(pool[k], n, at)
                    at += n
                    used[k] = not len(pool[k][3])
                    seed = None if used[k] else k
                left -= window
                sequence += 1
            pool = [p for p in pool if len(p[3])]

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 7
            out.clear()
            kinds = [pa.int64()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        end = np.array([end_id], "<u2")
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc_id, encoded in zip(part.column(0).to_pylist(), ids.encode(part.column(1).to_pylist())):
                    x = np.concatenate([np.frombuffer(encoded, "<u2"), end])
                    piece = [doc_id, len(x), 0, x]
                    while len(piece[3]) >= window:
                        place(piece, window, 0)
                        sequence += 1
                    if len(piece[3]):
                        pool.append(piece)
                if len(pool) >= shard_docs:
                    fill()
                if len(out) > 20_000:
                    yield rows()
        fill()
        left = sum(len(p[3]) for p in pool)
        for bit in reversed(range(left.bit_length())):
            if left >> bit & 1:
                at = 0
                while at < 1 << bit:
                    n = min((1 << bit) - at, len(pool[0][3]))
                    place(pool[0], n, at)
                    at += n
                    if not len(pool[0][3]):
                        pool.pop(0)
                sequence += 1
        if out:
            yield rows()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
