"""Token counts by whole-token shortcut, and ids by the same kept chunks.

Offline, every vocabulary string is encoded alone; those that come back as one token are proven whole.
A pre-token among them counts one without any merging; only the rest is merged by the library. Counts
of chunks between spaces are kept in a bounded table, as texts repeat their words. Texts with characters
whose classes or cases differ between libraries, or with a special string, go to the library whole."""

from __future__ import annotations

import functools
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Latin letters without the dotted capital I, printable ASCII, tab and line ends: classes and cases are the same everywhere.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ſ]*")
#: The pre-tokenizer's pattern in the file of the word tokenizer (a fixed value).
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The byte-level pre-tokenizer's pattern (a fixed value).
BYTE_PRE_TOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Chunks to keep before a worker starts anew.
KEPT = 800_000


@functools.cache
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def specials(tok) -> list[str]:
    return [t.content for t in tok.get_added_tokens_decoder().values()]


def whole_tokens(path: str) -> set[str]:
    """The proof: strings that the pre-tokenizer leaves in one piece and the library encodes alone as one token."""
    tok = tokenizer(path)
    strings = sorted({tok.decode([i], skip_special_tokens=False).removesuffix("</w>").strip() for i in tok.get_vocab(with_added_tokens=False).values()})
    strings = [s for s in strings if s and PLAIN.fullmatch(s) and s == s.lower() and PRE_TOKEN.fullmatch(s) and PRE_TOKEN.findall(s) == [s]]
    return {s for s, e in zip(strings, tok.encode_batch(strings, add_special_tokens=False)) if len(e.ids) == 1}


class Counter:
    """Counts tokens of texts as the library does."""

    def __init__(self, path: str, whole: set[str]):
        self.tok, self.whole, self.chunks, self.special = tokenizer(path), whole, {}, specials(tokenizer(path))

    def learn(self, new: set[str]) -> None:
        if len(self.chunks) + len(new) > KEPT:
            self.chunks.clear()
        parts = {c: PRE_TOKEN.findall(c) for c in new}
        rest = sorted({p for ps in parts.values() for p in ps}.difference(self.whole))
        merged = dict(zip(rest, (len(e.ids) for e in self.tok.encode_batch(rest, add_special_tokens=False))))
        for c, ps in parts.items():
            self.chunks[c] = sum(merged.get(p, 1) for p in ps)

    def count(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        for at in range(0, len(texts), 256):
            split = {}
            for k, t in enumerate(texts[at : at + 256], at):
                if t and PLAIN.fullmatch(t) and not any(s in t for s in self.special):
                    split[k] = t.lower().split()
                elif t:
                    out[k] = len(self.tok.encode(t, add_special_tokens=False).ids)
            new = set().union(*split.values())
            if missing := new.difference(self.chunks):
                self.learn(missing if len(self.chunks) + len(missing) <= KEPT else new)
            for k, cs in split.items():
                out[k] = sum(map(self.chunks.__getitem__, cs))
        return out


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of whole texts; null and empty texts have 0 bytes and tokens. Ids, even null or repeated ones, keep their rows."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, whole.value)
        for b in batches:
            n = counter.count(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


@functools.cache
def merge_ranks(path: str):
    """The same byte-level BPE with merges looked up by rank, which is faster; None unless the file proves it equal.

    Proof: no normalizer, the byte-level pre-tokenizer with its own pattern, and every merge makes the token whose id
    follows that of the merge before, so that the order of merges is the order of ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, pre = spec["model"]["vocab"], spec["pre_tokenizer"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    ids = [vocab.get("".join(p), -1) for p in pairs]
    if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or ids != list(range(256, 256 + len(ids))):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others are chr(256 + k)
    of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if i < 256 + len(ids)}
    return tiktoken.Encoding(path, pat_str=BYTE_PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


class Ids:
    """Ids of texts by a byte-level tokenizer, as little-endian 16-bit numbers.

    A space starts a new pre-token unless white space stands before it, so a text without two spaces in a row
    is encoded chunk by chunk, each with the space before it."""

    def __init__(self, path: str):
        self.tok, self.chunks, self.special = tokenizer(path), {}, specials(tokenizer(path))
        self.ranks = merge_ranks(path)
        if self.tok.get_vocab_size() > 65536:
            raise ValueError("ids must fit 16 bits")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        for at in range(0, len(texts), 256):
            split = {}
            for k, t in enumerate(texts[at : at + 256], at):
                if t and "  " not in t and PLAIN.fullmatch(t) and not any(s in t for s in self.special):
                    first, *rest = t.split(" ")
                    split[k] = (first, rest)
                elif t:
                    out[k] = self._bytes(self.tok.encode(t, add_special_tokens=False).ids)
            new = set().union(*(r for _, r in split.values()))
            if missing := new.difference(self.chunks):
                if len(self.chunks) + len(missing) > KEPT:
                    self.chunks.clear()
                    missing = new
                self.learn(list(missing))
            for k, (first, rest) in split.items():
                out[k] = self._bytes(self.tok.encode(first, add_special_tokens=False).ids) + b"".join(map(self.chunks.__getitem__, rest))
        return out

    def learn(self, chunks: list[str]) -> None:
        if self.ranks is not None:
            encode, to_bytes = self.ranks.encode_ordinary, self._bytes
            for c in chunks:
                self.chunks[c] = to_bytes(encode(" " + c))
        else:
            for c, e in zip(chunks, self.tok.encode_batch([" " + c for c in chunks], add_special_tokens=False)):
                self.chunks[c] = self._bytes(e.ids)

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        out = array("H", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()
