"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's parts form a linked list. Every adjacent pair that is in the
vocabulary waits in the bucket of its rank (list positions, least first). A bitmap
of two levels of 256-bit words says which buckets hold anything; find-first-set on
each level gives the least rank in constant time, however long the pre-token is.
A bucket is taken whole, up to a merge that lets a lower rank wait. An entry whose
pair has changed meanwhile is stale and skipped. A pre-token that is itself in the
vocabulary is its own token. Pre-tokens met before keep their ids, up to a bound.

Defined cases: an empty table gives an empty one; null texts are empty and have no ids; special tokens' strings are
ordinary text; repeated rows are encoded each; other columns pass through unless
they have an output column's name, in which case they are dropped.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import small_batches

#: Bits of a word of the rank bitmap: two levels of 256 hold 65,536 ranks; the top word grows beyond.
SHIFT, MASK = 8, 255


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Which ranks wait: buckets of list positions under a bitmap of two levels of WORD-bit words.
    Empty between pre-tokens; ``Encoder.merge`` works on its levels in place."""

    def __init__(self, ranks: int):
        self.low = [0] * (((ranks - 1) >> SHIFT) + 1)
        self.buckets: list[list[int] | None] = [None] * ranks


class Seen(dict):
    """Packed ids of pre-tokens. Two generations: when the young one is full it becomes the old
    one, and pre-tokens met again move over, so frequent ones are never merged anew."""

    def __init__(self, merge, most: int):
        super().__init__()
        self.merge, self.most, self.old = merge, most, {}

    def __missing__(self, token: str) -> bytes:
        ids = self.old.get(token)
        if ids is None:
            ids = self.merge(token.encode("utf-8", "surrogatepass"))
        if len(token) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[token] = ids
        return ids


class Encoder:
    """Ids of texts under a rank vocabulary and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = 250_000):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        most = max(ranks.values()) + 1
        self.queue, self.wide = RankQueue(most), most.bit_length()
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        #: Rank of what two neighbours merge into, by both ids.
        self.pairs = {
            a << self.wide | b: r
            for t, r in ranks.items()
            for k in range(1, len(t))
            if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None
        }
        self.seen = Seen(self.merge, kept)

    def merge(self, piece: bytes) -> bytes:
        """Ids of one pre-token, as little-endian unsigned 32-bit integers."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return whole.to_bytes(4, "little")
        get, wide, low, buckets = self.pairs.get, self.wide, self.queue.low, self.queue.buckets
        n = len(piece)
        ids = [self.single[b] for b in piece]
        waits = [get(a << wide | b, -1) for a, b in zip(ids, ids[1:], strict=False)]
        waits.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        top, new = 0, [(i, r) for i, r in enumerate(waits) if r >= 0]
        while True:
            for i, r in new:  # push
                held = buckets[r]
                if held is not None:
                    held.append(i)
                    continue
                buckets[r] = [i]
                w = r >> SHIFT
                if not low[w]:
                    top |= 1 << w
                low[w] |= 1 << (r & MASK)
            if not top:
                break
            w = (top & -top).bit_length() - 1  # pop the least rank's bucket: find-first-set on each level
            b = low[w]
            bit = b & -b
            rank = w << SHIFT | (bit.bit_length() - 1)
            held, buckets[rank] = buckets[rank], None
            low[w] = b = b ^ bit
            if not b:
                top &= top - 1
            if len(held) > 1:
                held.sort()
            new = []
            for at, i in enumerate(held):
                if waits[i] != rank:
                    continue  # stale
                j = after[i]
                ids[i], ids[j], waits[j], waits[i] = rank, -1, -1, -1
                k = after[i] = after[j]
                p = before[i]
                least = rank
                if k < n:
                    before[k] = i
                    r = get(rank << wide | ids[k], -1)
                    if r >= 0:
                        waits[i] = r
                        new.append((i, r))
                        least = r if r < least else least
                if p >= 0:
                    waits[p] = r = get(ids[p] << wide | rank, -1)
                    if r >= 0:
                        new.append((p, r))
                        least = r if r < least else least
                if least < rank:  # goes first; the rest of the bucket waits on
                    new += [(x, rank) for x in held[at + 1 :]]
                    break
        return array("I", [x for x in ids if x >= 0]).tobytes()

    def packed(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.seen.__getitem__, self.pattern.findall(text)))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker, which keeps what it has learnt between tasks."""
    return Encoder(load_ranks(path), pattern)


@lru_cache(maxsize=4)
def bytes_of(path: str) -> list[bytes]:
    of = {i: b for b, i in load_ranks(path).items()}
    return [of.get(i, b"") for i in range(max(of) + 1)]


def decode_ids(ids: list[int], path: str) -> bytes:
    return b"".join(map(bytes_of(path).__getitem__, ids))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The documents with ``ids``: token ids as little-endian unsigned 32-bit integers."""
    small_batches(docs.sparkSession)

    @pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        coder = encoder(path, pattern)
        return pd.Series([coder.packed(t or "") for t in texts], dtype=object)

    return docs.select(*[c for c in docs.columns if c != "ids"], run(F.col(text_col)).alias("ids"))


def decode(ids: Column, path: str) -> Column:
    """The bytes of an ``ids`` column."""

    @pandas_udf("binary")
    def run(many: pd.Series) -> pd.Series:
        return pd.Series([decode_ids(np.frombuffer(x, "<u4").tolist(), path) for x in many], dtype=object)

    return run(ids)


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The documents with ``ids``, and ``decoded``: the bytes that those ids decode to, in one pass."""
    small_batches(docs.sparkSession)

    @pandas_udf("struct<ids:binary,decoded:binary>")
    def run(texts: pd.Series) -> pd.DataFrame:
        coder = encoder(path, pattern)
        ids = [coder.packed(t or "") for t in texts]
        return pd.DataFrame({"ids": ids, "decoded": [decode_ids(np.frombuffer(x, "<u4").tolist(), path) for x in ids]})

    docs = docs.select(*[c for c in docs.columns if c not in ("ids", "decoded")], run(F.col(text_col)).alias("__coded"))
    return docs.withColumns({"ids": F.col("__coded.ids"), "decoded": F.col("__coded.decoded")}).drop("__coded")
