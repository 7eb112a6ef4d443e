"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n`` (feed-forward and
attention). Each task packs its documents in groups of about ``GROUP_TOKENS``.
In a group, the full sequences' worth of a long document is cut off first; the
rests, in descending cost, go to the open sequence of lowest cost whose remaining
capacity holds them. A rest that no sequence holds is cut at the lowest-cost open
sequence, and what is left over queues again. The open sequences' capacities sum to
the group's tokens exactly: full ones, and the binary parts of what is left, each a
power of two, which the data loader runs without padding. So nothing is padded.

No shuffle: a sequence is made of documents of one input partition, and a task holds
one group at a time. A sequence's id is its partition's number times 2**33 plus its
count there; a task that runs again numbers and packs alike if its input comes in
the same order (files do).

Defined cases: null and empty texts have only the end id; null doc_ids and repeated
rows are packed like others; other columns are ignored; no rows give no sequences.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunks
from .common import small_batches

LENGTH, GROUP_TOKENS = 1024, 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def json_encoder(path: str, pattern: str):
    """Encodes as the byte-level BPE in a tokenizers file does, by its vocabulary's ranks
    (its special tokens' strings are those tokens); and whether an id begins with a space, by ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    coder = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    marks = re.compile("|".join(map(re.escape, special)) or r"(?!)")
    leads = np.zeros(1 + max([*ranks.values(), *special.values()]), bool)
    leads[[i for t, i in ranks.items() if t[:1] == b" "]] = True
    return (lambda text: coder.encode(text, allowed_special="all") if marks.search(text) else coder.encode_ordinary(text)), leads


#: Chunks that a worker keeps in a generation: time against memory, some 100 MB for each 250,000.
KEPT = 500_000


@lru_cache(maxsize=4)
def chunks_of(path: str, pattern: str, most: int = KEPT) -> Chunks:
    """One for each Python worker, which keeps what it has learnt between tasks."""
    return Chunks(*json_encoder(path, pattern), most)


def pack(lengths: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, size, sequence, offset) of each piece; sequences from 0, all full or of a power of two."""
    out, n_seq, queue = [], 0, []
    for d, n in enumerate(lengths):
        full = n // length
        out += [(d, k * length, length, n_seq + k, 0) for k in range(full)]
        n_seq += full
        if n % length:
            queue.append((-(n % length), d, full * length))
    left = -sum(q[0] for q in queue)
    room = [length] * (left // length) + [1 << k for k in range(length.bit_length(), -1, -1) if (left % length) >> k & 1]
    room = np.array(room, dtype=np.int64)
    offset, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    heapq.heapify(queue)
    while queue:
        n, d, start = heapq.heappop(queue)
        n = -n
        at = int(np.where(room >= n, cost, np.inf).argmin())
        if room[at] < n:
            at = int(np.where(room > 0, cost, np.inf).argmin())
            rest = n - int(room[at])
            n -= rest
            heapq.heappush(queue, (-rest, d, start + n))
        out.append((d, start, n, n_seq + at, int(offset[at])))
        room[at] -= n
        offset[at] += n
        cost[at] += linear * n + quadratic * n * n
    return out


def pack_documents(docs: DataFrame, path: str, pattern: str, end_id: int = 0, length: int = LENGTH, group_tokens: int = GROUP_TOKENS, kept: int = KEPT) -> DataFrame:
    """One row for each piece, with its ids (little-endian unsigned 32-bit integers)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = chunks_of(path, pattern, kept)
        base, held, tokens = (TaskContext.get().partitionId() << 33), [], 0
        end = np.array([end_id], np.uint32)

        def packed() -> pd.DataFrame:
            nonlocal base
            rows = pack([len(ids) for _, ids in held], length)
            frame = pd.DataFrame(
                {
                    "doc_id": pd.array([held[d][0] for d, *_ in rows], dtype="Int64"),
                    "start": [s for _, s, *_ in rows],
                    "length": [n for _, _, n, *_ in rows],
                    "ids": [held[d][1][s : s + n].astype("<u4").tobytes() for d, s, n, *_ in rows],
                    "doc_tokens": [len(held[d][1]) for d, *_ in rows],
                    "sequence_id": [base + q for *_, q, _ in rows],
                    "offset": [o for *_, o in rows],
                }
            )
            base += max((q for *_, q, _ in rows), default=-1) + 1
            return frame

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.concatenate([coder.ids(text or ""), end])
                held.append((None if pd.isna(doc_id) else int(doc_id), ids))
                tokens += len(ids)
                if tokens >= group_tokens:
                    yield packed()
                    held, tokens = [], 0
        if held:
            yield packed()

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids instead of the ids."""
    crc = F.crc32(F.col("ids")).alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")
