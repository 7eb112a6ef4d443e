"""Text to token ids by chunks between single spaces.

Under the pre-token pattern of the byte-level vocabularies a space belongs to the
word after it, so wherever no white space (or the end) follows a space, a text's
ids are those of its space-led chunks, one after another. Chunks repeat, and their
ids are kept; other texts are encoded whole. A text's chunks that are not kept are
encoded together: in their ids, each begins at an id that begins with a space.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

UNSAFE = re.compile(r" (?:\s|\Z)")


class Chunks:
    """Keeps the ids of a chunk (after its space) as bytes, little-endian, 32 bits each.

    Two generations are kept: when the young one is full it becomes the old one, and
    chunks met again move over, so frequent chunks are never encoded anew.
    ``leads`` says of each id whether it begins with a space.
    """

    def __init__(self, encode: Callable[[str], list[int]], leads: np.ndarray, most: int = 200_000, longest: int = 64):
        self.encode, self.leads, self.most, self.longest = encode, leads, most, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.used = 0

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        ids = np.array(self.encode(" " + " ".join(chunks)), "<u4")
        at = np.flatnonzero(self.leads[ids])
        if len(at) != len(chunks) or at[0]:  # special tokens may hold spaces
            return [np.array(self.encode(" " + c), "<u4").tobytes() for c in chunks]
        data, cuts = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        known = {c: self.old.get(c) for c in chunks}
        new = [c for c, ids in known.items() if ids is None]
        if new:
            known.update(zip(new, self._encoded(new), strict=True))
        kept = {c: ids for c, ids in known.items() if len(c) <= self.longest} if max(map(len, known)) > self.longest else known
        self.young.update(kept)
        self.used += sum(map(len, kept.values())) // 4
        return known

    def ids(self, text: str) -> np.ndarray:
        """Token ids, uint32."""
        if UNSAFE.search(text):
            return np.asarray(self.encode(text), dtype=np.uint32)
        first, *rest = text.split(" ")
        head = np.array(self.encode(first), "<u4")
        if not rest:
            return head.astype(np.uint32)
        if len(self.young) > self.most or self.used > 16 * self.most:
            self.old, self.young, self.used = self.young, {}, 0
        found = list(map(self.young.get, rest))
        if None in found:
            at = [k for k, ids in enumerate(found) if ids is None]
            learnt = self._learn([rest[k] for k in at])
            for k in at:
                found[k] = learnt[rest[k]]
        return np.frombuffer(b"".join([head.tobytes(), *found]), "<u4").astype(np.uint32, copy=False)
