"""Toxicity by compression distance.

Two zstandard dictionaries of raw content are learnt from labelled texts: an ordinary
one of the words most frequent in ordinary documents, and a toxic one of the words most
frequent among those that set toxic documents apart (they hold character n-grams of high
log-odds that stand in many different contexts, so that copies of one document don't
count as evidence). Contents are chosen by frequency, not by zstandard's own trainer.
The toxic side
compresses with the toxic dictionary before the ordinary one, the ordinary side with
the ordinary one alone, so a window's two lengths differ by what only toxic text
explains. Windows of WINDOW words cover the whole text. A logistic calibration,
fitted on labelled documents that the dictionaries haven't seen, turns the windows'
savings into a score; its class weights make 0.7 a cautious threshold.

The classifier is fitted on at most MAX_TOXIC and MAX_ORDINARY labelled rows (of at
most MAX_CHARS characters), those of least hash; everything else covers all rows.

Defined cases: null and empty texts score as a text with one empty window; labels
that are null don't count, and of repeated labels the highest does; with too few
labelled rows of either kind every score is 0; other columns pass through unless they
have an output column's name, in which case they are dropped.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import small_batches

MAX_TOXIC, MAX_ORDINARY, MAX_CHARS = 2000, 4500, 40_000
WINDOW, LEVEL, GRAM = 10, 9, 5
TOXIC_BYTES, ORDINARY_BYTES = 8_000, 24_000
MIN_RATIO, MIN_ODDS = 20.0, 2.0
THRESHOLD, ORDINARY_WEIGHT, FITTED = 0.7, 2.0, 0.3


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def windows(text: str | None) -> list[bytes]:
    w = words(text)
    return [f" {' '.join(w[i : i + WINDOW])} ".encode("utf-8", "replace") for i in range(0, len(w), WINDOW)] or [b"  "]


def grams(word: str) -> set[str]:
    b = f" {word} "
    return {b[i : i + GRAM] for i in range(max(1, len(b) - GRAM + 1))}


def marks(toxic: list[str], ordinary: list[str]) -> set[str]:
    """N-grams that set toxic texts apart: by the log-odds of the texts that hold them, and by a
    likelihood-ratio test of the different contexts they stand in, among all words of each kind."""

    def counted(texts: list[str]) -> Counter:
        n: Counter = Counter()
        for t in texts:
            n.update(set().union(*map(grams, set(words(t)))))
        return n

    def contexts(texts: list[str], some: set[str]) -> tuple[Counter, int]:
        found: dict[str, set] = defaultdict(set)
        total = 0
        for t in texts:
            w = ["", *words(t), ""]
            total += len(w) - 2
            for before, word, after in zip(w, w[1:], w[2:], strict=False):
                for g in grams(word) & some:
                    found[g].add(zlib.crc32(f"{before} {after}".encode("utf-8", "replace")))
        return Counter({g: len(c) for g, c in found.items()}), max(total, 1)

    in_toxic, in_ordinary = counted(toxic), counted(ordinary)
    odds = {g: math.log((k + 0.5) / (len(toxic) + 1)) - math.log((in_ordinary[g] + 0.5) / (len(ordinary) + 1)) for g, k in in_toxic.items() if k >= 3}
    some = {g for g, x in odds.items() if x > MIN_ODDS}
    (a, n_a), (b, n_b) = contexts(toxic, some), contexts(ordinary, some)

    def ratio(g: str) -> float:
        x, y = a[g], b[g]
        rate = (x + y) / (n_a + n_b)
        return 2 * (x * math.log(x / n_a / rate) + (y * math.log(y / n_b / rate) if y else 0)) if x / n_a > rate else 0.0

    return {g for g in some if ratio(g) >= MIN_RATIO}


@dataclass
class Model:
    """Dictionary contents and the calibration's parameters; a few dozen kilobytes."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def scorer(self):
        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False)

        a, b = compressor(self.toxic + self.ordinary).compress, compressor(self.ordinary).compress

        def features(text: str | None) -> list[float]:
            saved = np.array([len(b(x)) - len(a(x)) for x in windows(text)])
            top = np.sort(saved)[::-1]
            return [top[0], top[:3].mean(), saved.mean(), (saved >= 3).mean(), (saved >= 4).sum(), top[0] >= 5, top[0] >= 6, math.log(len(saved)), math.log1p(np.maximum(saved - 2, 0).sum())]

        return features

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.weights[0] + ((x - self.mean) / self.spread) @ self.weights[1:], -30, 30)
        return 1 / (1 + np.exp(-z))


def _content(size: int, counted: Counter) -> bytes:
    """A raw-content dictionary: the most frequent words, the most frequent last, where matches are cheapest."""
    return f" {' '.join(w for w, _ in reversed(counted.most_common(4000)))} ".encode("utf-8", "replace")[-size:]


def train(rows: list[tuple[str | None, int]]) -> Model | None:
    """Fits dictionaries on most of the rows (text, toxic 0 or 1) and the calibration on the rest."""
    texts = {y: [t or "" for t, k in rows if k == y] for y in (0, 1)}
    if min(map(len, texts.values())) < 10:
        return None
    cut = {y: max(3, int(len(t) * (1 - FITTED))) for y, t in texts.items()}
    toxic, ordinary = texts[1][: cut[1]], texts[0][: cut[0]]
    found = marks(toxic, ordinary)
    telling = [w for t in toxic for w in words(t) if not found.isdisjoint(grams(w))]
    common = Counter(w for t in ordinary for w in words(t))
    model = Model(_content(TOXIC_BYTES, Counter(telling)), _content(ORDINARY_BYTES, common), *[np.zeros(0)] * 3)
    features = model.scorer()
    x = np.array([features(t) for y in (0, 1) for t in texts[y][cut[y] :]], dtype=np.float64)
    y = np.repeat([0.0, 1.0], [len(texts[k]) - cut[k] for k in (0, 1)])
    weight = np.where(y == 1, 1.0, ORDINARY_WEIGHT)
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - model.mean) / model.spread]
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w)), z.T @ (weight * (y - p)) - 1e-2 * w)
    model.weights = w
    return model


def labelled(docs: DataFrame, labels: DataFrame, allowed) -> list[tuple[str, int]]:
    """The bounded training sample: of each kind the rows of least hash, among the allowed."""
    some = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & allowed(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ranked = some.withColumn("r", F.xxhash64("doc_id"))
    kinds = [ranked.filter(F.col("toxic") == y).orderBy("r", "doc_id").limit(n) for y, n in ((1, MAX_TOXIC), (0, MAX_ORDINARY))]
    chosen = F.broadcast(kinds[0].unionByName(kinds[1]))  # at most MAX_TOXIC + MAX_ORDINARY rows
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").filter(F.coalesce(F.length("text"), F.lit(0)) <= MAX_CHARS).select("r", "text", "toxic").collect()
    return [(r.text, int(r.toxic)) for r in sorted(rows, key=lambda r: (r.r, r.text or ""))]


def score_documents(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Adds ``score`` and ``predicted``."""
    small_batches(docs.sparkSession)

    @pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = model.scorer()
        for texts in batches:
            x = np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), -1)
            yield pd.Series(model.probability(x) if len(x) else [], dtype="float64")

    docs = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    docs = docs.withColumn("score", F.lit(0.0) if model is None else run(F.col(text_col)))
    return docs.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
