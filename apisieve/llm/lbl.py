"""Language-model scores: a log-bilinear neural model, trained by noise-contrastive estimation.

Words (whitespace, A-Z lower-cased) and one end for each document are the tokens. The
model predicts a token's class: the OWN most frequent words and the end are classes of
their own, all other words fall into classes by their last three bytes (the SUFFIXES
endings of most words one each, all other endings HASHED by a checksum). Within a class
a word has its share of the counts (smoothed by 0.1, one share kept for words not seen).

The context is the words before: those one and two before, and the sum of the WINDOW
before. Every word met CONTEXT_LEAST times in training has a vector of its own as
context, up to CONTEXTS of them, so the vocabulary grows with the corpus up to that
bound; other words share their class's. The three parts are scaled by vectors of their
place and added up; the sum predicts each class by the class's vector and bias.

Training runs where the documents are: each task takes every training token it holds,
in batches, with NOISE classes drawn from the counts as noise, and descends the
contrastive loss; then the tasks' parameters are averaged, each vector by how often a
task met it, in two steps of sums. So what is learnt from grows with the input, and the
driver gets one set of parameters (about a megabyte). A corpus of any size takes PASSES.

Batched matrix products over all classes give normalised log-probabilities.

Counts are exact and distributed. The most frequent words' counts are broadcast (a
fixed bound, TOP at most); all other words' counts meet their documents by a join on the word.

Defined cases: null and empty texts have the end only; without training documents all
counts are 0 and the model is what it starts from; an empty table gives an empty result;
repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

OWN, SUFFIXES, HASHED, TOP = 96, 128, 31, 200_000
END, CLASSES = OWN, OWN + 1 + SUFFIXES + HASHED
CONTEXTS, CONTEXT_LEAST, WINDOW = 16_384, 10, 16
DIM, NOISE, BATCH, RATE, SEED = 16, 24, 4096, 0.1, 7
#: Tokens scored at a time, and scores whose exponentials and their sums are within the range of single precision.
SCORED, SAFE = 1024, 80.0
#: Passes over the training texts, whatever their number; texts that a task trains on at a time.
PASSES, TEXTS = 1, 500
#: Numbers in a block of parameters, and groups of tasks that are summed first.
BLOCK, GROUPS = 1 << 15, 256
SMOOTH = 0.1


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over whole texts; tasks add up before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                n.update(tokens(text))
                if len(n) > 400_000:
                    yield pd.DataFrame({"word": list(n.keys()), "n": list(n.values())})
                    n = Counter()
        yield pd.DataFrame({"word": pd.Series(list(n.keys()), dtype=object), "n": pd.Series(list(n.values()), dtype="int64")})

    return docs.select("text").mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """What scoring needs: a bounded word list with counts, endings, class masses and the parameters."""

    words: list[bytes]
    n: np.ndarray
    endings: dict[bytes, int]
    in_class: np.ndarray  # log10 of each class's smoothed mass
    noise: np.ndarray
    n_docs: int
    n_all: int
    v_all: int
    p: dict[str, np.ndarray]

    @property
    def contexts(self) -> int:
        return len(self.p["r"]) - CLASSES - 1

    @cached_property
    def codes(self) -> Codes:
        """Made once where the model is used; a worker keeps it for its tasks as long as the model."""
        return Codes(self)


def ending_class(word: bytes, endings: dict[bytes, int]) -> int:
    k = endings.get(word[-3:])
    return END + 1 + (SUFFIXES + zlib.crc32(word[-3:]) % HASHED if k is None else k)


class Tails(dict):
    """Class of a word without a class of its own, by its last three bytes; kept up to a bound."""

    def __init__(self, endings: dict[bytes, int]):
        self.endings = endings

    def __missing__(self, tail: bytes) -> int:
        c = ending_class(tail, self.endings)
        if len(self) < 65_536:
            self[tail] = c
        return c


class Codes(dict):
    """Place of a word among the model's words; what is not among them has their number and the
    word's class as its place. ``context``, ``cls`` and ``log_n`` go by that place."""

    def __init__(self, model: Model):
        super().__init__((w, k) for k, w in enumerate(model.words))
        self.far = len(model.words)
        own = [k if k < OWN else ending_class(w, model.endings) for k, w in enumerate(model.words)]
        self.cls = np.array(own + list(range(CLASSES)), np.int64)
        self.context = np.where(np.arange(len(self.cls)) < min(model.contexts, self.far), np.arange(len(self.cls)), model.contexts + self.cls)
        self.log_n = np.concatenate([np.log10(model.n + SMOOTH), np.zeros(CLASSES)])
        self.tails = Tails(model.endings)


def places(texts: list[list[bytes]], codes: Codes) -> tuple[np.ndarray, ...]:
    """Place, and the start and end of its text for each token; every text's end included."""
    sizes = np.array([len(w) for w in texts], np.int64)
    flat = list(chain.from_iterable(texts))
    words = np.fromiter(map(codes.get, flat, repeat(-1)), np.int64, len(flat))
    far = np.nonzero(words < 0)[0]
    words[far] = [codes.tails[flat[k][-3:]] for k in far.tolist()]
    words[far] += codes.far
    ends = np.cumsum(sizes + 1)
    out = np.full(len(words) + len(texts), codes.far + END)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = words
    return out, np.repeat(ends - sizes - 1, sizes + 1), np.repeat(ends, sizes + 1)


def encode(texts: list[list[bytes]], codes: Codes) -> tuple[np.ndarray, ...]:
    """Context codes, classes, and the start and end of its text for each token."""
    at, start, end = places(texts, codes)
    return codes.context[at], codes.cls[at], start, end


def _parts(p: dict, code: np.ndarray, start: np.ndarray, a: int, b: int) -> tuple[np.ndarray, ...]:
    """Which of tokens a to b have no word one and two before, and the three parts of their contexts."""
    at, begin, first, pad = np.arange(a, b), start[a:b], max(0, a - WINDOW), p["r"][-1]
    rows = np.empty((b - first + 2, DIM), np.float32)  # two rows, and one for each token from the first
    rows[:2] = pad
    np.take(p["r"], code[first:b], 0, out=rows[2:], mode="clip")
    none, few = at == begin, at - begin < 2
    x1, x2 = rows[a - first + 1 : b - first + 1].copy(), rows[a - first : b - first].copy()
    x1[none], x2[few] = pad, pad
    run = np.zeros((b - first + 1, DIM), np.float32)
    np.cumsum(rows[2:], 0, out=run[1:])
    bag = run[a - first : b - first] - run[np.maximum(begin, at - WINDOW) - first]
    bag *= np.float32(WINDOW**-0.5)
    return none, few, x1, x2, bag


def _context(p: dict, x1: np.ndarray, x2: np.ndarray, bag: np.ndarray) -> np.ndarray:
    """The three parts, scaled and added up."""
    x = x1 * p["a"][0]
    x += x2 * p["a"][1]
    x += bag * p["a"][2]
    return x


def log_classes(p: dict, code: np.ndarray, start: np.ndarray, a: int, b: int) -> np.ndarray:
    """Normalised natural log-probabilities of all classes for tokens a to b."""
    *_, x1, x2, bag = _parts(p, code, start, a, b)
    s = _context(p, x1, x2, bag) @ p["q"].T + p["b"]
    s -= s.max(1, keepdims=True)
    return s - np.log(np.exp(s).sum(1, keepdims=True))


def log_targets(p: dict, code: np.ndarray, cls: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Normalised natural log-probability of each token's class."""
    out = np.empty(len(code))
    q = np.ascontiguousarray(np.column_stack([p["q"], p["b"]]).T)
    longest, highest = np.sqrt((p["q"] ** 2).sum(1).max()), np.abs(p["b"]).max()
    x, scores, ones = np.ones((SCORED, DIM + 1), np.float32), np.empty((SCORED, CLASSES), np.float32), np.ones(CLASSES, np.float32)
    for a in range(0, len(code), SCORED):
        b = min(len(code), a + SCORED)
        *_, x1, x2, bag = _parts(p, code, start, a, b)
        x[: b - a, :DIM] = context = _context(p, x1, x2, bag)
        s = np.matmul(x[: b - a], q, out=scores[: b - a])
        if not np.sqrt(np.einsum("ij,ij->i", context, context).max()) * longest + highest < SAFE:
            s -= s.max(1, keepdims=True)
        own = s[np.arange(b - a), cls[a:b]]
        out[a:b] = own - np.log(np.exp(s, out=s) @ ones)
    return out


def _sums(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys (below 65,536) that occur, and the sums of their rows."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    keys = keys[order]
    heads = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    return keys[heads], np.add.reduceat(rows[order], heads)


def _sigmoid(s: np.ndarray) -> np.ndarray:
    """In place."""
    np.clip(s, -20, 20, out=s)
    np.exp(np.negative(s, out=s), out=s)
    s += 1
    return np.reciprocal(s, out=s)


class Trainer:
    """Descends the contrastive loss over the tokens it is given (steps scaled by past gradients)."""

    def __init__(self, p: dict[str, np.ndarray], noise: np.ndarray, seed: list[int]):
        self.p = {k: x.astype(np.float32) for k, x in p.items()}
        self.past = {k: np.full_like(x, 1e-2) for k, x in self.p.items()}
        self.noise, self.log_noise = noise, (np.log(noise) + np.log(NOISE)).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.met, self.tokens = np.zeros(len(p["r"]), np.float32), 0

    def step(self, code: np.ndarray, target: np.ndarray, start: np.ndarray, end: np.ndarray, a: int, b: int) -> None:
        p, n = self.p, b - a
        none, few, x1, x2, bag = _parts(p, code, start, a, b)
        x, y = _context(p, x1, x2, bag), target[a:b]
        drawn = self.rng.choice(CLASSES, NOISE, p=self.noise)
        q_y, q_drawn = p["q"][y], p["q"][drawn]
        true = np.einsum("ij,ij->i", x, q_y) + p["b"][y] - self.log_noise[y]
        false = x @ q_drawn.T + (p["b"][drawn] - self.log_noise[drawn])
        true, false = _sigmoid(true) - 1, _sigmoid(false)
        d_x = false @ q_drawn
        q_y *= true[:, None]
        d_x += q_y
        g = {"q": np.zeros_like(p["q"]), "b": np.bincount(y, true, CLASSES).astype(np.float32), "a": np.stack([np.einsum("ij,ij->j", d_x, part) for part in (x1, x2, bag)])}
        met, d_q = _sums(y, true[:, None] * x)
        g["q"][met] = d_q
        np.add.at(g["q"], drawn, false.T @ x)
        np.add.at(g["b"], drawn, false.sum(0))
        # a word gets the sum of the gradients of the later tokens that have it in their window, and of
        # the next two; what these lack before them is the last vector's, in the row before the first word's
        first = max(0, a - WINDOW)
        run = np.zeros((n + 1, DIM), np.float32)
        np.cumsum(d_x * (p["a"][2] * np.float32(WINDOW**-0.5)), 0, out=run[1:])
        at = np.arange(first, b)
        low = np.clip(at + 1 - a, 0, n)
        high = np.maximum(np.minimum(np.minimum(end[first:b], at + WINDOW + 1), b) - a, low)
        d_r = np.zeros((b - first + 2, DIM), np.float32)
        np.subtract(run[high], run[low], out=d_r[2:])
        d_1, d_2 = d_x * p["a"][0], d_x * p["a"][1]
        lacked = d_1[none].sum(0) + d_2[few].sum(0)
        d_1[none], d_2[few] = 0, 0
        d_r[a - first + 1 : b - first + 1] += d_1
        d_r[a - first : b - first] += d_2
        codes, skip = code[first:b], 2
        if few.any():
            d_r[1], skip, codes = lacked, 1, np.concatenate([[len(p["r"]) - 1], codes])
        rows, d_r = _sums(codes, d_r[skip:])
        for k, d in g.items():
            self.past[k] += d * d
            p[k] -= RATE * d / np.sqrt(self.past[k])
        self.past["r"][rows] += d_r * d_r
        p["r"][rows] -= RATE * d_r / np.sqrt(self.past["r"][rows])
        self.met[rows] += 1
        self.tokens += n

    def run(self, code: np.ndarray, target: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        for a in range(0, len(code), BATCH):
            self.step(code, target, start, end, a, min(len(code), a + BATCH))

    def weighted(self) -> np.ndarray:
        """All parameters by their weights, and the weights, as one vector; these add up over tasks."""
        p, w = self.p, np.float32(self.tokens)
        return np.concatenate([(p["r"] * self.met[:, None]).ravel(), self.met, *[p[k].ravel() * w for k in ("q", "b", "a")], [w]]).astype(np.float32)


def averaged(p: dict[str, np.ndarray], total: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters from summed ``weighted`` vectors; what no task met stays as it was."""
    u = len(p["r"])
    r, met = total[: u * DIM].reshape(u, DIM), total[u * DIM : u * DIM + u]
    out = {"r": np.where(met[:, None] > 0, r / np.maximum(met, 1e-9)[:, None], p["r"])}
    at = u * DIM + u
    for k in ("q", "b", "a"):
        out[k] = (total[at : at + p[k].size] / total[-1]).reshape(p[k].shape)
        at += p[k].size
    return {k: x.astype(np.float32) for k, x in out.items()}


def initial(contexts: int, noise: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    p = {"r": rng.normal(0, 0.1, (contexts + CLASSES + 1, DIM)), "q": rng.normal(0, 0.1, (CLASSES, DIM)), "b": np.log(noise), "a": np.ones((3, DIM))}
    return {k: x.astype(np.float32) for k, x in p.items()}


def _pass(learnt: DataFrame, model: Model, turn: int) -> dict[str, np.ndarray]:
    """The parameters after every task's pass over its training texts."""
    shared = learnt.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, task = shared.value, TaskContext.get().partitionId()
        codes, trainer = model.codes, Trainer(model.p, model.noise, [SEED, turn, task])
        for batch in batches:
            for k in range(0, len(batch), TEXTS):
                trainer.run(*encode([tokens(t) for t in batch["text"].iloc[k : k + TEXTS]], codes))
        if trainer.tokens:
            all_ = trainer.weighted()
            cuts = range(0, len(all_), BLOCK)
            yield pd.DataFrame({"block": range(len(cuts)), "slot": zlib.crc32(b"%d" % task) % GROUPS, "sums": [all_[k : k + BLOCK].astype(np.float64).tobytes() for k in cuts]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(rows["sums"].iloc[0]) // 8)
        for x in rows["sums"]:
            total += np.frombuffer(x, np.float64)
        return rows.head(1)[["block", "slot"]].assign(sums=[total.tobytes()])

    kind = "block int, slot int, sums binary"
    rows = learnt.select("text").mapInPandas(run, kind).groupBy("block", "slot").applyInPandas(add, kind).groupBy("block").applyInPandas(add, kind).collect()
    if not rows:
        return model.p
    return averaged(model.p, np.concatenate([np.frombuffer(r.sums, np.float64) for r in sorted(rows, key=lambda r: r.block)]))


def _frequent(counts: DataFrame) -> DataFrame:
    """The most frequent words, TOP at most: all whose count is in the highest classes that fit."""
    grade = F.floor(8 * F.log2("n")).cast("int")
    room, least = TOP, 1 << 30
    for r in counts.groupBy(grade.alias("grade")).count().orderBy(F.col("grade").desc()).collect():  # some hundred classes
        room -= r["count"]
        if room < 0:
            break
        least = r["grade"]
    return counts.filter(grade >= least)


def fit(learnt: DataFrame, counts: DataFrame) -> Model:
    """The model of training documents (text), given their word counts."""
    n_docs = learnt.count()
    top = sorted(_frequent(counts).collect(), key=lambda r: (-r.n, bytes(r.word)))  # at most TOP rows
    own = {bytes(r.word) for r in top[:OWN]}
    ending = F.substring("word", F.greatest(F.octet_length("word") - 2, F.lit(1)), F.lit(3))
    by_ending = counts.groupBy(ending.alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    first = by_ending.orderBy(F.desc("n"), "e").limit(SUFFIXES).select("e").collect()
    endings = {bytes(r.e): k for k, r in enumerate(first)}
    hashed = F.crc32("e") % HASHED
    named = F.create_map(*[F.lit(x) for e, k in endings.items() for x in (e.hex(), k)]) if endings else None
    cls = hashed + SUFFIXES if named is None else F.coalesce(F.try_element_at(named, F.lower(F.hex("e"))), (hashed + SUFFIXES).cast("int"))
    mass, seen = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_ending.groupBy((cls.cast("int") + END + 1).alias("c")).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        mass[r.c], seen[r.c] = r.n, r.v
    n_all, v_all = int(mass.sum()) + n_docs, int(seen.sum()) + (n_docs > 0)
    for k, r in enumerate(top[:OWN]):
        c = ending_class(bytes(r.word), endings)
        mass[k], mass[c], seen[c] = r.n, mass[c] - r.n, seen[c] - 1
    assert len(own) == min(OWN, len(top))
    mass[END] = n_docs
    noise = (mass + 1) / (mass + 1).sum()
    contexts = sum(r.n >= CONTEXT_LEAST for r in top[:CONTEXTS])
    in_class = np.log10(mass + SMOOTH * (seen + 1))
    model = Model([bytes(r.word) for r in top], np.array([r.n for r in top], np.int64), endings, in_class, noise, n_docs, n_all, v_all, initial(contexts, noise))
    for turn in range(PASSES if n_all else 0):
        model.p = _pass(learnt, model, turn)
    return model


def score_documents(docs: DataFrame, trains: Column, name: str = "lbl") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every row;
    ``trains`` says which rows the counts and the model are learnt from."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    learnt = docs.filter("trains")
    counts = cut(count_words(learnt), f"{name}-counts")
    return apply_model(docs, fit(learnt, counts), counts, name)


def apply_model(docs: DataFrame, model: Model, counts: DataFrame, name: str = "lbl") -> DataFrame:
    """``score_documents`` of (doc_id, text, trains) by a fitted model and its word counts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base_mass = float(np.log10(model.n_all + SMOOTH * (model.v_all + 1)))
    end_log = float(np.log10(model.n_docs + SMOOTH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        codes, base = model.codes, TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [tokens(t) for t in batch["text"].to_numpy(zero_copy_only=False)]
            if not texts:
                continue
            at, start, _ = places(texts, codes)
            cls = codes.cls[at]
            logs = log_targets(model.p, codes.context[at], cls, start) / np.log(10)
            sizes = np.array([len(w) for w in texts])
            last = np.cumsum(sizes + 1) - 1  # the ends
            share = codes.log_n[at]
            inner = np.where(cls > END, share - model.in_class[cls], 0.0)
            share[last] = end_log
            heads = last - sizes
            known = at < codes.far
            # what is not in the broadcast table adds its own logarithm by the join
            known[last] = True
            far = np.nonzero(~known)[0]
            known[last] = model.n_docs > 0
            words, times, most = [], [], []
            cuts = np.searchsorted(far, np.append(heads, len(at))).tolist()
            far = far.tolist()
            for text, head, low, high in zip(texts, heads.tolist(), cuts[:-1], cuts[1:], strict=True):
                met = Counter([text[k - head] for k in far[low:high]])
                words += met.keys()
                times += met.values()
                most.append(len(met))
            rare = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["word", "k"])
            columns = {
                "row": pa.array(base + np.arange(len(texts))),
                "doc_id": batch["doc_id"],
                "held_out": pc.invert(batch["trains"]),
                "n_tokens": pa.array(sizes + 1),
                "n_known": pa.array(np.add.reduceat(known.astype(np.int64), heads)),
                "base": pa.array(np.add.reduceat(share, heads)),
                "score": pa.array(np.add.reduceat(logs + inner, heads)),
                "rare": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(most)]), pa.int32()), rare),
            }
            base += len(texts)
            yield pa.RecordBatch.from_pydict(columns)

    kind = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,k:long>>"
    parts = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "trains").mapInArrow(run, kind), f"{name}-parts")
    rare = parts.select("row", F.inline("rare")).join(counts, "word", "left")
    n = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.when(n > 0, F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * F.log10(n + SMOOTH)).alias("more"))
    done = parts.drop("rare").join(rare, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return done.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(model.n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(base_mass)).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
