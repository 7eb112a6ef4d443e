"""N-gram Jaccard self-join by prefix filters under several global token orders.

A document's tokens are its distinct word shingles, as 64-bit hashes. Two sets with
Jaccard likeness of at least PERCENT share a token within their prefixes of
``n - ceil(PERCENT * n / 100) + 1`` tokens, under *any* one order of all tokens. The
first order is an index: its prefix tokens are the join keys. Candidates must share
prefix tokens under each of the other orders too; only what passes all of them, and
the length filter and a bound on the differences (parities of the sets' tokens in 512
places differ in no more places than the sets do), is verified on the whole texts.

Orders put rare tokens first. The counts of the frequent tokens come from all documents:
every task adds up its own, those it met twice or more are summed, and the most frequent
ones, HEAVY at most (a fixed bound, so they may be broadcast), are ranked by count; all
other tokens are rare. The orders differ in the hash that ranks tokens of like count. The
counts only steer the orders, so what they miss costs candidates, never links.

Equal sets are one class from the start. Large groups of near copies are joined up before
the index is met: in each of STARS rounds a set has a few keys (the least hashes in ranges
of the hash space, which alike sets mostly share), and each of a key's members is a candidate
with the pivot nearest to it by parities, of those of other components. Links found are contracted.

Then the index. Most tokens are in one set only. So postings travel twice, packed, a block
for each task and range of tokens: first all, but only their tokens' low bits, sets, components
and places, to find the tokens that sets of unlike components share; then those of such tokens,
with the sets' lengths and folded parities. What travels of a posting doesn't go by the number
of ranges. A task that gets a range sorts it and meets, within each token, pairs of unlike components by length order,
as long as the lengths allow a link; a pair is a candidate where the places of the shared
token leave room for the overlap it needs, which holds at least at its first shared token.
No link between components is lost: links inside one component change nothing. Tokens
with many postings (GROUP) are cut into slices and each pair of slices is a group of its
own. Memory is bounded by RANGE postings and, within a token, by its number of sets.

Defined cases: null texts and texts without words have no shingles and no links; a
text with fewer words than a shingle is one shingle; rows of one doc_id are one
document's, linked with whatever one of them is linked with; rows without a doc_id have component null; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, settle, small_batches, tidy
from .components import components

WORDS, PERCENT = 3, 90
#: Tokens with a rank of their own, at most; tokens that a task counts at a time.
HEAVY, COUNTED = 1_000_000, 1_000_000
#: Rounds of pivots, keys of a set in each of them, least hashes in a key, pivots of a key.
STARS, KEYS, LEAST, PIVOTS = 2, 4, 2, 4
#: Postings of a range of tokens; of a token's slice; that a task packs at a time.
RANGE, GROUP, PACKED = 250_000, 4096, 100_000
#: Odd numbers by which tokens (hashes, well mixed) are multiplied; the orders go by the high bits of the products.
ORDERS = tuple(np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64))
#: Parities of a set's tokens, by the low bits of their hashes.
BITS = tuple(f"bits{k}" for k in range(8))
#: Fewer parities, for postings: each adds up some of those.
FOLDS = ("fold0", "fold1", "fold2")
#: Rows of an Arrow batch; a pair of texts is one.
PAIRS = 150
#: Up to so many ids (8 bytes each) are broadcast; more are joined by shuffling.
BROADCAST_IDS = 1_000_000


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    high = h >> np.uint64(30)
    h ^= high
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= np.right_shift(h, np.uint64(27), out=high)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= np.right_shift(h, np.uint64(31), out=high)
    return h


#: White space, as bytes.split() has it; a number for every byte; powers of an odd number, and of its inverse.
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\f"))
BYTE = mix(np.arange(256, dtype=np.uint64), 6)
LONGEST, PIECE = 64, 1 << 16
_ODD = 0x9E3779B97F4A7C13
POWER, INVERSE = (np.cumprod(np.array([1] + [x % 2**64] * (PIECE + LONGEST), np.uint64)) for x in (_ODD, pow(_ODD, -1, 2**64)))


class WordHash:
    """Hashes of a text's words. A word's is the sum of its bytes' numbers, each times the power of
    its place, so that all words are taken from one running sum; long words are hashed one by one."""

    def __call__(self, text: bytes) -> np.ndarray:
        chars = np.frombuffer(text, np.uint8)
        gap = np.ones(len(chars) + 2, bool)
        gap[1:-1] = SPACE[chars]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edge[::2], edge[1::2]
        long = np.flatnonzero(end - start > LONGEST)
        stop = np.minimum(end, start + LONGEST) if len(long) else end
        out = []
        for at in range(0, len(chars), PIECE):  # words that start in a piece of the text
            some = slice(*np.searchsorted(start, (at, at + PIECE))) if len(chars) > PIECE else slice(None)
            if not len(start[some]):
                continue
            total = np.zeros(min(PIECE + LONGEST, len(chars) - at) + 1, np.uint64)
            np.cumsum(BYTE[chars[at : at + PIECE + LONGEST]] * POWER[: len(total) - 1], out=total[1:])
            out.append((total[stop[some] - at] - total[start[some] - at]) * INVERSE[start[some] - at])
        h = np.concatenate(out) if out else np.empty(0, np.uint64)
        for k in long:
            h[k] = xxhash.xxh3_64_intdigest(text[start[k] : end[k]])
        return h


def shingles(text: str | None, words: WordHash, size: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    lower = (text or "").encode("utf-8", "surrogatepass").lower()
    h = words(lower)
    if not len(h):
        return h
    if len(h) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(lower.split()), seed=len(h))], np.uint64)
    out = h[: len(h) - size + 1]
    for k in range(1, size):
        out = mix(out, k) + h[k : len(h) - size + 1 + k]
    out = mix(out, size)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def _frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, sorted, and their count classes (quarter-steps of the logarithm)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, held, n = WordHash(), [], 0

        def counted() -> pd.DataFrame:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            some = times > 1
            return pd.DataFrame({"token": token[some].view(np.int64), "n": times[some]})

        for batch in batches:
            held += [shingles(t, words, size) for t in batch["text"]]
            n += sum(map(len, held[-len(batch) :])) if len(batch) else 0
            if n >= COUNTED:
                yield counted()
                held, n = [], 0
        if n:
            yield counted()

    total = docs.select("text").mapInPandas(tidy(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    total = cut(total.select("token", F.floor(4 * F.log2("n")).cast("int").alias("rank")), "jaccard-frequent")
    room, least = HEAVY, 1 << 30
    for r in total.groupBy("rank").count().orderBy(F.col("rank").desc()).collect():  # some hundred classes
        room -= r["count"]
        if room < 0:
            break
        least = r["rank"]
    top = total.filter(F.col("rank") >= least).toArrow()  # HEAVY rows at most
    discard(total)
    token, rank = (top[c].to_numpy().astype(np.int64) for c in ("token", "rank"))
    token = token.view(np.uint64)
    order = np.argsort(token)
    return token[order], np.minimum(rank[order] + 1, 255).astype(np.uint8)


#: High bits of a token by which most tokens that aren't frequent are told apart from those.
MARK = np.uint64(64 - 22)


def _marks(token: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 22, bool)
    out[token >> MARK] = True
    return out


def _rank(h: np.ndarray, token: np.ndarray, rank: np.ndarray, marks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), np.uint64)
    some = np.flatnonzero(marks[h >> MARK])
    if len(some):
        at = np.minimum(np.searchsorted(token, h[some]), len(token) - 1)
        out[some] = np.where(token[at] == h[some], rank[at], 0)
    return out


def _sets(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], size: int, percent: int) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set), p1 (prefix in the index order, packed), p2, p3 (of the others,
    32 bits a token), keys (of least hashes of ranges), bits (parities)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    kind = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("doc_id", "n", "d1", "d2")]
        + [T.StructField("p1", T.BinaryType())]
        + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("p2", "p3")]
        + [T.StructField("keys", T.ArrayType(T.LongType()))]
        + [T.StructField(c, T.LongType()) for c in BITS]
    )
    starts = np.array([k * (2**64 // (STARS * KEYS * LEAST)) for k in range(STARS * KEYS * LEAST)], np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, (token, ranks) = WordHash(), shared.value
        marks = _marks(token)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                h = shingles(text, words, size)
                n, rank = len(h), _rank(h, token, ranks, marks) << np.uint64(56)
                k = prefix_length(n, percent) if n else 0
                digest = xxhash.xxh3_128_intdigest(h.tobytes())
                own = []
                for order in ORDERS:
                    key = rank | (h * order >> np.uint64(8))
                    some = np.sort(np.argpartition(key, k - 1)[:k]) if 0 < k < n else np.arange(k)
                    own.append(h[some[np.argsort(key[some], kind="stable")] if order == ORDERS[0] else some])
                low = [x.astype(np.uint32).view(np.int32) for x in own[1:]]
                keys = np.empty(0, np.int64)
                if n:
                    least = h[np.searchsorted(h, starts) % n].reshape(-1, LEAST)
                    keys = reduce(lambda x, y: mix(x, 4) + y, least.T).view(np.int64)
                odd = np.bincount((h & np.uint64(64 * len(BITS) - 1)).astype(np.int64), minlength=64 * len(BITS)) & 1
                bits = np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()
                rows.append((doc_id, n, digest & (2**64 - 1), digest >> 64, own[0].tobytes(), *low, keys, *bits))
            frame = pd.DataFrame(rows, columns=kind.names)
            frame["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in batch["doc_id"]], dtype="Int64")
            for c in ("d1", "d2"):
                frame[c] = np.array([x - (x >> 63 << 64) for x in frame[c]], dtype=np.int64)
            yield frame

    return docs.select("doc_id", "text").mapInPandas(tidy(run), kind)


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether two sets can be alike enough by their parities: these differ in no more
    places than the sets do, and alike sets differ in few. ``x`` and ``y`` end column names."""
    apart = reduce(add, [F.bit_count(F.col(b + x).bitwiseXOR(F.col(b + y))) for b in BITS])
    return apart * (100 + percent) <= (F.col("n" + x) + F.col("n" + y)) * (100 - percent)


def _folds() -> list[Column]:
    """Parities in 64 places, as often as FOLDS has names: each of these takes some of the bits."""
    return [reduce(Column.bitwiseXOR, [F.col(b) for b in BITS[k :: len(FOLDS)]]).alias(name) for k, name in enumerate(FOLDS)]


def _few(df: DataFrame) -> DataFrame:
    """To be broadcast if its rows (a few numbers each) are few enough; ``df`` is written already, or small to compute."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _near(docs: DataFrame, sets: DataFrame, pairs: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """Of candidate pairs (a, b; b is the side that repeats): the links."""
    pairs = cut(pairs.distinct(), f"{name}-pairs")

    def both(pairs: DataFrame, columns: tuple[str, ...], key: tuple[str, ...], passes: Column, step: str) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        ids = F.broadcast(ids) if 2 * pairs.count() <= BROADCAST_IDS else ids
        some = sets.join(ids, "doc_id", "left_semi").select("doc_id", *columns, *[c for c in key if c not in columns]).dropDuplicates(["doc_id", *key])
        for side in ("a", "b"):
            pairs = pairs.join(some.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
        return cut(pairs.filter(passes).select("a", "b").distinct(), f"{name}-{step}")

    like = both(pairs, ("n", *BITS), ("n", *BITS), _may_link("_a", "_b", percent), "like")
    passed = both(like, ("p2", "p3"), ("n", *BITS), F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b"), "passed")
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")).join(_few(passed), "a")
    second = texts.join(_few(passed.select(F.col("b").alias("doc_id")).distinct()), "doc_id", "left_semi").select(F.col("doc_id").alias("b"), F.col("text").alias("y"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen, last = WordHash(), None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                p = shingles(x, words, size)
                if y != seen:
                    seen, last = y, shingles(y, words, size)
                common = len(np.intersect1d(p, last, assume_unique=True))
                keep.append(bool(common) and 100 * common >= percent * (len(p) + len(last) - common))
            yield batch.loc[keep, ["a", "b"]]

    settle(docs.sparkSession)
    links = cut(first.join(second, "b").select("a", "b", "x", "y").mapInPandas(tidy(verify), "a long, b long").distinct(), f"{name}-links")
    discard(pairs, like, passed)
    return links


def _star(heads: DataFrame, at: DataFrame | None, k: int, percent: int) -> DataFrame:
    """Candidates (a, pivot b) of round ``k``: for a member of a key the pivot nearest to it, of those
    of other components that it may be linked with; so there are KEYS of a member at most."""
    keyed = heads.select(F.col("doc_id").alias("id"), "n", *_folds(), F.explode(F.slice("keys", k * KEYS + 1, KEYS)).alias("key"))
    if at is not None:
        keyed = keyed.join(at.withColumnRenamed("node", "id"), "id", "left").select("id", "n", *FOLDS, "key", F.coalesce("component", "id").alias("comp"))
    else:
        keyed = keyed.withColumn("comp", F.col("id"))
    pivots = [F.min(F.struct(F.xxhash64("id", "key", F.lit(j)).alias("h"), "id", "n", *FOLDS, "comp")) for j in range(PIVOTS)]
    mixed = cut(keyed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key"), "jaccard-mixed")
    keyed = keyed.join(_few(mixed), "key", "left_semi")
    pivots = keyed.groupBy("key").agg(F.array_distinct(F.array(*pivots)).alias("p"))
    apart = " + ".join(f"bit_count({c} ^ x.{c})" for c in FOLDS)
    fits = "x -> x.comp <> comp AND 100 * least(n, x.n) >= {0} * greatest(n, x.n) AND ({1}) * (100 + {0}) <= (n + x.n) * (100 - {0})".format(percent, apart)
    nearest = F.expr(f"array_min(transform(filter(p, {fits}), x -> struct({apart} AS apart, x.h AS h, x.id AS id)))")
    return keyed.join(pivots, "key").select(F.col("id").alias("a"), nearest.alias("p")).filter("p IS NOT NULL").select("a", F.col("p.id").alias("b"))


#: Low bytes of a token that travel: equal tokens stay equal, and unlike ones that meet cost a candidate.
TOKEN = 5


def _pack(token: np.ndarray, wide: list[np.ndarray], rest: list[np.ndarray]) -> bytes:
    """Columns one after another: tokens by their low bytes, hashes, then small numbers by their bytes' places, which compresses to what they hold."""
    planes = [token.view(np.uint8).reshape(-1, 8)[:, :TOKEN].tobytes(), *[x.tobytes() for x in wide]]
    planes += [x.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for x in rest]
    return b"".join([np.array([len(token)], np.int64).tobytes(), *planes])


def _unpack(block: bytes, wide: int, rest: int) -> list[np.ndarray]:
    n = int(np.frombuffer(block, np.int64, 1)[0])
    token = np.zeros((n, 8), np.uint8)
    token[:, :TOKEN] = np.frombuffer(block, np.uint8, TOKEN * n, 8).reshape(n, TOKEN)
    at = 8 + TOKEN * n
    columns = [np.frombuffer(block, np.uint64, n, at + 8 * n * k) for k in range(wide)]
    columns += [np.ascontiguousarray(np.frombuffer(block, np.uint8, 8 * n, at + 8 * n * (wide + k)).reshape(8, n).T).view(np.int64).ravel() for k in range(rest)]
    return [token.view(np.uint64).ravel(), *columns]


def _blocks(held: list[list[np.ndarray]], wide: int, ranges: int) -> pd.DataFrame:
    """(range, block) of columns: a token, ``wide`` hashes, ids, small numbers. Ids go as differences, which are small where neighbours' ids are."""
    columns = [np.concatenate(x) for x in zip(*held, strict=True)]
    part = (mix(columns[0] & np.uint64(2 ** (8 * TOKEN) - 1), 5) % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    columns, part = [x[order] for x in columns], part[order]
    cuts = [0, *(np.nonzero(part[1:] != part[:-1])[0] + 1).tolist(), len(part)]
    rows = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        token, *rest = (x[a:b] for x in columns)
        rest[wide] = np.diff(rest[wide], prepend=0)
        rows.append((int(part[a]), _pack(token, rest[:wide], rest[wide:])))
    return pd.DataFrame(rows, columns=["range", "block"])


def _columns(blocks: pd.DataFrame, wide: int, rest: int) -> list[np.ndarray]:
    """What went into blocks."""
    held = []
    for block in blocks["block"]:
        columns = _unpack(block, wide, rest)
        columns[1 + wide] = np.cumsum(columns[1 + wide])
        held.append(columns)
    return [np.concatenate(x) for x in zip(*held, strict=True)]


def _hot(heads: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> dict[int, int]:
    """Slices of the tokens with more than GROUP postings: at most one for every GROUP of them."""
    token = frequent[0][frequent[1] > 4 * np.log2(GROUP)]
    if not len(token):
        return {}
    shared = heads.sparkSession.sparkContext.broadcast(token)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often, n = shared.value, np.zeros(len(shared.value), np.int64)
        for batch in batches:
            h = np.frombuffer(b"".join(batch["p1"]), np.uint64)
            at = np.minimum(np.searchsorted(often, h), len(often) - 1)
            n += np.bincount(at[often[at] == h], minlength=len(often))
        yield pd.DataFrame({"token": often[n > 0].view(np.int64), "n": n[n > 0]})

    total = heads.select("p1").mapInPandas(tidy(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > GROUP)
    return {r.token & (2**64 - 1): -(-r.n // GROUP) for r in total.collect()}


def _postings(heads: DataFrame, hot: dict[int, int], ranges: int) -> DataFrame:
    """(range, block) of the prefix tokens of (doc_id, comp, p1): token, id, component, place and side."""
    shared = heads.sparkSession.sparkContext.broadcast((np.array(sorted(hot), np.uint64), np.array([hot[t] for t in sorted(hot)], np.int64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot_token, slices = shared.value
        held, n = [], 0
        for batch in batches:
            if not len(batch):
                continue
            token = np.frombuffer(b"".join(batch["p1"]), np.uint64)
            size = batch["p1"].map(len).to_numpy() // 8
            ends = np.cumsum(size)
            place = np.arange(len(token)) - np.repeat(ends - size, size)
            own = [np.repeat(batch[c].to_numpy(), size) for c in ("doc_id", "comp")]
            own[1] = np.where(own[1] == own[0], 0, own[1] ^ own[0])  # mostly nothing, which compresses
            row = [token, *own, place, np.zeros(len(token), np.int64)]
            if len(hot_token):
                at = np.minimum(np.searchsorted(hot_token, token), len(hot_token) - 1)
                many = hot_token[at] == token
                times = np.where(many, slices[at], 1)
                index = np.repeat(np.arange(len(token)), times)
                other = np.arange(len(index)) - np.repeat(np.cumsum(times) - times, times)
                row, many, k = [x[index] for x in row], many[index], times[index]
                mine = (mix(row[1].astype(np.uint64), 3) % k.astype(np.uint64)).astype(np.int64)
                lo, hi = np.minimum(mine, other), np.maximum(mine, other)
                row[0] = np.where(many, mix(row[0] ^ mix((lo * k + hi).astype(np.uint64), 9), 9), row[0])
                row[-1] = np.where(many & (lo != hi), 1 + (mine == hi), 0)
            held.append(row)
            n += len(row[0])
            if n >= PACKED:
                yield _blocks(held, 0, ranges)
                held, n = [], 0
        if n:
            yield _blocks(held, 0, ranges)

    return heads.select("doc_id", "comp", "p1").mapInPandas(tidy(run), "range long, block binary")


def _shared(blocks: pd.DataFrame) -> pd.DataFrame:
    """Of a range, the postings of tokens that unlike components have."""
    token, ids, comp, place, side = _columns(blocks, 0, 4)
    order = np.argsort(token, kind="stable")
    order = order[_mixed(token[order], (comp ^ ids)[order])]
    return pd.DataFrame({"doc_id": ids[order], "token": token[order].view(np.int64), "place": place[order], "side": side[order]})


def _mixed(token: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Whether a token has unlike components, for sorted tokens."""
    start = np.nonzero(np.concatenate([[True], token[1:] != token[:-1]]))[0]
    size = np.diff(np.append(start, len(token)))
    return np.repeat(np.minimum.reduceat(comp, start) != np.maximum.reduceat(comp, start), size)


def _whole(postings: DataFrame, ranges: int) -> DataFrame:
    """(range, block) of postings with all columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            if not len(batch):
                continue
            ids, comp = batch["doc_id"].to_numpy(), batch["comp"].to_numpy()
            hashes = [batch[c].to_numpy().view(np.uint64) for c in ("token", *FOLDS)]
            held.append([*hashes, ids, np.where(comp == ids, 0, comp ^ ids), *[batch[c].to_numpy() for c in ("n", "place", "side")]])
            n += len(batch)
            if n >= PACKED:
                yield _blocks(held, len(FOLDS), ranges)
                held, n = [], 0
        if n:
            yield _blocks(held, len(FOLDS), ranges)

    return postings.select("doc_id", "token", "place", "side", "comp", "n", *FOLDS).mapInPandas(tidy(run), "range long, block binary")


def _meet(percent: int):
    """Candidates of a range: pairs of unlike components within a token."""

    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        token, *rest = _columns(blocks, len(FOLDS), 5)
        folds, (ids, comp, n, place, side) = rest[: len(FOLDS)], rest[len(FOLDS) :]
        comp = comp ^ ids
        order = np.lexsort((n, token))
        token, comp = token[order], comp[order]
        mixed = _mixed(token, comp)
        order, token, comp = order[mixed], token[mixed], comp[mixed]
        ids, n, place, side, *folds = (x[order] for x in (ids, n, place, side, *folds))
        found, alive, d = [], np.arange(len(token)), 0
        while len(alive):  # the d-th next of each, as long as it has the token and a length that can link
            d += 1
            alive = alive[alive + d < len(token)]
            alive = alive[(token[alive] == token[alive + d]) & (100 * n[alive] >= percent * n[alive + d])]
            i, j = alive, alive + d
            both = n[i] + n[j]
            need = -(-percent * both // (100 + percent))
            ok = (comp[i] != comp[j]) & (1 + np.minimum(n[i] - 1 - place[i], n[j] - 1 - place[j]) >= need)
            ok &= (side[i] != side[j]) | (side[i] == 0)
            i, j = i[ok], j[ok]
            apart = sum((np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in folds), np.zeros(len(i), np.int64))
            ok = apart * (100 + percent) <= both[ok] * (100 - percent)
            i, j = i[ok], j[ok]
            if len(i):
                found.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1))
                if sum(map(len, found)) > 2_000_000:
                    found = [np.unique(np.concatenate(found), axis=0)]
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pd.DataFrame(pairs, columns=["a", "b"])

    return run


def jaccard_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, name: str = "jaccard") -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) of every row."""
    small_batches(docs.sparkSession, PAIRS)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = _frequent(docs, size)
    sets = cut(_sets(docs, frequent, size, percent), f"{name}-sets")
    settle(docs.sparkSession)
    light = sets.select("doc_id", "n", "d1", "d2")
    known = light.filter("n > 0 AND doc_id IS NOT NULL")
    classes = cut(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")), f"{name}-classes")
    copies = known.join(_few(classes.filter("members > 1").select("d1", "d2", "rep")), ["d1", "d2"]).filter("doc_id <> rep").select("doc_id", "d1", "d2").distinct()
    copies = cut(copies, f"{name}-copies")
    heads = sets.filter("n > 0 AND doc_id IS NOT NULL").join(_few(copies), ["doc_id", "d1", "d2"], "left_anti")

    at, links = None, []
    for k in range(STARS):
        links.append(_near(docs, heads, _star(heads, at, k, percent), size, percent, f"{name}-star{k}"))
        at = _few(components(reduce(DataFrame.unionByName, links), f"{name}-stars"))
        settle(docs.sparkSession)

    comp = F.coalesce("component", "doc_id").alias("comp")
    placed = heads.join(at.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    total = heads.agg(F.sum(F.length("p1")).alias("n")).first()["n"] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _postings(placed.select("doc_id", comp, "p1"), _hot(heads, frequent), max(least, -(-total // (8 * RANGE))))
    postings = cut(blocks.groupBy("range").applyInPandas(_shared, "doc_id long, token long, place long, side long"), f"{name}-postings")
    del blocks
    settle(docs.sparkSession)
    whole = postings.join(placed.select("doc_id", comp, "n", *_folds()), "doc_id")
    blocks = _whole(whole, max(least, -(-postings.count() // RANGE)))
    met = blocks.groupBy("range").applyInPandas(_meet(percent), "a long, b long")
    links.append(_near(docs, heads, met, size, percent, f"{name}-index"))
    discard(postings)

    # Classes that hold rows of one doc_id are one document's: link them too.
    rows = known.join(classes, ["d1", "d2"]).select("doc_id", "rep")
    repeated = rows.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("doc_id")
    same = rows.join(repeated, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(reduce(DataFrame.unionByName, [*links, same]), f"{name}-components")
    discard(copies, *links)
    settle(docs.sparkSession)
    classes = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    rows = light.join(classes, ["d1", "d2"], "left")
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
