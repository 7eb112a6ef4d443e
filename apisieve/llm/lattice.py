"""Embedding near-duplicates by lattice hashing.

In each of several tables a random projection takes a unit vector to some blocks of 8
dimensions, scaled so that coordinates spread alike whatever the vectors' length, and each
block is decoded to the nearest point of the E8 lattice; the points, the label and the
table make the cell. A vector is stored in its own cell and probes neighbouring ones:
those of its next-nearest lattice points. Pairs that meet in a cell, at least one of them
stored there, are verified by cosine in double precision.

Blocks, scale, probes and tables (a plan) are the same for every table, whatever its size, so
whether a pair is found goes by its two vectors alone. Under each of PLANS pairs at the
threshold meet with a probability of about 0.97 (simulated; measured at several lengths in the
tests); those of smaller cells and more tables suit more vectors. PLAN is that for millions:
fewer cost more cells than they need, more meet some hundred unlike ones each and then more.

Links are counted, not listed. A pair may meet in several cells, so each task counts it
only if its cell is the first of them, which both vectors' cell lists tell. A task gives
each vector's number of links there and a spanning forest of them, so a group of n near
copies leaves n - 1 links. Equal vectors (of one label) are one class from the start.
Cells of over CELL_ROWS classes are cut into slices, and each pair of slices is a task's
work of its own, so a hot cell is spread and memory stays bounded.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and
rows whose label is null, have no links and are their own component; vectors of other
lengths never link; repeated vec_ids count as rows; null vec_ids stay, and link others,
with component null if they are alone; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

THRESHOLD = 0.93
SEED = 20240


@dataclass(frozen=True)
class Plan:
    """Up to how many vectors it suits, and its blocks, scale, probes and tables."""

    most: float
    blocks: int
    scale: float
    probes: int
    tables: int


PLANS = (Plan(2e4, 1, 0.78, 3, 6), Plan(1.5e5, 2, 0.5, 3, 8), Plan(6e5, 2, 0.6, 7, 9), Plan(5e6, 3, 0.5, 7, 15), Plan(float("inf"), 4, 0.5, 7, 36))
#: The plan that ``near_vectors`` takes at any size.
PLAN = PLANS[3]
CELL_ROWS = 1024
#: Up to so many cells (12 bytes each) are broadcast; more are joined by shuffling.
BROADCAST_CELLS = 500_000


def _d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest points of D8 and their squared distances; x is (..., 8)."""
    r = np.rint(x)
    err = x - r
    k = np.abs(err).argmax(-1)[..., None]
    at = np.take_along_axis(err, k, -1)
    step = np.where(at >= 0, 1.0, -1.0)
    odd = (r.sum(-1, keepdims=True) % 2) != 0
    np.put_along_axis(r, k, np.where(odd, np.take_along_axis(r, k, -1) + step, np.take_along_axis(r, k, -1)), -1)
    return r, ((x - r) ** 2).sum(-1)


#: E8's 240 shortest vectors, in doubled coordinates; from their rule, not a list.
def _roots() -> np.ndarray:
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-2, 2):
                for b in (-2, 2):
                    v = [0] * 8
                    v[i], v[j] = a, b
                    out.append(v)
    out += [[1 if m >> k & 1 else -1 for k in range(8)] for m in range(256) if bin(m).count("1") % 2 == 0]
    return np.array(out)


def e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points, in doubled (whole) coordinates."""
    a, da = _d8(x)
    b, db = _d8(x - 0.5)
    return np.rint(2 * np.where((da <= db)[..., None], a, b + 0.5)).astype(np.int64)


def cells(unit: np.ndarray, label: np.ndarray, plan: Plan = PLANS[0]) -> np.ndarray:
    """(n, tables, 1 + probes) cell keys: the own cell first, then neighbours by distance."""
    n, dim = unit.shape
    rng = np.random.default_rng([SEED, dim, plan.blocks])
    weights = rng.integers(1, 2**62, size=(plan.blocks, 8)).astype(np.int64) | 1
    roots = _roots()
    moves = (roots[None, :, :] * weights[:, None, :]).sum(-1).reshape(-1)
    out = np.empty((n, plan.tables, 1 + plan.probes), np.int64)
    for t in range(plan.tables):
        x = (unit @ (rng.standard_normal((dim, 8 * plan.blocks)) * plan.scale)).reshape(n, plan.blocks, 8)
        own = e8(x)
        salt = np.int64(rng.integers(1, 2**62))
        key = (own * weights).sum((1, 2)) + salt * (label.astype(np.int64) + 1) + np.int64(t * 7919 + dim)
        out[:, t, 0] = key
        # a move by a root changes the squared distance by |root|^2 - 2 <x - own, root> = 2 - <2 (x - own), root>
        away = 2 - ((2 * x - own).reshape(-1, 8) @ roots.T.astype(np.float64)) / 2
        away = away.reshape(n, -1)
        near = np.argsort(away, axis=1, kind="stable")[:, : plan.probes]
        out[:, t, 1:] = key[:, None] + moves[near]
    return out ^ (out >> np.int64(29))


def _unit(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(1))[:, None]


def _signatures(plan: Plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["vector"].map(len)):
                for k in range(0, len(part), 4096):
                    some = part.iloc[k : k + 4096]
                    unit = _unit(list(some["vector"]))
                    keys = cells(unit, some["label"].to_numpy(), plan)
                    yield pd.DataFrame(
                        {
                            "class": some["class"].to_numpy(),
                            "members": some["members"].to_numpy(),
                            "keys": [x.reshape(-1) for x in keys],
                            "unit": [x.tobytes() for x in unit],
                        }
                    )

    return run


def _meet(own_i, probe_i, own_j, probe_j):
    """Whether pairs meet in one table: own cells equal, or one probes the other's."""
    return (own_i == own_j) | (probe_i == own_j[:, None]).any(1) | (probe_j == own_i[:, None]).any(1)


def _links_in_cell(cell: int, part: dict[str, np.ndarray], threshold: float):
    """(class, links) and forest of the pairs that this cell is the first to hold."""
    unit, keys, stored, side, members = part["unit"], part["keys"], part["stored"], part["side"], part["members"]
    n = len(unit)
    found = []
    for k in range(0, n, 512):
        i, j = np.nonzero(unit[k : k + 512] @ unit.T >= threshold)
        i += k
        ok = (i < j) & (stored[i] | stored[j])
        if part["cross"]:
            ok &= side[i] != side[j]
        found.append((i[ok], j[ok]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(i):
        return None
    table = int(part["table"][0])
    keep = np.ones(len(i), bool)
    for t in range(table):
        keep &= ~_meet(keys[i, t, 0], keys[i, t, 1:], keys[j, t, 0], keys[j, t, 1:])
    a, b = keys[i, table, 0], keys[j, table, 0]
    here = np.int64(cell)
    both = (keys[i, table, 1:] == b[:, None]).any(1) & (keys[j, table, 1:] == a[:, None]).any(1) & (a != b)
    keep &= np.where(both, np.minimum(a, b) == here, True)
    i, j = i[keep], j[keep]
    if not len(i):
        return None
    count = np.bincount(i, members[j], n) + np.bincount(j, members[i], n)
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return count.astype(np.int64), label


def _compare(threshold: float, tables: int, probes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(rows: pd.DataFrame) -> pd.DataFrame | None:
            if len(rows) < 2:
                return None
            unit = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(len(rows), -1)
            part = {
                "unit": unit,
                "keys": np.stack(rows["keys"].to_list()).reshape(len(rows), tables, 1 + probes),
                "stored": rows["stored"].to_numpy(),
                "side": rows["side"].to_numpy(),
                "members": rows["members"].to_numpy(),
                "table": rows["tab"].to_numpy(),
                "cross": rows["lo"].iloc[0] != rows["hi"].iloc[0],
            }
            got = _links_in_cell(rows["cell"].iloc[0], part, threshold)
            if got is None:
                return None
            count, label = got
            ids = rows["class"].to_numpy()
            some = count > 0
            return pd.DataFrame({"class": ids[some], "links": count[some], "to": ids[label[some]]})

        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            key = batch[["cell", "lo", "hi"]].to_numpy()
            bounds = [0, *(np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1).tolist(), len(batch)]
            out = []
            for a, b in zip(bounds, bounds[1:], strict=False):
                now = tuple(key[a])
                if last is not None and now != last:
                    out.append(flush(pd.concat(held) if len(held) > 1 else held[0]))
                    held = []
                last = now
                held.append(batch.iloc[a:b])
            out = [x for x in out if x is not None]
            if out:
                yield pd.concat(out)
        if held:
            got = flush(pd.concat(held))
            if got is not None:
                yield got

    return run


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, name: str = "lattice", plan: Plan = PLAN) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    value = F.col("embedding")
    sound = F.col("label").isNotNull() & value.isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(value, lambda x: x != 0)
    rows = rows.select("vec_id", value.cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    vector = F.when(F.coalesce(sound, F.lit(False)), value)
    digest = [F.xxhash64("label", "vector"), F.xxhash64(F.lit(1), "vector", "label")]
    rows = rows.select("vec_id", "label", vector.alias("vector")).select("vec_id", "label", "vector", digest[0].alias("h1"), digest[1].alias("h2"))
    good = rows.filter("vector IS NOT NULL")
    classes = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("members"), F.first("vector").alias("vector"), F.first("label").alias("label"))
    classes = classes.withColumn("vector", F.coalesce("vector", F.array()))
    # A class goes by a number: unlike vec_ids it is never null or repeated. It is written once.
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()), f"{name}-classes")
    kind = "class long, members long, keys array<long>, unit binary"
    signed = cut(classes.filter(F.size("vector") > 0).select("class", "members", "label", "vector").mapInPandas(_signatures(plan), kind), f"{name}-signed")

    spots = signed.select("*", F.posexplode("keys").alias("spot", "cell")).withColumns(
        {"tab": F.floor(F.col("spot") / (1 + plan.probes)).cast("int"), "stored": F.col("spot") % (1 + plan.probes) == 0}
    )
    cells_ = spots.select("cell", "stored").groupBy("cell").agg(F.count("*").alias("n"), F.max("stored").alias("any"))
    cells_ = cells_.filter("n > 1 AND any").select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("slices"))
    cells_ = cut(cells_, f"{name}-cells")
    spots = spots.join(F.broadcast(cells_) if cells_.count() <= BROADCAST_CELLS else cells_, "cell")
    spots = spots.withColumn("side", F.pmod(F.xxhash64("class", F.lit(7)), F.col("slices")).cast("int"))
    spots = spots.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    spots = spots.withColumns({"lo": F.least("side", "other").cast("long"), "hi": F.greatest("side", "other").cast("long")})
    dealt = spots.select("cell", "lo", "hi", "tab", "stored", "side", "class", "members", "keys", "unit").repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    found = cut(dealt.mapInPandas(_compare(threshold, plan.tables, plan.probes), "class long, links long, to long"), f"{name}-found")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    at = components(found.filter("class <> to").select(F.col("class").alias("a"), F.col("to").alias("b")), name).withColumnRenamed("node", "class")
    classes = classes.drop("vector", "label").join(links, "class", "left").join(at, "class", "left")
    least = classes.filter("component IS NOT NULL OR links IS NOT NULL").groupBy(F.coalesce("component", "class").alias("root")).agg(F.min("least").alias("first"))
    classes = classes.withColumn("root", F.coalesce("component", "class")).join(least, "root", "left")
    classes = classes.select("h1", "h2", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("first", "least").alias("component_id"))
    keys = rows.select("vec_id", F.when(F.col("vector").isNotNull(), F.col("h1")).alias("h1"), "h2")
    done = keys.join(classes, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
