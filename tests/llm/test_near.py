"""op4 and op9 against brute force, and the shared connected components."""

import random

import numpy as np

from apisieve.llm import lattice, ngram_join, queries
from apisieve.llm.components import components

from .conftest import SF


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7), (300, 299)]
    nodes = {x for ab in links for x in ab}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(nodes, links)
    assert all(got.get(n, n) == c for n, c in want.items())


def brute_vectors(rows):
    units = {}
    for k, (_, v, label) in enumerate(rows):
        if v is None or label is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = np.array(v, dtype=np.float64)
        units[k] = (label, v / np.linalg.norm(v))
    links = []
    keys = sorted(units)
    for n, i in enumerate(keys):
        for j in keys[n + 1 :]:
            (a, x), (b, y) = units[i], units[j]
            if a == b and len(x) == len(y) and float(x @ y) >= 0.93:
                links.append((i, j))
    return links


def check_vectors(got, rows):
    links = brute_vectors(rows)
    deg = [0] * len(rows)
    for i, j in links:
        deg[i] += 1
        deg[j] += 1
    want = roots([r[0] for r in rows], [(rows[i][0], rows[j][0]) for i, j in links])
    by_id = {r.vec_id: r for r in got}
    for k, (vec_id, *_rest) in enumerate(rows):
        r = by_id[vec_id]
        assert (r.n_links, r.component_id, r.kept) == (deg[k], want[vec_id], want[vec_id] == vec_id), (vec_id, r, deg[k])


def test_vectors_small(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    rows = [(k, (centre + rng.standard_normal(16) * 0.05).tolist(), 1) for k in range(60)]
    rows += [(100 + k, rng.standard_normal(16).tolist(), k % 3) for k in range(60)]
    rows += [(200 + k, rows[5][1], 1) for k in range(4)] + [(210, rows[5][1], 2), (211, rows[5][1], None)]
    rows += [(220, None, 1), (221, [0.0] * 16, 1), (222, [float("nan")] * 16, 1), (223, [None] * 16, 1), (224, [], 1), (225, rows[5][1][:8], 1)]
    monkeypatch.setattr(lattice, "CELL_ROWS", 20)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label long, unit string")
    got = lattice.near_vectors(df).collect()
    assert len(got) == len(rows)
    check_vectors(got, rows)
    assert lattice.near_vectors(df.limit(0)).count() == 0


def test_null_ids_link_others(spark):
    rng = np.random.default_rng(6)
    x, step = rng.standard_normal(32), rng.standard_normal(32)
    x, step = x / np.linalg.norm(x), step - (step @ x) * x / (x @ x)
    step /= np.linalg.norm(step)
    turned = lambda t: (np.cos(t) * x + np.sin(t) * step).tolist()
    rows = [(5, turned(0.0), 1), (None, turned(0.3), 1), (9, turned(0.6), 1), (9, turned(0.6), 1), (None, turned(2.5), 1)]
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == [("5", 1, 5), ("9", 2, 5), ("9", 2, 5), ("None", 0, None), ("None", 3, 5)]


def near_pairs(n, dim, cosine, rng):
    u, v = rng.standard_normal((2, n, dim))
    u /= np.linalg.norm(u, axis=1)[:, None]
    v -= (v * u).sum(1)[:, None] * u
    v /= np.linalg.norm(v, axis=1)[:, None]
    return u, cosine * u + np.sqrt(1 - cosine**2) * v


def test_recall_and_pairs_met():
    """Pairs just at the threshold meet in some cell, and unlike ones rarely, for all lengths and plans."""
    rng = np.random.default_rng(7)
    for dim in (16, 64, 384, 768):
        for plan in lattice.PLANS[:4]:
            u, v = near_pairs(400, dim, 0.93, rng)
            a, b = (lattice.cells(x, np.ones(len(x), np.int64), plan) for x in (u, v))
            met = np.zeros(len(u), bool)
            for t in range(plan.tables):
                met |= lattice._meet(a[:, t, 0], a[:, t, 1:], b[:, t, 0], b[:, t, 1:])
            assert met.mean() >= 0.9, (dim, plan, met.mean())
    shares = []
    for n, plan in ((20_000, lattice.PLANS[0]), (40_000, lattice.PLANS[1])):
        u, _ = near_pairs(n, 64, 0.93, rng)
        keys = lattice.cells(u, np.ones(n, np.int64), plan)
        own, times = np.unique(keys[:, :, 0], return_counts=True)
        at = np.minimum(np.searchsorted(own, keys.ravel()), len(own) - 1)
        shares.append(times[at][own[at] == keys.ravel()].sum() / n)
    assert max(shares) < 500 and shares[1] < shares[0]


def test_vectors_with_links(spark):
    """Clusters of near copies among unlike vectors: most links found, none that isn't one."""
    rng = np.random.default_rng(8)
    rows = []
    for dim, first in ((16, 0), (64, 10_000), (384, 20_000)):
        centres = rng.standard_normal((60, dim))
        for k in range(300):
            v = centres[k % 60] + rng.standard_normal(dim) * 0.18
            rows.append((first + k, v.tolist(), k % 3 if k < 200 else 0))
    links = brute_vectors(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = {r.vec_id: r.n_links for r in lattice.near_vectors(df).collect()}
    want = {r[0]: 0 for r in rows}
    for i, j in links:
        want[rows[i][0]] += 1
        want[rows[j][0]] += 1
    assert len(links) > 100 and len(got) == len(rows)
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.95 * 2 * len(links)


def test_vectors_table(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_vectors(queries.op4_lattice(spark, SF).collect(), rows)


def words_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def check_documents(got, rows):
    sets = {d: words_of(t) for d, t in rows}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = roots(ids, links)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(sets[d]), want[d]) for d in ids}
    return links


def test_documents_small(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(500)]
    shared = rng.choices(vocabulary, k=60)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a"), (4, "A"), (5, "a b"), (6, "b a"), (7, "x y z"), (8, "X\ty\nz")]
    base = rng.choices(vocabulary, k=200)
    for k in range(60):  # a chain and a crowd of near copies, not all of which are alike
        edited = list(base)
        for _ in range(rng.randint(0, 7)):
            edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
        rows.append((100 + k, " ".join(edited)))
    for k in range(60):  # a shared passage alone links nothing
        rows.append((300 + k, " ".join(rng.choices(vocabulary, k=rng.randint(5, 200)) + shared)))
    rows += [(400 + k, rows[20][1].upper()) for k in range(5)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    links = check_documents(ngram_join.jaccard_components(df).collect(), rows)
    assert len(links) > 100
    odd = ngram_join.jaccard_components(df.unionByName(df).unionByName(spark.createDataFrame([(None, "x y z", 1)], df.schema))).collect()
    assert len(odd) == 2 * len(rows) + 1 and [r.component_id for r in odd if r.doc_id is None] == [None]
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0


def test_documents_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_documents(queries.op9_ngram_join(spark, SF).collect(), rows)
