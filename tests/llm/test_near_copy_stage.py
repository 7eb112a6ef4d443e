"""The pipeline's near-copy stage against brute force at five words and 0.8."""

import random

import corpus_pipeline

from .conftest import SF
from .test_near import roots


def kept_by_brute_force(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(ids, links)
    return [d for d in ids if root[d] == d]


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_copies_small(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**9)}"
    base = [word() for _ in range(100)]
    changed, longer, other = list(base), [*base, *[word() for _ in range(15)]], [word() for _ in range(100)]
    changed[30], changed[60] = word(), word()
    rows = [(1, " ".join(base)), (2, " ".join(changed)), (3, " ".join(longer)), (4, " ".join(other)), (5, None), (6, "")]
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, documents(spark, rows), SF).collect())
    assert got == kept_by_brute_force(rows) == [1, 4, 5, 6]


def test_near_copies_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = kept_by_brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == want


def test_repeated_ids_with_different_texts(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(4)]
    near = texts[0] + " more"
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[1]), (3, near), (9, texts[1]), (9, texts[2]), (8, texts[3]), (None, texts[0]), (5, None), (5, "")]
    got = corpus_pipeline.drop_near_copies(spark, documents(spark, rows), SF).collect()
    want = [(3, near), (5, ""), (5, None), (7, texts[1]), (8, texts[3]), (9, texts[2]), (None, texts[0])]
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(d), str(t)) for d, t in want)
