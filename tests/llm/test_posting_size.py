"""What the join's index and its rounds of pivots move."""

import random
import zlib
from types import SimpleNamespace

import numpy as np
import pandas as pd

from apisieve.llm import ngram_join


def moved(ranges):
    """Bytes that the postings of 3000 sets take, packed and compressed."""
    rng = np.random.default_rng(5)
    batch = pd.DataFrame({"doc_id": np.arange(3000), "comp": np.arange(3000), "n": rng.integers(100, 900, 3000)})
    batch["p1"] = [rng.integers(0, 2**63, 60, dtype=np.uint64).tobytes() for _ in range(3000)]
    for c in ngram_join.FOLDS:
        batch[c] = rng.integers(-(2**63), 2**63, 3000)
    session = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))
    heads = SimpleNamespace(sparkSession=session, mapInPandas=lambda run, kind: run)
    heads.select = lambda *columns: heads
    frames = list(ngram_join._postings(heads, {}, ranges)(iter([batch])))
    return sum(len(zlib.compress(b, 1)) for f in frames for b in f["block"])


def test_a_posting_takes_as_much_with_more_ranges():
    assert moved(300) < 1.5 * moved(12)


def test_candidates_of_a_group_grow_with_its_members(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    base = [word() for _ in range(200)]

    def met(n):
        rows = []
        for k in range(n):
            edited = list(base)
            edited[rng.randrange(200)] = word()
            rows.append((k, " ".join(edited)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        sets = ngram_join._sets(docs, (np.zeros(1, np.uint64), np.zeros(1, np.uint8)), 5, 80)
        return ngram_join._star(sets, None, 0, 80).count()

    assert met(150) <= ngram_join.KEYS * 150
    assert met(300) <= ngram_join.KEYS * 300
