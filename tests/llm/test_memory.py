"""What the join over documents leaves behind."""

import time
from types import SimpleNamespace

import numpy as np
import pandas as pd

from apisieve.llm import ngram_join, packing, queries


def test_join_workers_give_back_kept_chunks():
    """A worker that has packed before: its store of chunks goes when it makes sets."""
    session = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))
    docs = SimpleNamespace(sparkSession=session, mapInPandas=lambda run, kind: run)
    docs.select = lambda *columns: docs
    run = ngram_join._sets(docs, (np.empty(0, np.uint64), np.empty(0, np.uint8)), 3, 90)
    packing.chunks_of(queries.tokenizer("byte_bpe_50k.json"), queries.pattern(), 1000).ids("some words")
    assert packing.chunks_of.cache_info().currsize == 1
    (out,) = run(iter([pd.DataFrame({"doc_id": [1], "text": ["a b c d"]})]))
    assert out["n"].tolist() == [2] and packing.chunks_of.cache_info().currsize == 0


def test_join_lets_go_of_broadcast_tables(spark):
    used = lambda: spark._jsc.sc().env().memoryManager().storageMemoryUsed()
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    docs = spark.createDataFrame([(k, f"{base} {base.upper()}{k // 2} {k % 5}") for k in range(40)], "doc_id long, text string")
    spark._jvm.System.gc()
    time.sleep(2)
    before = used()
    ngram_join.jaccard_components(docs)
    time.sleep(2)
    assert used() - before < 4 * 2**20
