"""The pipeline's stages, each against a plain reading of what it should keep."""

import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline
from apisieve.llm import pii, queries

from .conftest import SF
from .test_near_copy_stage import kept_by_brute_force


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], SF).cache())
    whole, clean, single, redacted, packed = steps
    assert all(s.columns == list(corpus_pipeline.DOCUMENT) for s in (clean, single, redacted))
    scores = {r.doc_id: r.predicted for r in queries.op5_toxicity(spark, SF).collect()}
    assert {r.doc_id for r in clean.collect()} == {d for d, p in scores.items() if not p}
    assert sorted(r.doc_id for r in single.collect()) == kept_by_brute_force([(r.doc_id, r.text) for r in clean.collect()])
    texts = {r.doc_id: r.text for r in single.collect()}
    for r in redacted.collect():
        assert r.text == pii.redact_text(texts[r.doc_id], pii.joined([s for x in pii.all_spans(texts[r.doc_id]) for s in x])) and r.n_chars == len(r.text)
    tok = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in packed.collect():
        pieces[r.doc_id].append(r)
    for r in redacted.collect():
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 0]
        assert sum(p.length for p in pieces[r.doc_id]) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in pieces[r.doc_id])


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows, a very long text and an empty table through every stage."""
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", len(long)), (3, long, "en", "s", len(long)), (None, "call +49 170 5551234 now", "en", "s", 24), (4, "mail a@example.com", None, "s", 18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.count() == len(rows)
    single = corpus_pipeline.drop_near_copies(spark, clean, SF)
    assert sorted(str(r.doc_id) for r in single.collect()) == ["1", "2", "3", "4", "None"]
    redacted = corpus_pipeline.redact_pii(spark, single, SF)
    texts = {r.doc_id: r.text for r in redacted.collect()}
    assert texts[3] == long and "example" not in texts[4] and "5551234" not in texts[None]
    packed = corpus_pipeline.pack(spark, redacted, SF).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, 4, None}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
