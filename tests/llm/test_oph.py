"""op7 against a plain reading of its contract."""

import hashlib
import random

from apisieve.llm import oph

from .conftest import SF


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    for k, (d, text) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        yield d, text, nxt, edited


def check(got, rows, spread=0.2):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.edited_sha256, round(r.near_next)), r) for r in got)
    want = sorted(((d is None, d or 0, hashlib.sha256(e.encode()).hexdigest(), round(jaccard(t, n))), (t, n, e)) for d, t, n, e in expected(rows))
    assert [g[0][:3] for g in got] == [w[0][:3] for w in want]
    off = []
    for (_, r), (_, (t, n, e)) in zip(got, want, strict=True):
        assert r.n_chars == len(t)
        off += [abs(r.near_edited - jaccard(t, e)), abs(r.near_next - jaccard(t, n))]
        assert max(off) < spread, (r.doc_id, t[:60], e[:60], n[:60], r.near_edited, jaccard(t, e), r.near_next, jaccard(t, n))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert max(off) < spread and sum(off) / len(off) < 0.03, (max(off), sum(off) / len(off))


def test_small_cases(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    rows = [(0, ""), (1, "a"), (1, "a"), (2, "one two three four five"), (7, "  x \n y "), (9, " ".join(words)), (10, " ".join(words[:290])), (None, "null id"), (3, "🙂é " * 40), (5, None), (5, "")]
    rows += [(20 + k, " ".join(rng.choices(words, k=rng.randint(1, 400)))) for k in range(40)]
    monkeypatch.setattr(oph, "ROWS_A_BUCKET", 5)
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, fp string")
    got = oph.fingerprint_neighbours(df).collect()
    check(got, [(d, t or "") for d, t in rows], 0.35)
    prints = {}
    for r in got:
        prints.setdefault(r.doc_id, r.fingerprint)
    assert prints[0] == "" and len(prints[9]) == 2 * oph.BINS
    assert oph.fingerprint_neighbours(df.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = oph.fingerprint_neighbours(docs).collect()
    check(got, [(r.doc_id, r.text or "") for r in docs.collect()])


def test_chain_over_gaps_and_groups(spark, monkeypatch):
    """Ids in far clumps: buckets and groups of buckets with nothing between them."""
    monkeypatch.setattr(oph, "ROWS_A_BUCKET", 2)
    rows = [(base + k, f"text {base} {k}") for base in (-5000, 0, 7, 1000, 90000) for k in range(9)] + [(None, "none"), (90008, "again")]
    got = oph.fingerprint_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(d, hashlib.sha256(e.encode()).hexdigest()) for d, _, _, e in expected(rows)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=key) == sorted(want, key=key)


def test_very_long_text(spark):
    rows = [(1, "word " * 200_000), (2, "x" * 300_000), (3, "a b c d e f")]
    got = {r.doc_id: r for r in oph.fingerprint_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {d: hashlib.sha256(e.encode()).hexdigest() for d, _, _, e in expected(rows)}
    assert {d: r.edited_sha256 for d, r in got.items()} == want and got[1].n_chars == 1_000_000
