"""op5 by held-out accuracy, op10 against plain counts and normalisation."""

import math
import zlib
from collections import Counter

import numpy as np

from apisieve.llm import lbl, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_toxicity_table(spark):
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())


def test_toxicity_learns(spark):
    rng = np.random.default_rng(0)
    plain = [f"{a}{b}" for a in ("ther", "ion", "sta", "mel", "qua") for b in ("on", "ing", "ed", "es", "ly", "or")]
    bad = ["wretchedfool", "vilecreature", "rottenliar"]

    def doc(toxic):
        w = rng.choice(plain, rng.integers(20, 200)).tolist()
        for _ in range(3 * toxic):
            w.insert(int(rng.integers(0, len(w))), str(rng.choice(bad)))
        return " ".join(w)

    rows = [(doc(y), y) for y in (0, 1) for _ in range(300)]
    model = toxicity.train(rows)
    test = [(doc(y), y) for y in (0, 1) for _ in range(100)]
    df = spark.createDataFrame([(k, t, "x") for k, (t, _) in enumerate(test)] + [(900, None, "x"), (901, "", "x"), (902, "w" * 100_000, "x")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in toxicity.score_documents(df, model).collect()}
    right = sum(got[k].predicted == y for k, (_, y) in enumerate(test))
    assert right >= 190
    assert not any(got[k].predicted for k in (900, 901)) and got[900].score == got[901].score
    assert toxicity.score_documents(df, toxicity.train(rows[:5])).filter("predicted = 1").count() == 0
    assert toxicity.score_documents(df.limit(0), model).count() == 0


def test_toxicity_scores_as_plainly_computed(spark):
    """A score is what two compressors with the two contents give, window by window."""
    import zstandard

    rng = np.random.default_rng(5)
    plain = [f"{a}{b}" for a in ("ther", "ion", "sta", "mel") for b in ("on", "ing", "ed", "ly")]
    rows = [(" ".join([*rng.choice(plain, 40), *(["rottenliar"] if y else []), *rng.choice(plain, 9)]), y) for y in (0, 1) for _ in range(120)]
    model = toxicity.train(rows)
    raw = zstandard.DICT_TYPE_RAWCONTENT
    tools = [zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(c, dict_type=raw), write_content_size=False, write_dict_id=False, write_checksum=False) for c in (model.toxic + model.ordinary, model.ordinary)]
    texts = [rows[0][0], rows[200][0], "", None, "Rottenliar\n" * 500]
    got = {r.k: r.score for r in toxicity.score_documents(spark.createDataFrame(list(enumerate(texts)) + [(9, texts[0])], "k int, text string"), model).collect()}
    for k, text in enumerate(texts):
        words = (text or "").lower().split()
        pieces = [words[i : i + 10] for i in range(0, len(words), 10)] or [[]]
        saved = sorted((len(tools[1].compress(w)) - len(tools[0].compress(w)) for w in (f" {' '.join(p)} ".encode() for p in pieces)), reverse=True)
        x = [saved[0], sum(saved[:3]) / len(saved[:3]), sum(saved) / len(saved), sum(s >= 3 for s in saved) / len(saved), sum(s >= 4 for s in saved), saved[0] >= 5, saved[0] >= 6, math.log(len(saved)), math.log1p(sum(max(s - 2, 0) for s in saved))]
        z = model.weights[0] + sum((v - m) / d * w for v, m, d, w in zip(x, model.mean, model.spread, model.weights[1:], strict=True))
        assert abs(got[k] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
    assert got[9] == got[0] and got[2] == got[3]


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(lbl, "TOP", 300)  # most words go by the join
    monkeypatch.setattr(lbl, "PASSES", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs[:300]] + [(5000, None), (5001, ""), (None, "the of"), (0, docs[0].text)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    from apisieve.llm.common import crc_mod
    from pyspark.sql import functions as F

    got = lbl.score_documents(df, crc_mod(F.col("doc_id"), 10) != 0).collect()
    assert len(got) == len(rows)
    crc = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 10
    split = lambda t: (t or "").encode().lower().split() + [b"\n"]
    count = Counter()
    for d, t in rows:
        if crc(d):
            count.update(split(t))
    n, v = sum(count.values()), len(count)
    want = sorted(
        (
            str(d),
            crc(d) == 0,
            len(split(t)),
            sum(count[w] > 0 for w in split(t)),
            n,
            round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t)), 6),
        )
        for d, t in rows
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def plain_score(model, counts, text):
    """log10 probability of a text, one token at a time."""
    words = (text or "").encode().lower().split()
    first = len(model.p["r"]) - lbl.CLASSES - 1
    own = {w: k for k, w in enumerate(model.words)}

    def cls(w):
        if own.get(w, lbl.OWN) < lbl.OWN:
            return own[w]
        tail = w[-3:]
        return lbl.END + 1 + (model.endings[tail] if tail in model.endings else lbl.SUFFIXES + zlib.crc32(tail) % lbl.HASHED)

    codes = [own[w] if own.get(w, first) < first else first + cls(w) for w in words]
    r, q, b, a = (model.p[k].astype(np.float64) for k in "rqba")
    total = 0.0
    for t in range(len(words) + 1):
        one, two = (r[codes[t - k]] if t >= k else r[-1] for k in (1, 2))
        bag = sum((r[c] for c in codes[max(0, t - lbl.WINDOW) : t]), np.zeros(lbl.DIM)) / math.sqrt(lbl.WINDOW)
        s = q @ (a[0] * one + a[1] * two + a[2] * bag) + b
        c = cls(words[t]) if t < len(words) else lbl.END
        p = math.exp(s[c]) / np.exp(s).sum()
        total += math.log10(p)
        if t < len(words) and c > lbl.END:
            members = [x for x in counts if cls(x) == c]
            total += math.log10((counts.get(words[t], 0) + 0.1) / (sum(counts[x] for x in members) + 0.1 * (len(members) + 1)))
    return total


def test_scores_as_plainly_evaluated(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(lbl, "TOP", 300)
    monkeypatch.setattr(lbl, "PASSES", 1)
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(120).collect()]
    texts = [*docs[:100], None, "", "neverseen the xyzzy", "word " * 3000]
    df = spark.createDataFrame([(k, t or "", k < 80) for k, t in enumerate(texts)], "doc_id long, text string, trains boolean")
    counts = lbl.count_words(df.filter("trains")).cache()
    model = lbl.fit(df.filter("trains"), counts)
    plain = {bytes(r.word): r.n for r in counts.collect()}
    got = {r.doc_id: r for r in lbl.apply_model(df, model, counts).collect()}
    assert len(got) == len(texts)
    for k in (0, 3, 85, 100, 101, 102, 103):
        want = plain_score(model, plain, texts[k])
        assert abs(got[k].score - want) <= 1e-4 * abs(want) + 1e-3, k
    nothing = lbl.score_documents(df, F.lit(False)).collect()
    assert len(nothing) == len(texts) and all(r.train_tokens == 0 and r.score < 0 for r in nothing)
    assert lbl.score_documents(df.limit(0), F.col("doc_id") > 1).count() == 0


def test_training_learns_what_follows(monkeypatch):
    """After one word comes another; noise in between."""
    rng = np.random.default_rng(1)
    words = [b"w%02d" % k for k in range(40)]
    texts = []
    for _ in range(800):
        w = [words[int(k)] for k in rng.integers(0, 40, 30)]
        for at in range(0, 28, 3):
            w[at + 1] = words[(int(w[at][1:]) + 7) % 40]
        texts.append(w)
    mass = np.ones(lbl.CLASSES)
    mass[:40] = 500
    noise = mass / mass.sum()
    model = lbl.Model(words, np.full(40, 500), {}, np.zeros(lbl.CLASSES), noise, 800, 1, 1, lbl.initial(40, noise))
    trainer = lbl.Trainer(model.p, noise, [1])
    sequence = lbl.encode(texts, lbl.Codes(model))
    code, target, start, _ = sequence
    at = np.arange(2000)

    def likely(p):
        logs = lbl.log_classes(p, code, start, 0, 2000)
        assert np.allclose(np.exp(logs).sum(1), 1, atol=1e-4)
        return logs[at, target[:2000]].mean()

    before = likely(model.p)
    for _ in range(6):
        trainer.run(*sequence)
    assert likely(trainer.p) > before + 0.3
    same = lbl.averaged(model.p, trainer.weighted().astype(np.float64) * 2)
    assert all(np.allclose(same[k], trainer.p[k], rtol=1e-3, atol=1e-4) for k in same)
