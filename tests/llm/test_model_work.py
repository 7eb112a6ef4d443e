"""op10: work done once, for words that are not in the model's list and for a worker's tasks."""

import numpy as np
from pyspark.sql import functions as F

from apisieve.llm import lbl


def model_of(words, scale=1.0):
    noise = np.full(lbl.CLASSES, 1 / lbl.CLASSES)
    p = {k: x * np.float32(scale if k in "rq" else 1) for k, x in lbl.initial(len(words), noise).items()}
    return lbl.Model(words, np.full(len(words), 20), {b"ing": 0, b"x": 1}, np.zeros(lbl.CLASSES), noise, 5, 100, 9, p)


def test_words_beyond_the_list_are_not_kept():
    model = model_of([b"the", b"of"])
    texts = [[b"the", b"going", b"x", b"zzzqqq"], [], [b"w%d" % k for k in range(1000)], [b"of"]]
    codes = lbl.Codes(model)
    at, start, end = lbl.places(texts, codes)
    tail = lambda w: len(model.words) + lbl.ending_class(w, model.endings)
    want = [[model.words.index(w) if w in model.words else tail(w) for w in t] + [len(model.words) + lbl.END] for t in texts]
    assert at.tolist() == sum(want, [])
    assert start.tolist() == [0] * 5 + [5] + [6] * 1001 + [1007] * 2 and end.tolist() == [5] * 5 + [6] + [1007] * 1001 + [1009] * 2
    assert len(codes) == 2
    assert model.codes is model.codes  # made once for all tasks of a worker


def test_one_row_for_a_document_between_model_and_counts(spark, monkeypatch):
    """Words that meet their counts by the join come with their document, each once with how often it occurs."""
    written, cut = {}, lbl.cut
    monkeypatch.setattr(lbl, "cut", lambda df, name: written.setdefault(name, cut(df, name)))
    monkeypatch.setattr(lbl, "TOP", 3)
    texts = ["a a a b b c", "d e f d d gé", "", None, "never seen never"]
    df = spark.createDataFrame([(k, t, k < 4) for k, t in enumerate(texts)], "doc_id long, text string, trains boolean")
    got = {r.doc_id: r for r in lbl.score_documents(df, F.col("trains"), "rows").collect()}
    assert {k: (r.held_out, r.n_tokens, r.n_known) for k, r in got.items()} == {0: (False, 7, 7), 1: (False, 7, 7), 2: (False, 1, 1), 3: (False, 1, 1), 4: (True, 4, 1)}
    parts = {r.doc_id: {bytes(w.word).decode(): w.k for w in r.rare} for r in written["rows-parts"].collect()}
    assert len(parts) == len(texts) and parts[4] == {"never": 2, "seen": 1} and not parts[2] and not parts[3]


def test_large_scores_stay_normal():
    """Scores beyond the range of single precision's exponentials."""
    texts = [[b"w%02d" % (k * j % 40) for k in range(50)] for j in range(60)]
    words = [b"w%02d" % k for k in range(40)]
    for scale in (1.0, 60.0):
        model = model_of(words, scale)
        code, cls, start, _ = lbl.encode(texts, lbl.Codes(model))
        got = lbl.log_targets(model.p, code, cls, start)
        want = np.concatenate([lbl.log_classes(model.p, code, start, a, min(a + 500, len(code))) for a in range(0, len(code), 500)])[np.arange(len(code)), cls]
        assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-4, atol=1e-3)


def plain_loss(p, code, target, start, a, b, drawn, log_noise):
    """The contrastive loss, token by token."""
    loss = 0.0
    for t in range(a, b):
        one, two = (p["r"][code[t - k] if t - k >= start[t] else -1] for k in (1, 2))
        bag = p["r"][code[max(start[t], t - lbl.WINDOW) : t]].sum(0) / np.sqrt(lbl.WINDOW)
        x = one * p["a"][0] + two * p["a"][1] + bag * p["a"][2]
        s = p["q"] @ x + p["b"] - log_noise
        loss += np.log1p(np.exp(-s[target[t]])) + np.log1p(np.exp(s[drawn])).sum()
    return loss


def test_a_step_goes_down_the_loss_of_its_tokens(monkeypatch):
    """Gradients that a step takes for the words' vectors, by differences of the loss."""
    words = [b"w%02d" % k for k in range(6)]
    texts = [words[:1], [], [words[k * k % 6] for k in range(23)], words[:2], words]
    model = model_of(words, 5.0)
    code, target, start, end = lbl.encode(texts, lbl.Codes(model))
    for a, b in ((0, 1), (1, 3), (2, 20), (20, len(code))):
        trainer = lbl.Trainer(model.p, model.noise, [3])
        trainer.past = {k: np.full_like(x, 1e-20) for k, x in trainer.p.items()}
        drawn = np.random.default_rng([3]).choice(lbl.CLASSES, lbl.NOISE, p=model.noise)
        trainer.step(code, target, start, end, a, b)
        # with next to no past, what a step adds to it is the squared gradient
        p = {k: x.astype(np.float64) for k, x in model.p.items()}
        for u in sorted({*code[max(0, a - 20) : b].tolist(), len(p["r"]) - 1}):
            for d in (0, 7):
                at = []
                for e in (1e-4, -1e-4):
                    q = {**p, "r": p["r"].copy()}
                    q["r"][u, d] += e
                    at.append(plain_loss(q, code, target, start, a, b, drawn, trainer.log_noise.astype(np.float64)))
                want = (at[0] - at[1]) / 2e-4
                assert abs(np.sqrt(trainer.past["r"][u, d]) - abs(want)) < 2e-3 + 1e-2 * abs(want), (a, b, u, d)
