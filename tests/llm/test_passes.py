"""Training passes over a corpus as often at any size."""

from apisieve.llm import lbl, queries

SF = "/root/testdata/sf0.01"


def test_passes_do_not_go_by_the_number_of_tokens(spark, monkeypatch):
    turns = []
    monkeypatch.setattr(lbl, "_pass", lambda learnt, model, turn: turns.append(turn) or model.p)
    for times in (1, 1_000_000):
        counts = spark.createDataFrame([(b"the", 9 * times), (b"of", 7 * times)], "word binary, n long")
        lbl.fit(spark.createDataFrame([("the of",)], "text string"), counts)
    assert turns == 2 * list(range(lbl.PASSES))


def test_a_small_corpus_is_not_learnt_by_heart(spark):
    held = queries.op10_language_model(spark, SF).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > held["sum(base_score)"]
