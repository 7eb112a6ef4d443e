"""op2 and op6 on small cases."""

import re

from pyspark.sql import functions as F

from apisieve.llm import chat, urlfilter


def test_reply_trees(spark):
    odd = r"<|im_end|> <\|im_end|> [INST] \[INST] </s> \ <"
    nodes = [
        (1, 1, None, "user", "hi", 0.0),
        (1, 2, 1, "assistant", "a", 2.0),
        (1, 3, 1, "assistant", "b", 1.0),
        (1, 4, 3, "user", None, 5.0),
        (1, 5, 4, "assistant", odd, None),
        (2, 1, 9, "user", "orphan", 1.0),
        (3, 1, 2, "user", "cycle", 1.0),
        (3, 2, 1, "user", "cycle", 1.0),
        (3, 3, 2, "user", "tail of a cycle", 1.0),
        (None, 1, None, "user", "x", 1.0),
        (1, 2, 1, "assistant", "a", 2.0),
    ]
    df = spark.createDataFrame([(*n, "x") for n in nodes], "conv_id long, node_id long, parent_id long, role string, text string, score double, formatted string")
    roles, texts = chat.parse(F.col("formatted"))
    got = {(r.conv_id, r.leaf_id): r for r in chat.format_reply_trees(df).select("*", roles.alias("roles"), texts.alias("texts")).collect()}
    assert got.keys() == {(1, 2), (1, 5), (2, 1)}
    long = got[1, 5]
    assert long.texts == ["hi", "b", "", odd] and long.roles == ["user", "assistant", "user", "assistant"] and long.branch_rank == 1
    assert got[1, 2].branch_rank == 2
    assert [long.formatted[s.start : s.end] for s in long.loss_spans][0] == "b" and len(long.loss_spans) == 2
    assert long.formatted.count(chat.END) == 4
    best = chat.format_reply_trees(df, branches=1).collect()
    assert {(r.conv_id, r.leaf_id) for r in best} == {(1, 5), (2, 1)}
    assert chat.format_reply_trees(df.limit(0)).count() == 0


def test_long_thread(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    roles, texts = chat.parse(F.col("formatted"))
    (r,) = chat.format_reply_trees(chat.conversations_as_trees(df)).select(texts.alias("texts"), "loss_spans").collect()
    assert r.texts == [f"t{k}" for k in range(70)] and len(r.loss_spans) == 35


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en", "https://a.b.example.com/en/", "x://net/es/", "x://foo.net/fr/a", "x://badnet/fr/", "x://casino.org", "x://best-casino-win.org/a", "x://com/", "x://com", "x://mycasino.org/"]
    rules = [urlfilter.host_rule(t, v) for t, v in (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))]
    loose = urlfilter.Rule(r"^badnet", (), "block", 2)
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls + urls[-1:])], "page_id long, url string, host string")
    got = {r.page_id: r for r in urlfilter.judge_urls(df, rules + list(urlfilter.PATTERNS) + [loose]).collect()}
    assert len(got) == len(urls) + 1
    want = [None, None, None, "www.example.com/en/", "com/", "example.com/en/", "net/es/", "net/fr/", None, None, None, "com/", None, None, None]
    assert [got[k].rule for k in range(len(want))] == want
    assert [got[k].verdict for k in range(len(want))] == ["allow"] * 5 + ["block"] * 6 + ["allow"] * 4
    assert got[3].host == "www.example.com" and got[3].path == "/en/x"
    assert re.fullmatch(r"\^.*", rules[0].pattern)
    assert urlfilter.judge_urls(df.limit(0), rules).count() == 0
