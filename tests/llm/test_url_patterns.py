"""op6's pattern rules and its SQL on urls that fit them, against running every rule on every url."""

import re

import duckdb

from apisieve.llm import queries, urlfilter


def urls():
    heads = ["x://a.org/", "x://free-poker.org/", "x://live.tv.example.org/"]
    tails = ["buy-cheap-pills", "buy/now/very/cheap/x/pills", "win.jackpot", "winner/jackpot", "casino/free", "free casino", "Free/casino", "a/link-farm", "link-farm/x", "my-link-farm", "link/farm", "best/a/b/slots?x", "best/a/b/c/slots", "order--xxx", "é/buy/é/pills", "a#buy/pills", "buy/" * 3000 + "pills", ""]
    return [h + t for h in heads for t in tails]


def brute(url):
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "block" if any(re.search(r.pattern, host.lower() + path) for r in urlfilter.PATTERNS) else "allow"


def test_patterns(spark, tmp_path):
    want = {k: brute(u) for k, u in enumerate(urls())}
    assert len(urlfilter.PATTERNS) > 200 and set(want.values()) == {"allow", "block"}
    spark.createDataFrame(list(enumerate(urls())), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.verdict for r in queries.op6_url_filter(spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    at = [d[0] for d in con.execute(queries.OP6_SQL).description]
    assert {r[at.index("page_id")]: r[at.index("verdict")] for r in con.fetchall()} == want


def test_no_rules(spark):
    df = spark.createDataFrame([(1, "x://a.org/buy/pills")], "page_id long, url string")
    assert urlfilter.judge_urls(df, []).first().verdict == "allow"
