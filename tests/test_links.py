"""Places, linking and report operators on small cases."""

import duckdb
from pyspark.sql import functions as F

from apisieve import link_queries, rule_queries
from apisieve.catalog import everything
from apisieve.lint import lint
from apisieve.operators import linking, places, report
from apisieve.queries import ORACLES

SF = "/root/testdata/sf0.01"


def position(text, offset):
    head = text.encode()[:offset]
    line_head = head.rpartition(b"\n")[2]
    return 1 + head.count(b"\n"), 1 + sum(1 for b in line_head if b & 0xC0 != 0x80)


def test_every_offset_of_odd_texts(spark):
    texts = {"a": "", "b": "\n", "c": "x\r\ny\n\n", "d": "é🙂\nß\n🙂x", "e": "one line", "f": None}
    rows = [(p, k) for p, t in texts.items() for k in range(len((t or "").encode()) + 1)]
    rows += [("a", None), ("gone", 3), ("d", 2), ("d", 2)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "path string, start long, line long")
    got = places.with_position(df, spark.createDataFrame(list(texts.items()), "path string, text string"), "start", "row", "col").collect()
    want = [(p, k, *((None, None) if k is None or p == "gone" else position(texts[p] or "", k))) for p, k in rows]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.path, r.start, r.row, r.col) for r in got), key=key) == sorted(want, key=key)
    assert {r.line for r in got} == {7}
    assert places.with_position(df.limit(0), df.select("path", F.lit("x").alias("text")), "start", "row", "col").count() == 0


def test_findings_have_lines(spark):
    sources = spark.createDataFrame([("a.js", "let é = 1;\n/* 🙂 */ eval('x');\n")], "path string, text string")
    (r,) = lint(sources, everything()).findings.collect()
    assert (r.start_line, r.start_col, r.end_line) == (2, 9, 2) and r.end_col > r.start_col


def test_graph_and_imports(spark):
    requests = spark.createDataFrame([("a", "./b", "b"), ("a", "./b.js", "b"), ("b", "fs", None), ("b", "./x", "x")], "importer string, specifier string, target string")
    edges, problems = linking.module_graph(requests, spark.createDataFrame([("a",), ("b",), ("b",)], "module string"))
    assert edges.collect() == [("a", "b")]
    assert {tuple(r) for r in problems.collect()} == {("b", "fs", "external"), ("b", "./x", "missing")}
    exports = spark.createDataFrame([("b", "f", "b.f"), ("b", "g", "b.g"), ("b", "g", "c.g"), ("b", "default", "b.d")], "module string, name string, target string")
    imports = spark.createDataFrame([("a", "b", "f"), ("a", "b", "g"), ("a", "b", "h"), ("a", "fs", "h")], "importer string, module string, name string")
    assert {tuple(r) for r in linking.import_problems(imports, exports).collect()} == {("a", "b", "g", "ambiguous"), ("a", "b", "h", "missing")}
    spaces = spark.createDataFrame([("a", "ns", "b")], "importer string, local string, module string")
    assert {r.name for r in linking.namespace_identities(spaces, exports).collect()} == {"f", "g"}


def test_calls(spark):
    functions = spark.createDataFrame([("m", "f", 1), ("m", "g", 2), ("m", "g", 3), ("n", "f", 4)], "module string, name string, function_id int")
    calls = spark.createDataFrame([("m", 1, "f", None, None), ("m", 2, "g", None, None), ("m", 3, "h", "n", "f"), ("n", 4, None, None, None)], "caller_module string, call_id int, name string, import_module string, import_name string")
    assert {(r.call_id, r.target_function) for r in linking.call_targets(calls, functions).collect()} == {(1, 1), (3, 4)}
    returns = spark.createDataFrame([(1, "x", False), (1, "x", False), (1, "y", True), (2, "x", False), (2, None, False), (3, "x", True)], "f int, v string, is_parameter boolean")
    assert {(r.f, r.v) for r in linking.call_results(returns, ["f"], "v").collect()} == {(1, "x"), (2, "unknown")}
    passed = spark.createDataFrame([(1, 9, ["a", "b", "c"]), (2, 9, ["a"]), (3, 9, None)], "call_id int, function_id int, args array<string>")
    parameters = spark.createDataFrame([(9, "p", 0, False, "d"), (9, "r", 1, True, None)], "function_id int, parameter string, index int, is_rest boolean, fallback string")
    got = {(r.call_id, r.parameter, r.argument, r.value) for r in linking.bind_arguments(passed, parameters).collect()}
    assert got == {(1, "p", 0, "a"), (1, "r", 1, "b"), (1, "r", 2, "c"), (2, "p", 0, "a"), (3, "p", None, "d")}


def test_helpers_end_on_recursion(spark):
    own = spark.createDataFrame([("c", 0, "eval")], "function string, parameter int, sink string")
    passes = spark.createDataFrame([("a", 1, "b", 0), ("b", 0, "c", 0), ("c", 0, "a", 1), ("b", 1, "c", 1)], "function string, parameter int, callee string, callee_parameter int")
    assert {(r.function, r.parameter) for r in linking.helper_sinks(own, passes).collect()} == {("c", 0), ("b", 0), ("a", 1)}


def test_reports(spark):
    hits = spark.createDataFrame([("k", n // 2) for n in range(10)], "key string, at int")
    got = linking.emissions(hits, ["key"], ["at"], most=3).collect()
    assert sorted(r.at for r in got) == [0, 1, 2] and all(r.truncated for r in got)
    assert not any(r.truncated for r in linking.emissions(hits, ["key"], ["at"]).collect())
    assert [r.position for r in report.merge_occurrences(hits, hits.limit(1), ["key"], ["at"]).collect()] == list(range(1, 12))
    empty = report.merge_reports(spark.createDataFrame([], "n long, is_partial boolean"), ["n"]).first()
    assert (empty.n, empty.is_partial) == (0, False)
    traces = spark.createDataFrame([([["a", "b"], ["c"]],), (None,), ([],)], "t array<array<string>>")
    assert tuple(report.evidence_metrics(traces, "t").first()) == (2, 3)


def test_no_query_compares_nothing():
    """The rows that the SQL of these modules expects are there."""
    con = duckdb.connect()
    for t in "nation supplier customer part orders lineitem events documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    names = [n for n in ORACLES if n in NAMES]
    assert len(names) > 30
    for n in names:
        assert con.execute(f"SELECT count(*) FROM ({ORACLES[n]})").fetchone()[0] > 0, n


NAMES = {n for m in (link_queries,) for n in vars(m)} | set(rule_queries.NAMES)
