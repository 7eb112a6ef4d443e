"""Declarations, the front end, lifecycles, graphs and sources on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from apisieve import catalog
from apisieve.lint import lint
from apisieve.operators import branching, graph, report, selection
from apisieve.plans import Catalog, EventQuery, InvalidQuery, Lifecycle, Rule, Value, all_of, any_of, compile_queries, explain
from apisieve.plans.physical import contradictory
from apisieve.sources import files, projects
from apisieve.sources.javascript import read


def test_declarations():
    a, b = EventQuery.call_global("a"), EventQuery.call_global("b")
    assert any_of([a, b, a], "s") == any_of([any_of([b, a], "s")], "s")
    with pytest.raises(InvalidQuery):
        any_of([a, b])
    with pytest.raises(InvalidQuery):
        EventQuery.import_exact("x").with_arg(0, Value.any_value())
    for bad in (lambda: EventQuery.call_package("a/b", "c"), lambda: EventQuery.call_global(" "), lambda: a.with_arg(256, Value.any_value()), lambda: Value.equals_any([]), lambda: all_of(a, [b]), lambda: Lifecycle("s", (a,), ()), lambda: Rule("x", "m", "info", "high", (a,))):
        with pytest.raises(InvalidQuery):
            bad()
    both = all_of(a.with_arg(0, Value.equals_any(["x"])), [a.with_arg(0, Value.starts_with_any(["y"]))])
    assert contradictory(both) and not contradictory(a.with_arg(0, Value.equals_any(["x"])))
    roots, _ = compile_queries(Catalog((Rule("p:r", "m", "info", "high", (any_of([a, a], "s"), both)),)))
    assert len(roots) == 1 and "IndexedScan call_global[a]" in explain(roots)
    with pytest.raises(InvalidQuery):
        catalog.javascript().combine(catalog.javascript())


SOURCE = """import fs, {readFile as rf} from "node:fs"; import * as cp from 'child_process';
eval("x" + 1); rf("a", {encoding: "utf8"}); cp.spawn("ls"); function f(escape) { escape("no") }
const db = indexedDB.open("n"); db.addEventListener("x"); document.cookie = "a"; window.setTimeout("code", 10);
fetch.call(null, "http://10.0.0.1/"); const k = {a: 1, ...{b: "t"}}; g(k); new Worker(`w`);
"""


def test_front_end():
    rows, problem = read("a.js", SOURCE)
    assert problem is None
    calls = {(r.get("proof"), r.get("module"), r["name"]) for r in rows if r["kind"] == "call"}
    assert {("global", None, "eval"), ("module", "node:fs", "readFile"), ("global", None, "fetch")} <= calls
    (g,) = [r for r in rows if r["kind"] == "call" and r["name"] == "g"]
    assert g["args"][0]["object"] == {"a": "1", "b": "t"}
    assert [r["module"] for r in rows if r["kind"] == "import"] == ["node:fs", "child_process"]
    assert read("b.js", "let x = `unclosed")[1] and read("c.js", "")[0] == []
    shadowed, _ = read("d.js", "function f(eval) { eval('x') }")
    assert all(r.get("proof") != "global" for r in shadowed)


def test_lint(spark):
    sources = spark.createDataFrame([("a.js", SOURCE), ("b.js", "é; eval(`q`)"), ("c.js", "'")], "path string, text string")
    got = lint(sources, catalog.everything())
    found = {(r.path, r.rule_id) for r in got.findings.collect()}
    assert {("a.js", "js:dynamic-code"), ("a.js", "node:read-file"), ("a.js", "node:child-process"), ("a.js", "js:private-address"), ("a.js", "browser:cookie"), ("a.js", "browser:database"), ("b.js", "js:dynamic-code")} <= found
    (b,) = got.findings.filter("path = 'b.js'").collect()
    assert (b.start, b.end) == (4, 13)
    assert [r.path for r in got.diagnostics.collect()] == ["c.js"]
    assert report.exit_status(got.findings, "warning") == 1 and report.exit_status(got.findings, "never") == 0


def brute(rows, need, mode):
    """Every path through if/else on its own."""
    hits: dict = {}

    def walk(i, state):
        while i < len(rows):
            fact, action, control = rows[i]
            if control == "if":
                depth, j, other = 1, i + 1, None
                while depth:
                    depth += rows[j][2] == "if"
                    depth -= rows[j][2] == "endif"
                    if depth == 1 and rows[j][2] == "else":
                        other = j
                    j += 1
                end = j - 1
                for start, stop in ((i + 1, other or end), (other + 1 if other else end, end)):
                    walk_list(rows[start:stop] + rows[end + 1 :], state)
                return
            if action == "sink" and state.source is not None:
                hits.setdefault(fact, set()).add(len(state.met) == need if mode == "all" else bool(state.met))
            elif action:
                state = branching._apply(state, fact, action, need, mode, {})
            i += 1

    def walk_list(part, state):
        nonlocal rows
        kept, rows = rows, part
        walk(0, state)
        rows = kept

    walk(0, branching.State())
    return hits


def test_branching():
    rng = random.Random(5)

    def block(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            if depth and rng.random() < 0.4:
                out += [("", "if"), *block(depth - 1)] + ([("", "else"), *block(depth - 1)] if rng.random() < 0.5 else []) + [("", "endif")]
            else:
                out.append((rng.choice(["source", "match:0", "match:1", "write:0", "sink", "kill"]), ""))
        return out

    for _ in range(200):
        rows = [(k, a, c) for k, (a, c) in enumerate(block(3))]
        for mode in ("any", "all"):
            got, whole = branching.run_object(rows, 2, mode)
            want = brute(rows, 2, mode)
            assert whole and {f: set(r) for f, r in got.items()} == want
    loop = [(0, "source", ""), (1, "", "loop"), (2, "sink", ""), (3, "match:0", ""), (4, "", "endloop"), (5, "sink", "")]
    got, _ = branching.run_object(loop, 1, "any")
    assert set(got[2]) == {True, False} and set(got[5]) == {True, False}


def test_graph(spark):
    assert graph.strong_components([1, 2, 3, 4], [(1, 2), (2, 1), (2, 3), (4, 4)]) == [[3], [1, 2], [4]]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src int, dst int")
    assert {(r.node, r.depth) for r in graph.reach(edges, spark.createDataFrame([(1,)], "node int")).collect()} == {(1, 0), (2, 1), (3, 2)}
    own = spark.createDataFrame([("a", "x", "t1"), ("b", "x", "t2"), ("b", "y", "t3"), ("c", "y", "t3")], "module string, name string, target string")
    stars = spark.createDataFrame([("a", "b"), ("d", "a"), ("d", "b"), ("d", "c")], "module string, source string")
    got = {(r.module, r.name): r.target for r in graph.resolve_exports(own, stars, 5).collect()}
    assert got["a", "x"] == "t1" and got["a", "y"] == "t3" and got["d", "x"] == "ambiguous" and got["d", "y"] == "t3"


def test_sources(spark, tmp_path):
    for name, text in (("a.js", "f()"), ("lib/b.ts", "g()"), ("lib/c.d.ts", "declare"), ("node_modules/x.js", "h()"), ("d.txt", "")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    found = files.scan_files(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {"a.js", "lib/b.ts", "node_modules/x.js"}
    kinds = {r.path: r.k for r in found.select("path", files.classify(F.col("path")).alias("k")).collect()}
    assert kinds["node_modules/x.js"] == "excluded" and kinds["a.js"] == "accepted"
    admitted = files.admit(found)
    assert files.changed(files.manifest(admitted), files.manifest(admitted)).count() == 0
    assert [r.path for r in files.sample(admitted, 2, 1).collect()] == [r.path for r in files.sample(admitted.repartition(3), 2, 1).collect()]
    config = {"tsconfig.json": '{"extends": "./base", /* c */ "include": ["lib"], "references": [{"path": "./other"}],}', "base.json": '{"exclude": ["**/x.js"]}', "other/tsconfig.json": '{"files": ["../a.js"]}'}
    selection_ = projects.discover("tsconfig.json", config.get)
    assert not selection_.problems
    assert {r.path for r in projects.select_sources(found, selection_).collect()} == {"a.js", "lib/b.ts"}
    imports = spark.createDataFrame([("a.js", "lib/b.ts"), ("lib/b.ts", "a.js"), ("lib/b.ts", "none")], "importer string, target string")
    assert {(r.path, r.wave) for r in files.close_frontier(found, imports, spark.createDataFrame([("a.js",)], "path string")).collect()} == {("a.js", 0), ("lib/b.ts", 1)}


def test_selection_and_report(spark):
    rules = spark.createDataFrame([("a:x", "high")], "rule_id string, confidence string")
    odd = spark.createDataFrame([(1, selection.selector_to_regex("b:*"), True)], "ordinal int, pattern string, enabled boolean")
    assert selection.unmatched_overrides(rules, odd).count() == 1
    rows = [{"rule_id": "a:x", "path": "p", "start_line": 1, "start_col": 2, "severity": "info", "message": "m", "certainty": "definite"}]
    assert "p:1:2 info m" in report.pretty(rows, {"p": "\tx"}) and not report.stale(report.markdown(rows, ["path"]), rows, ["path"])


def test_streaming(spark, tmp_path):
    from apisieve.streaming.lifecycle import stream_lifecycle

    rows = [(1, 1, "source"), (1, 2, "match"), (1, 3, "sink"), (1, 4, "write"), (1, 5, "sink"), (2, 1, "match"), (2, 2, "sink")]
    spark.createDataFrame(rows, "object long, fact_id long, action string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("object long, fact_id long, action string").parquet(str(tmp_path / "in"))
    query = stream_lifecycle(stream).writeStream.format("memory").queryName("flows").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.object, r.fact_id, r.source_at) for r in spark.table("flows").collect()] == [(1, 3, 1)]
