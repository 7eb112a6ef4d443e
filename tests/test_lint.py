"""Sources to findings, and the front end on ordinary code."""

import time

import pytest

from apisieve.lint import lint
from apisieve.plans import Catalog, EventQuery, Lifecycle, Rule
from apisieve.sources import files
from apisieve.sources.javascript import read
from apisieve.sources.projects import discover

REQUEST = Lifecycle(
    "XMLHttpRequest",
    (EventQuery.constructor_global("XMLHttpRequest"),),
    (EventQuery.member_call_heuristic("open"), EventQuery.member_call_heuristic("setRequestHeader")),
    mode="all",
    sinks=(EventQuery.member_call_heuristic("send"),),
)


def sources(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def found(report):
    return sorted((r.path, r.rule_id, r.start) for r in report.findings.collect())


def test_lifecycle_rules_run(spark):
    texts = {
        "sent.js": "const x = new XMLHttpRequest(); x.open('GET', u); x.setRequestHeader('a', 'b'); x.send();",
        "one_condition.js": "const x = new XMLHttpRequest(); x.open('GET', u); x.send();",
        "other_object.js": "const x = new XMLHttpRequest(); const y = new XMLHttpRequest(); x.open('GET', u); x.setRequestHeader('a', 'b'); y.send();",
        "too_early.js": "const x = new XMLHttpRequest(); x.send(); x.open('GET', u); x.setRequestHeader('a', 'b');",
    }
    catalog = Catalog((Rule("my:request", "sends", "info", "high", (REQUEST,)),))
    assert [(p, r) for p, r, _ in found(lint(sources(spark, texts), catalog))] == [("sent.js", "my:request")]
    both = Catalog((*catalog.rules, Rule("my:eval", "evaluates", "info", "high", (EventQuery.call_global("eval"),))))
    assert [(p, r) for p, r, _ in found(lint(sources(spark, texts | {"e.js": "eval(s)"}), both))] == [("e.js", "my:eval"), ("sent.js", "my:request")]


def test_lint_reports_what_it_cannot_read(spark):
    catalog = Catalog((Rule("my:eval", "evaluates", "info", "high", (EventQuery.call_global("eval"),)),))
    report = lint(sources(spark, {"ok.js": "eval(1)", "bad.js": "f(((", "empty.js": ""}), catalog)
    assert [p for p, *_ in found(report)] == ["ok.js"]
    assert [(r.path, r.code) for r in report.diagnostics.collect()] == [("bad.js", "unreadable")]


def test_several_string_rules_in_one_pass(spark):
    rules = tuple(Rule(f"my:{w}", w, "info", "low", (EventQuery.string_contains(w),)) for w in ("token", "secret"))
    texts = {"a.js": "f('a token and a secret'); g('token'); h('none')"}
    assert [r for _, r, _ in found(lint(sources(spark, texts), Catalog(rules)))] == ["my:secret", "my:token", "my:token"]


@pytest.mark.parametrize(
    ("text", "calls"),
    [
        ("class A { eval(){ return 1 } }", []),
        ("class A extends Base { x = fetch('u'); static async *g(a){ eval('1') } get v(){ return 2 } }", ["fetch", "eval"]),
        ("class A { constructor(){ eval('1') } }", ["eval"]),
        ("x instanceof Foo; const o = { get a(){ return 1 }, async b(){ eval('q') }, *c(){} }", ["eval"]),
        ("`a ${eval('x')} b ${ {a: 1}.a }`", ["eval"]),
        (r"`\${eval('x')}`", []),
    ],
)
def test_front_end(text, calls):
    facts, problem = read("a.js", text)
    assert problem is None
    assert [f["name"] for f in facts if f["kind"] == "call"] == calls


def test_front_end_is_linear():
    began = time.perf_counter()
    _, problem = read("a.js", "var a = [" + ",".join(f"n{k}" for k in range(60_000)) + "];")
    assert problem is None and time.perf_counter() - began < 10


def test_static_strings_are_equal_not_prefixes(spark):
    query = EventQuery.call_global("f").with_arg_static_strings(0, ["abc"])
    catalog = Catalog((Rule("my:f", "f", "info", "low", (query,)),))
    assert [p for p, *_ in found(lint(sources(spark, {"a.js": "f('abc')", "b.js": "f('abcdef')"}), catalog))] == ["a.js"]


def test_refused_files(spark):
    rows = [("a", b"fine", 4), ("b", b"\xff\xfe", 2), ("c", b"x" * 50, 50)]
    found_ = spark.createDataFrame([(p, bytearray(c)) for p, c, _ in rows], "path string, content binary")
    assert [r.path for r in files.admit(found_, max_bytes=20).collect()] == ["a"]
    assert sorted((r.path, r.code) for r in files.refused(found_, max_bytes=20).collect()) == [("b", "invalid encoding"), ("c", "too large")]


def test_shared_reference_is_no_cycle():
    configs = {
        "tsconfig.json": '{"files": [], "references": [{"path": "a"}, {"path": "b"}]}',
        "a/tsconfig.json": '{"files": ["x.ts"], "references": [{"path": "../c"}]}',
        "b/tsconfig.json": '{"files": ["y.ts"], "references": [{"path": "../c"}]}',
        "c/tsconfig.json": '{"files": ["z.ts"]}',
    }
    assert discover("tsconfig.json", configs.get).problems == []
    configs["c/tsconfig.json"] = '{"files": ["z.ts"], "references": [{"path": "../a"}]}'
    assert any("cycle" in p for _, p in discover("tsconfig.json", configs.get).problems)
