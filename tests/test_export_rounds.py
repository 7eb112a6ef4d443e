"""Export resolution writes a name once, not in every round."""

from apisieve.operators import graph


def test_settled_names_are_not_resolved_again(spark, monkeypatch):
    written, cut = [], graph.cut

    def counted(df):
        back = cut(df)
        if {"name", "target"} <= set(df.columns):
            written.append(back.count())
        return back

    monkeypatch.setattr(graph, "cut", counted)
    names, depth = 40, 6
    own = spark.createDataFrame([("m0", f"n{k}", f"t{k}") for k in range(names)], "module string, name string, target string")
    stars = spark.createDataFrame([(f"m{k + 1}", f"m{k}") for k in range(depth)], "module string, source string")
    got = graph.resolve_exports(own, stars, depth + 1).collect()
    assert {(r.module, r.name, r.target) for r in got} == {(f"m{m}", f"n{k}", f"t{k}") for m in range(depth + 1) for k in range(names)}
    assert len(got) == (depth + 1) * names and sum(written) <= len(got) + 2 * names


def test_cycles_nulls_and_rounds(spark):
    own = spark.createDataFrame([("a", "x", "t"), ("b", "x", "v"), ("g", "x", None), ("c", "y", None), (None, "x", "u"), ("a", "default", "t")], "module string, name string, target string")
    stars = spark.createDataFrame([("b", "a"), ("g", "a"), ("g", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("d", "e"), (None, "a"), ("f", None)], "module string, source string")

    def got(rounds):
        return sorted(((r.module, r.name, r.target) for r in graph.resolve_exports(own, stars, rounds).collect()), key=str)

    same = [("a", "default", "t"), ("a", "x", "t"), ("c", "y", None), (None, "x", "t"), (None, "x", "u")]
    settled = [("b", "x", "v"), ("g", "x", "t"), ("d", "x", "v"), ("d", "y", "ambiguous"), ("e", "x", "v"), ("e", "y", "ambiguous")]
    assert got(9) == sorted(same + settled, key=str)
    assert {t for m, _, t in got(2) if m == "e"} == {"unknown"}
