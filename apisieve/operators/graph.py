"""Fixed points over edges, as semi-naive loops of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage


def cut(df: DataFrame) -> DataFrame:
    return storage.cut(df, "graph")


def reach(edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, depth): least number of steps from the seeds (node). Each round joins only the frontier."""
    parts = [cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))]
    frontier, seen, depth = parts[0].select("node"), parts[0], 0
    while rounds is None or depth < rounds:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        new = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        parts.append(new)
        frontier, seen = new.select("node"), reduce(DataFrame.unionByName, parts)
    return seen


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """(origin, node): every origin's value carried along the edges to a fixed point. Seeds: origin, node."""
    seen = cut(seeds.select("origin", "node").distinct())
    new, done = seen, 0
    while rounds is None or done < rounds:
        done += 1
        step = new.join(edges, new["node"] == edges["src"]).select("origin", F.col("dst").alias("node")).distinct()
        new = cut(step.join(seen, ["origin", "node"], "left_anti"))
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new))
    return seen


#: Codes of targets that are none: offers that don't agree, names that still change after the last round.
AMBIGUOUS, UNKNOWN = -1, -2


def _codes(df: DataFrame, column: str) -> DataFrame:
    """(text, code) of the values of a column. Written, so that the codes stay."""
    return cut(df.filter(F.col(column).isNotNull()).select(F.col(column).alias("text")).distinct().withColumn("code", F.monotonically_increasing_id()))


def _of(df: DataFrame, modules: DataFrame, how: str) -> DataFrame:
    """Rows whose module is (or isn't) among ``modules``; null is a module here."""
    return df.join(modules.select(F.col("module").alias("_m")), F.col("module").eqNullSafe(F.col("_m")), how)


def resolve_exports(own: DataFrame, stars: DataFrame, rounds: int) -> DataFrame:
    """(module, name, target): own exports win; what star re-exports offer must agree, else ``ambiguous``.

    own: module, name, target. stars: module, source. ``rounds`` bounds cyclic graphs; names
    that still change then are ``unknown``.

    A round resolves only the modules with a source that changed in the round before, from all
    their sources; what others re-export stays in the table that a former round wrote.
    """
    own, stars = cut(own.select("module", "name", "target")), stars.select("module", "source")
    names, targets = _codes(own, "name"), _codes(own.filter("target <> 'ambiguous'"), "target")
    told = own.filter("name <> 'default'").join(names.select(F.col("text").alias("name"), F.col("code").alias("n")), "name")
    told = told.join(targets.select(F.col("text").alias("target"), F.col("code").alias("t")), "target", "left")
    told = cut(told.select("module", F.col("n").alias("name"), F.when(F.col("target") == "ambiguous", AMBIGUOUS).otherwise(F.col("t")).alias("target")))
    direct = told.filter("target IS NOT NULL AND module IS NOT NULL")

    parts: list[tuple[DataFrame, DataFrame]] = []  # of re-exported names, (module, name, target, moved), and their modules
    edges, over, sources, before = stars, None, told, None
    for k in range(rounds):
        offered = edges.join(sources.select(F.col("module").alias("source"), "name", "target"), "source")
        rows = offered.select("module", "name", "target", F.lit(0).alias("kind"))
        rows = rows.unionByName((direct if over is None else _of(direct, over, "left_semi")).withColumn("kind", F.lit(1)))
        if before is not None:
            rows = rows.unionByName(_of(before, over, "left_semi").withColumn("kind", F.lit(2)))
        offer = F.when(F.col("kind") == 0, F.col("target"))
        found = rows.groupBy("module", "name").agg(
            F.min(offer).alias("lo"), F.max(offer).alias("hi"), F.count_if(F.col("kind") == 0).alias("offers"),
            F.count_if(F.col("kind") == 1).alias("direct"), F.max(F.when(F.col("kind") == 2, F.col("target"))).alias("was"),
        )
        star = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(AMBIGUOUS).cast("long")
        found = found.filter("offers > 0 AND direct = 0").select("module", "name", star.alias("target"), "was")
        new = cut(found.select("module", "name", "target", F.coalesce(F.col("target") != F.col("was"), F.lit(True)).alias("moved")))
        modules = cut(new.groupBy("module").agg(F.bool_or("moved").alias("moved")))
        changed = modules.filter("moved")
        if changed.isEmpty():
            break
        parts = [_without(part, had, modules) for part, had in parts]
        parts = [p for p in parts if p is not None] + [(new, modules)]
        if k + 1 == rounds:
            parts[-1] = (new.withColumn("target", F.when(F.col("moved"), UNKNOWN).otherwise(F.col("target"))), modules)
            break
        if k == 0:  # from here on only modules with a source that re-exports can change
            again = cut(stars.select("module").distinct())
            upper = cut(stars.join(again.select(F.col("module").alias("source")), "source", "left_semi").select("module").distinct())
            stars = cut(_of(stars, upper, "left_semi").distinct())
        over = cut(stars.join(changed.select(F.col("module").alias("source")), "source", "left_semi").select("module").distinct())
        edges = cut(_of(stars, over, "left_semi"))
        met = edges.select(F.col("source").alias("module"))
        known = [part.select("module", "name", "target") for part, had in parts if not had.join(met, "module", "left_semi").isEmpty()]
        sources = reduce(DataFrame.unionByName, known, told)
        held = [part.select("module", "name", "target") for part, had in parts if not _of(had, over, "left_semi").isEmpty()]
        before = reduce(DataFrame.unionByName, held) if held else None

    target = F.when(F.col("code") == AMBIGUOUS, "ambiguous").when(F.col("code") == UNKNOWN, "unknown").otherwise(F.col("target"))
    out = own.filter("target IS NOT NULL")
    bare = own.filter("target IS NULL").select("module", "name")
    if not parts:
        return own
    rest = reduce(DataFrame.unionByName, [part.select("module", F.col("name").alias("n"), F.col("target").alias("code")) for part, _ in parts])
    rest = rest.join(names.select(F.col("text").alias("name"), F.col("code").alias("n")), "n")
    rest = rest.join(targets.select(F.col("text").alias("target"), "code"), "code", "left").select("module", "name", target.alias("target"))
    if not bare.isEmpty():  # own exports without a target take what is re-exported
        rest = bare.join(rest, ["module", "name"], "full_outer")
    return out.unionByName(rest)


def _without(part: DataFrame, had: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """A table of names, and its modules, without these ``modules``; None if nothing is left."""
    if _of(had, modules, "left_semi").isEmpty():
        return part, had
    had = cut(_of(had, modules, "left_anti"))
    return None if had.isEmpty() else (_of(part, modules, "left_anti"), had)


def strong_components(nodes: list, edges: list[tuple]) -> list[list]:
    """Strongly connected components of a module graph, dependencies first (iterative).

    For graphs of one project, which are bounded at ten thousand modules by admission.
    """
    after: dict = {n: [] for n in nodes}
    for a, b in edges:
        after[a].append(b)
    index: dict = {}
    low: dict = {}
    stack: list = []
    on: set = set()
    out: list[list] = []
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(sorted(after[root])))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, it = work[-1]
            for nxt in it:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(sorted(after[nxt]))))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        group.append(x)
                        if x == node:
                            break
                    out.append(sorted(group))
    return out
