"""From requests and exports of single modules to what a whole project agrees on.

Every operator is an equi-join or a grouped agreement, so a project's size is a matter of
partitions. Unknown is null or the word given, and never proves anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .identity import agreement

#: Emissions of one key that are kept (a fixed value of the report's format).
MAX_EMISSIONS = 256


def module_graph(requests: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, diagnostics). requests: importer, specifier, target; modules: module.

    Requests whose target is a module of the project are edges, distinct; every other one
    is a diagnostic with ``code`` external (no target) or missing (a target that isn't there).
    """
    known = modules.select(F.col("module").alias("target"), F.lit(True).alias("inside")).distinct()
    asked = requests.join(known, "target", "left")
    edges = asked.filter("inside").select(F.col("importer").alias("src"), F.col("target").alias("dst")).distinct()
    code = F.when(F.col("target").isNull(), "external").otherwise("missing")
    return edges, asked.filter("inside IS NULL").select("importer", "specifier", code.alias("code"))


def request_order(requests: DataFrame) -> DataFrame:
    """Requests with ``position``: within an importer by kind, place and specifier."""
    order = Window.partitionBy("importer").orderBy("kind", "start", "end", "specifier")
    return requests.withColumn("position", F.row_number().over(order).cast("long"))


def import_problems(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Statically named imports without one export: importer, module, name, code (missing, ambiguous).

    imports: importer, module, name; exports: module, name, target. Modules without a row
    among the exports are outside the project and give no diagnostic.
    """
    offered = exports.groupBy("module", "name").agg(F.min("target").alias("lo"), F.max("target").alias("hi"))
    inside = exports.select("module").distinct()
    asked = imports.select("importer", "module", "name").distinct().join(inside, "module", "left_semi").join(offered, ["module", "name"], "left")
    code = F.when(F.col("lo").isNull(), "missing").when(F.col("lo") != F.col("hi"), "ambiguous")
    return asked.select("importer", "module", "name", code.alias("code")).filter("code IS NOT NULL")


def namespace_identities(namespaces: DataFrame, exports: DataFrame) -> DataFrame:
    """Members of namespace objects: importer, local, name, target. ``default`` is no member of a star.

    namespaces: importer, local, module; exports: module, name, target (resolved).
    """
    return namespaces.join(exports, "module").filter("name <> 'default'").select("importer", "local", "name", "target")


def call_results(returns: DataFrame, key: list[str], value: str) -> DataFrame:
    """What every call of a function gives: the value all its returns agree on, else ``unknown``.

    Returns of a parameter (``is_parameter``) say nothing about the function and take no part.
    """
    return agreement(returns.filter("NOT is_parameter"), key, value, "unknown").select(*key, value)


def call_targets(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Call facts with the (module, function) they reach: local names first, then resolved imports.

    calls: caller_module, call_id, name, import_module, import_name. functions: module, name,
    function_id. A name that two functions of a module share reaches neither.
    """
    one = functions.groupBy("module", "name").agg(F.min("function_id").alias("target_function"), F.count("*").alias("n")).filter("n = 1").drop("n")
    at_module = F.coalesce("import_module", "caller_module")
    at_name = F.when(F.col("import_module").isNotNull(), F.col("import_name")).otherwise(F.col("name"))
    keyed = calls.withColumns({"target_module": at_module, "target_name": at_name})
    named = one.select(F.col("module").alias("target_module"), F.col("name").alias("target_name"), "target_function")
    return keyed.join(named, ["target_module", "target_name"]).select("caller_module", "call_id", "target_module", "target_function")


def bind_arguments(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """Which argument a parameter stands for: call_id, function_id, parameter, argument, value.

    calls: call_id, function_id, args (array<string>); parameters: function_id, parameter,
    index, is_rest, fallback. A rest parameter takes every argument from its index on; a
    parameter beyond the arguments takes its fallback, with a null ``argument``.
    """
    bound = calls.join(parameters, "function_id")
    n = F.size(F.coalesce("args", F.array().cast("array<string>")))
    rest = F.when(F.col("index") < n, F.sequence(F.col("index"), n - 1)).otherwise(F.array().cast("array<int>"))
    places = F.when(F.col("is_rest"), rest).when(F.col("index") < n, F.array("index")).otherwise(F.array(F.lit(None).cast("int")))
    bound = bound.withColumn("argument", F.explode(places.cast("array<int>")))
    return bound.select("call_id", "function_id", "parameter", "argument", F.coalesce(F.get("args", F.col("argument")), F.when(F.col("argument").isNull(), F.col("fallback"))).alias("value"))


def helper_sinks(own: DataFrame, passes: DataFrame, rounds: int | None = None) -> DataFrame:
    """(function, parameter, sink): sinks that a parameter reaches, through any depth of helpers.

    own: function, parameter, sink. passes: function, parameter, callee, callee_parameter (the
    parameter is handed on). Only new rows are joined in a round; recursion ends by itself.
    """
    names = ["function", "parameter", "sink"]
    seen = new = cut(own.select(*names).distinct(), "helpers")
    done = 0
    while rounds is None or done < rounds:
        done += 1
        below = new.select(F.col("function").alias("callee"), F.col("parameter").alias("callee_parameter"), "sink")
        step = passes.join(below, ["callee", "callee_parameter"]).select(*names).distinct()
        new = cut(step.join(seen, names, "left_anti"), "helpers")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def context_certainty(contexts: DataFrame, key: list[str], ready: Column, complete: Column) -> DataFrame:
    """Sinks that some context completes: definite if every context that comes there is ready and
    the search was complete, else possible. Sinks that no context completes give nothing."""
    seen = contexts.groupBy(*key).agg(F.bool_or(ready).alias("any"), (F.bool_and(ready) & F.bool_and(complete)).alias("all"))
    return seen.filter("any").select(*key, F.when(F.col("all"), "definite").otherwise("possible").alias("certainty"))


def emissions(hits: DataFrame, key: list[str], order: list[str], most: int = MAX_EMISSIONS) -> DataFrame:
    """Distinct emissions of a key, the first ``most`` in order, with ``truncated`` if there were more."""
    one = hits.select(*key, *order).distinct()
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    total = one.groupBy(*key).agg(F.count("*").alias("__n"))
    kept = one.withColumn("__k", place).filter(F.col("__k") <= most).drop("__k")
    return kept.join(total, key).withColumn("truncated", F.col("__n") > most).drop("__n")
