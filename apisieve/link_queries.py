"""Queries of project linking, places and report operators; tables stand in for modules and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import linking, places, report
from .queries import EDGES, _edges, query
from .sources.tables import table


# places -------------------------------------------------------------------------------------------
@query("""WITH p AS (SELECT doc_id, substr(text, 1, length(text) // 2) AS pre FROM documents)
SELECT doc_id, CAST(1 + length(pre) - length(replace(pre, chr(10), '')) AS BIGINT) AS line, CAST(1 + length(regexp_extract(pre, '[^\\n]*$')) AS BIGINT) AS col FROM p""")
def line_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column of the middle of every text."""
    docs = table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string"))
    pre = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    rows = docs.select("path", "doc_id", F.octet_length(pre).cast("long").alias("start"))
    return places.with_position(rows, docs.select("path", "text"), "start", "line", "col").select("doc_id", "line", "col")


# linking ------------------------------------------------------------------------------------------
REQUESTS = "SELECT c_mktsegment AS src, c_custkey AS spec, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS dst FROM customer"


@query(f"""WITH r AS ({REQUESTS}), m AS (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)
SELECT DISTINCT src, CAST(dst AS VARCHAR) AS dst, 'edge' AS code FROM r WHERE dst IN (FROM m)
UNION ALL SELECT src, CAST(spec AS VARCHAR), CASE WHEN dst IS NULL THEN 'external' ELSE 'missing' END FROM r WHERE dst IS NULL OR dst NOT IN (FROM m)""")
def module_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers request their nation; nations of the first regions are modules of the project."""
    c = table(spark, sf_dir, "customer")
    requests = c.select(F.col("c_mktsegment").alias("importer"), F.col("c_custkey").cast("string").alias("specifier"), F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("target"))
    modules = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("module"))
    edges, problems = linking.module_graph(requests, modules)
    shown = edges.select("src", F.col("dst").cast("string").alias("dst"), F.lit("edge").alias("code"))
    return shown.unionByName(problems.select(F.col("importer").alias("src"), F.col("specifier").alias("dst"), "code"))


@query("SELECT *, row_number() OVER (PARTITION BY importer ORDER BY kind, start, \"end\", specifier) AS position FROM (SELECT l_orderkey AS importer, l_returnflag AS kind, l_linenumber AS start, l_suppkey AS \"end\", l_partkey AS specifier FROM lineitem)")
def request_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"l_orderkey": "importer", "l_returnflag": "kind", "l_linenumber": "start", "l_suppkey": "end", "l_partkey": "specifier"}
    return linking.request_order(table(spark, sf_dir, "lineitem").select(*[F.col(c).alias(n) for c, n in names.items()]))


@query("""WITH e AS (SELECT p_brand, p_type, min(p_size) AS lo, max(p_size) AS hi FROM part WHERE p_size <= 10 GROUP BY 1, 2)
SELECT p_partkey AS importer, p_brand AS module, p_type AS name, CASE WHEN lo IS NULL THEN 'missing' ELSE 'ambiguous' END AS code
FROM part LEFT JOIN e USING (p_brand, p_type) WHERE p_brand IN (SELECT p_brand FROM e) AND (lo IS NULL OR lo <> hi)""")
def import_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part imports its type from its brand; a brand exports the types of its small parts."""
    part = table(spark, sf_dir, "part")
    imports = part.select(F.col("p_partkey").alias("importer"), F.col("p_brand").alias("module"), F.col("p_type").alias("name"))
    return linking.import_problems(imports, part.filter("p_size <= 10").select(F.col("p_brand").alias("module"), F.col("p_type").alias("name"), F.col("p_size").alias("target")))


@query("""WITH x AS (SELECT c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'default' ELSE c_mktsegment END AS name, min(c_custkey) AS target FROM customer GROUP BY 1, 2)
SELECT s_suppkey AS importer, s_name AS local, name, target FROM supplier JOIN x ON s_nationkey = c_nationkey WHERE name <> 'default'""")
def namespace_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_mktsegment") == "BUILDING", "default").otherwise(F.col("c_mktsegment"))
    exports = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("module"), name.alias("name")).agg(F.min("c_custkey").alias("target"))
    spaces = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("importer"), F.col("s_name").alias("local"), F.col("s_nationkey").alias("module"))
    return linking.namespace_identities(spaces, exports)


@query("""SELECT o_custkey, CASE WHEN min(o_orderstatus) = max(o_orderstatus) AND count(*) = count(o_orderstatus) THEN min(o_orderstatus) ELSE 'unknown' END AS o_orderstatus
FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1""")
def call_result_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are a customer's returns; those of low priority return a parameter."""
    returns = table(spark, sf_dir, "orders").withColumn("is_parameter", F.col("o_orderpriority") == "5-LOW")
    return linking.call_results(returns, ["o_custkey"], "o_orderstatus")


@query("""WITH f AS (SELECT p_brand, p_name || ' ' || p_type AS name, min(p_partkey) AS target_function FROM part GROUP BY 1, 2 HAVING count(*) = 1)
SELECT p_partkey AS call_id, p.p_brand AS caller_module, f.p_brand AS target_module, target_function
FROM part p JOIN f ON f.p_brand = CASE WHEN p_size > 25 THEN 'Brand#1' ELSE p.p_brand END AND f.name = p_name || ' ' || p_type""")
def call_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a function of its brand and calls its own name; large ones import it from one brand."""
    part = table(spark, sf_dir, "part")
    name = F.concat_ws(" ", "p_name", "p_type")
    functions = part.select(F.col("p_brand").alias("module"), name.alias("name"), F.col("p_partkey").alias("function_id"))
    far = F.col("p_size") > 25
    calls = part.select(F.col("p_brand").alias("caller_module"), F.col("p_partkey").alias("call_id"), name.alias("name"), F.when(far, F.lit("Brand#1")).alias("import_module"), F.when(far, name).alias("import_name"))
    return linking.call_targets(calls, functions)


@query("""WITH c AS (SELECT p_partkey AS call_id, p_size AS function_id, string_split(CASE WHEN p_size <= 20 THEN p_name ELSE p_name || ' ' || p_type || ' ' || p_brand END, ' ') AS args FROM part)
SELECT call_id, function_id, 'first' AS parameter, 0 AS argument, args[1] AS value FROM c
UNION ALL SELECT call_id, function_id, 'third', CASE WHEN len(args) > 2 THEN 2 END, CASE WHEN len(args) > 2 THEN args[3] ELSE 'none' END FROM c
UNION ALL SELECT call_id, function_id, 'rest', CAST(k AS INTEGER), args[k + 1] FROM (SELECT *, unnest(range(1, len(args))) AS k FROM c)""")
def argument_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    words = F.when(F.col("p_size") <= 20, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    calls = part.select(F.col("p_partkey").alias("call_id"), F.col("p_size").alias("function_id"), F.split(words, " ").alias("args"))
    shape = F.expr("array(named_struct('parameter', 'first', 'index', 0, 'is_rest', false, 'fallback', string(null)), named_struct('parameter', 'third', 'index', 2, 'is_rest', false, 'fallback', 'none'), named_struct('parameter', 'rest', 'index', 1, 'is_rest', true, 'fallback', string(null)))")
    parameters = part.select(F.col("p_size").alias("function_id")).distinct().select("function_id", F.inline(shape))
    return linking.bind_arguments(calls, parameters)


@query(f"""WITH RECURSIVE e AS ({EDGES}), h(f, p, sink) AS (
  SELECT n_nationkey, 0, 'sink' || n_regionkey FROM nation WHERE n_regionkey < 2
  UNION SELECT e.src, 1 - h.p, h.sink FROM h JOIN e ON e.dst = h.f)
SELECT CAST(f AS INTEGER) AS function, CAST(p AS INTEGER) AS parameter, sink FROM h""")
def helper_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of the first regions hold a sink; along an edge each parameter is handed on as the other one."""
    own = table(spark, sf_dir, "nation").filter("n_regionkey < 2")
    own = own.select(F.col("n_nationkey").alias("function"), F.lit(0).alias("parameter"), F.concat(F.lit("sink"), "n_regionkey").alias("sink"))
    both = F.explode(F.array(F.lit(0), F.lit(1)))
    passes = _edges(spark, sf_dir).select(F.col("src").alias("function"), both.alias("parameter"), F.col("dst").alias("callee")).withColumn("callee_parameter", 1 - F.col("parameter"))
    return linking.helper_sinks(own, passes)


@query("""SELECT l_partkey, CASE WHEN bool_and(l_returnflag = 'R') AND bool_and(l_discount < 0.1) THEN 'definite' ELSE 'possible' END AS certainty
FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R')""")
def nonmatching_call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a context that reaches its part, ready if returned."""
    return linking.context_certainty(table(spark, sf_dir, "lineitem"), ["l_partkey"], F.col("l_returnflag") == "R", F.col("l_discount") < 0.1)


@query("""WITH d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
SELECT l_suppkey, l_partkey, n > 20 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM d) WHERE k <= 20""")
def emission_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.emissions(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_partkey"], most=20)


# reports ------------------------------------------------------------------------------------------
@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM (
SELECT user_id, event_id FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT user_id, event_id FROM events WHERE event_type IN ('click', 'error'))""")
def merged_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return report.merge_occurrences(e.filter("event_type IN ('click', 'view')"), e.filter("event_type IN ('click', 'error')"), ["user_id"], ["event_id"])


@query("SELECT DISTINCT l_suppkey, l_linenumber, l_returnflag FROM lineitem")
def occurrence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.distinct_occurrences(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag"), ["l_suppkey"], ["l_linenumber", "l_returnflag"])


@query("SELECT count(DISTINCT user_id) AS files, count(*) AS findings, bool_or(event_type = 'error') AS is_partial FROM events")
def report_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report a user, merged."""
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.lit(1).cast("long").alias("files"), F.count("*").alias("findings"), F.bool_or(F.col("event_type") == "error").alias("is_partial"))
    return report.merge_reports(own, ["files", "findings"])


@query("SELECT CAST(2 * count(*) AS BIGINT) AS n_traces, CAST(sum(len(string_split(p_name, ' ')) + p_size) AS BIGINT) AS n_steps FROM part")
def evidence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    traces = F.array(F.split("p_name", " "), F.array_repeat("p_type", F.col("p_size")))
    return report.evidence_metrics(table(spark, sf_dir, "part").select(traces.alias("traces")), "traces")
