"""Registered queries of the engine's operators over the driver's tables, each with SQL for DuckDB.

``events`` plays the fact stream (an event type is a global that is called, a user the
object, ``props.k`` the first argument); other tables stand in where an operator needs
modules, ranges, graphs or texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as fn
from .operators import branching, evidence, graph, identity, lifecycle, predicates, report, scan, selection
from .operators.facts import events_as_facts
from .plans import Catalog, EventQuery, Rule, Value, all_of, any_of, compile_queries
from .sources import tables
from .sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def run_rule(facts: DataFrame, *queries, rule_id: str = "demo:rule") -> DataFrame:
    roots, _ = compile_queries(Catalog((Rule(rule_id, "demo", "info", "high", tuple(queries)),)))
    return scan.scan(facts, roots)


def events_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_facts(table(spark, sf_dir, "events"))


E = "SELECT event_id AS fact, user_id AS obj, event_type AS et, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.k') AS ks, value FROM events"


# event selection ----------------------------------------------------------------------------------
@query("SELECT event_type AS symbol, count(*) AS n, min(event_id) AS first_fact FROM events WHERE event_type = 'click' GROUP BY 1")
def indexed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = run_rule(events_facts(spark, sf_dir), EventQuery.call_global("click"))
    return hits.groupBy("symbol").agg(F.count("*").alias("n"), F.min("fact_id").alias("first_fact"))


@query("SELECT event_type AS symbol, count(*) AS n FROM events WHERE event_type IN ('view', 'error') GROUP BY 1")
def heuristic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = run_rule(events_facts(spark, sf_dir), EventQuery.call_heuristic("view"), EventQuery.call_heuristic("error"))
    return hits.groupBy("symbol").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE contains(text, ' the ')")
def string_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = tables.texts_as_strings(table(spark, sf_dir, "documents"), "doc_id", "text")
    roots, _ = compile_queries(Catalog((Rule("demo:text", "demo", "info", "low", (EventQuery.string_contains("the"),)),)))
    # authored values are trimmed, so the root asks for the word and this filter for its blanks
    hits = scan.scan(facts.filter(F.contains("text", F.lit(" the "))), roots)
    return hits.select(F.col("fact_id").alias("doc_id"))


@query("SELECT page_id, octet_length(encode(substr(html, 1, strpos(html, '<script') - 1))) AS start_byte, octet_length(encode(substr(html, 1, strpos(html, '<script') - 1))) + 7 AS end_byte FROM pages WHERE contains(html, '<script')")
def display_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").filter(F.contains("html", F.lit("<script")))
    start, end = scan.matched_bytes(F.col("html"), F.lit("<script"), F.lit(0))
    return pages.select("page_id", start.cast("long").alias("start_byte"), end.cast("long").alias("end_byte"))


HOSTS = "SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1) AS rest FROM pages"


@query(f"SELECT page_id, host FROM ({HOSTS}) WHERE host = 'tionsh.example.net'")
def import_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = tables.urls_as_imports(table(spark, sf_dir, "pages"))
    hits = run_rule(facts.withColumn("module", F.get(F.split("module", "/"), F.lit(0))), EventQuery.import_exact("tionsh.example.net"))
    return hits.select(F.col("fact_id").alias("page_id"), F.col("symbol").alias("host"))


@query(f"SELECT page_id, host FROM ({HOSTS}) WHERE host || '/' || rest = 'tionsh.example.net' OR starts_with(host || '/' || rest, 'tionsh.example.net/')")
def import_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = run_rule(tables.urls_as_imports(table(spark, sf_dir, "pages")), EventQuery.import_package("tionsh.example.net"))
    return hits.select(F.col("fact_id").alias("page_id"), F.col("symbol").alias("host"))


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#13'")
def member_read_rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains under a global object are the same as without it."""
    part = table(spark, sf_dir, "part")
    chain = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("window."), "p_brand")).otherwise(F.col("p_brand"))
    facts = tables.complete(part.select(F.lit("part").alias("path"), F.col("p_partkey").alias("fact_id"), F.lit("member_read").alias("kind"), chain.alias("rooted_chain"), F.lit(True).alias("definite")))
    return run_rule(facts, EventQuery.member_read_rooted("Brand#13")).select(F.col("fact_id").alias("p_partkey"))


# argument predicates ------------------------------------------------------------------------------
def _arg_query(name: str, value: Value, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = run_rule(events_facts(spark, sf_dir), EventQuery.call_global("click").with_arg(0, value))
        return hits.select("fact_id")

    run.__name__ = name
    query(f"SELECT fact AS fact_id FROM ({E}) WHERE et = 'click' AND ({sql})")(run)


_arg_query("arg_equals_any", Value.equals_any(["7", "42", "99"]), "ks IN ('7', '42', '99')")
_arg_query("arg_prefix_any", Value.starts_with_any(["1", "95"]), "starts_with(ks, '1') OR starts_with(ks, '95')")
_arg_query("arg_contains_any", Value.contains_any(["3", "7"]), "contains(ks, '3') OR contains(ks, '7')")
_arg_query("arg_contains_all", Value.contains_all(["3", "7"]), "contains(ks, '3') AND contains(ks, '7')")
_arg_query("arg_object_keys", Value.object_keys(["k"]), "ks IS NOT NULL")
_arg_query("arg_object_property", Value.object_property_value("k", Value.starts_with_any(["4"])), "starts_with(ks, '4')")


@query("SELECT o_orderkey, status IS NOT NULL AS is_static, true AS is_any FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS status FROM orders)")
def arg_unknown_fails_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))
    arg = F.struct(text.alias("static_string"), F.lit(None).cast("map<string,string>").alias("object"), F.lit(None).cast("string").alias("rooted_chain"), text.isNotNull().alias("known"))
    rows = orders.select("o_orderkey", arg.alias("arg"))
    return rows.select("o_orderkey", predicates.on_argument(F.col("arg"), Value.static_string()).alias("is_static"), predicates.on_argument(F.col("arg"), Value.any_value()).alias("is_any"))


@query("SELECT p_partkey, p_type FROM part WHERE (starts_with(p_type, 'S') OR starts_with(p_type, 'P')) AND contains(p_type, 'T')")
def arg_group_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.filter(predicates.on_string(F.col("p_type"), Value.starts_with_any(["S", "P"])) & predicates.on_string(F.col("p_type"), Value.contains_all(["T"]))).select("p_partkey", "p_type")


# combinators --------------------------------------------------------------------------------------
@query("SELECT 'calls' AS symbol, event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 2")
def any_with_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = events_facts(spark, sf_dir)
    either = any_of([EventQuery.call_global("click"), EventQuery.call_global("view"), EventQuery.call_global("click")], "calls")
    hits = run_rule(facts, either)
    return hits.join(facts.select("fact_id", F.col("name").alias("event_type")), "fact_id").groupBy("symbol", "event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS facts FROM events WHERE event_type IN ('click', 'purchase')")
def any_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated roots run once: the rule states one of its two alternatives twice."""
    hits = run_rule(events_facts(spark, sf_dir), EventQuery.call_global("click"), EventQuery.call_global("purchase"), EventQuery.call_global("click"))
    return hits.agg(F.count("*").alias("n"), F.count_distinct("fact_id").alias("facts"))


@query(f"SELECT fact AS fact_id FROM ({E}) WHERE et = 'error' AND (starts_with(ks, '1') OR starts_with(ks, '2')) AND contains(ks, '5')")
def all_same_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = EventQuery.call_global("error")
    both = all_of(call.with_arg(0, Value.starts_with_any(["1", "2"])), [call.with_arg(0, Value.contains_any(["5"]))])
    return run_rule(events_facts(spark, sf_dir), both).select("fact_id")


@query("SELECT c_custkey, c_nationkey FROM (SELECT * FROM customer INTERSECT SELECT * FROM customer WHERE c_nationkey < 10)")
def must_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins that both arms of a branch agree on."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return c.intersect(c.filter("c_nationkey < 10"))


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) <= 2 THEN CAST(count(DISTINCT l_returnflag) AS VARCHAR) ELSE 'unknown' END AS alternatives, count(DISTINCT l_returnflag) > 2 AS exhausted FROM lineitem GROUP BY 1")
def may_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded union of the values that reaching paths give a binding; beyond the bound it is exhausted."""
    n = F.size(F.collect_set("l_returnflag"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.when(n <= 2, n.cast("string")).otherwise("unknown").alias("alternatives"), (n > 2).alias("exhausted"))


# identity -----------------------------------------------------------------------------------------
@query("""WITH ids AS (SELECT n_nationkey AS nk, n_regionkey + 100 AS target FROM nation WHERE n_nationkey % 3 = 0)
SELECT c_custkey, coalesce(target, c_nationkey) AS c_nationkey FROM customer LEFT JOIN ids ON nk = c_nationkey""")
def overlay_mask_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "nation").filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") + 100).alias("target"))
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return identity.overlay(base, ids, ["c_nationkey"], {"c_nationkey": "target"})


@query("""WITH ids AS (SELECT p_brand AS m, p_type AS e, min(p_partkey) AS t FROM part WHERE p_size < 10 GROUP BY 1, 2),
wild AS (SELECT p_brand AS m, min(p_partkey) AS t FROM part GROUP BY 1)
SELECT p_partkey, coalesce(ids.t, wild.t) AS target FROM part LEFT JOIN ids ON p_brand = ids.m AND p_type = ids.e LEFT JOIN wild ON p_brand = wild.m""")
def wildcard_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    exact = part.filter("p_size < 10").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("target"))
    wild = part.groupBy("p_brand").agg(F.min("p_partkey").alias("target")).withColumn("p_type", F.lit("*"))
    rows = part.select("p_partkey", "p_brand", "p_type")
    return identity.with_wildcard(rows, exact.unionByName(wild), "p_brand", "p_type", "target").select("p_partkey", "target")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def returned_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("result"))
    used = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    return identity.returned_subject(used, made, "l_orderkey", "result")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def instance_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    used = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select("o_orderkey", "o_custkey")
    return identity.returned_subject(used, made, "o_custkey", "c_custkey").select("o_orderkey")


@query("SELECT l_partkey, CASE WHEN count(DISTINCT l_returnflag) = 1 AND count(*) = count(l_returnflag) THEN min(l_returnflag) ELSE 'ambiguous' END AS l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def export_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.agreement(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_returnflag")


@query("""WITH d AS (SELECT c_nationkey AS k, max(c_mktsegment) AS v FROM customer WHERE c_nationkey < 5 GROUP BY 1),
s AS (SELECT s_nationkey AS k, CASE WHEN min(s_suppkey % 2) = max(s_suppkey % 2) THEN CAST(min(s_suppkey % 2) AS VARCHAR) ELSE 'ambiguous' END AS v FROM supplier GROUP BY 1)
SELECT coalesce(d.k, s.k) AS k, coalesce(d.v, s.v) AS v FROM d FULL OUTER JOIN s ON d.k = s.k""")
def star_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    direct = table(spark, sf_dir, "customer").filter("c_nationkey < 5").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_mktsegment").alias("v"))
    star = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 2).cast("string").alias("v"))
    return identity.direct_over_star(direct, star, ["k"], "v")


# lifecycles ---------------------------------------------------------------------------------------
W = f"""WITH f AS ({E}), w AS (SELECT *,
  max(CASE WHEN et = 'signup' THEN fact END) OVER z AS src,
  max(CASE WHEN et = 'click' THEN fact END) OVER z AS lw,
  max(CASE WHEN et = 'click' AND k >= 50 THEN fact END) OVER z AS lm,
  max(CASE WHEN et = 'view' AND k < 30 THEN fact END) OVER z AS lv,
  max(CASE WHEN et = 'error' THEN fact END) OVER z AS le
  FROM f WINDOW z AS (PARTITION BY obj ORDER BY fact ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("fact"), F.col("user_id").alias("obj"), F.col("event_type").alias("et"), k.alias("k"))


def _is(event: str):
    return F.col("et") == event


def _flow(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    needs = more.pop("requirements", [lifecycle.Requirement(_is("click") & (F.col("k") >= 50), _is("click"))])
    return lifecycle.linear(_stream(spark, sf_dir), ["obj"], "fact", _is("signup"), needs, **more)


@query(W + " SELECT fact, obj, src AS source_at FROM w WHERE et = 'purchase' AND lm > src AND lm = lw")
def lifecycle_any_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark, sf_dir, sinks=[_is("purchase")]).select("fact", "obj", "source_at")


@query(W + " SELECT fact, obj, src AS source_at FROM w WHERE et = 'purchase' AND lm > src AND lm = lw AND lv > src")
def lifecycle_all_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    needs = [lifecycle.Requirement(_is("click") & (F.col("k") >= 50), _is("click")), lifecycle.Requirement(_is("view") & (F.col("k") < 30))]
    return _flow(spark, sf_dir, requirements=needs, mode="all", sinks=[_is("purchase")]).select("fact", "obj", "source_at")


@query(W + " SELECT fact, obj, src AS source_at FROM w WHERE et = 'click' AND k >= 50 AND src IS NOT NULL AND lm > src AND lm = lw")
def lifecycle_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark, sf_dir, completion="configuration").select("fact", "obj", "source_at")


@query(W + " SELECT fact, obj, src AS source_at FROM w WHERE et = 'purchase' AND lm > src AND (le IS NULL OR le < src)")
def lifecycle_kill(spark: SparkSession, sf_dir: str) -> DataFrame:
    needs = [lifecycle.Requirement(_is("click") & (F.col("k") >= 50))]
    return _flow(spark, sf_dir, requirements=needs, sinks=[_is("purchase")], kill=_is("error")).select("fact", "obj", "source_at")


@query(W + ", r AS (SELECT *, lm > src AND lm = lw AS ready FROM w), t AS (SELECT *, " + """
  max(CASE WHEN ready AND et = 'purchase' THEN fact END) OVER z AS sp, max(CASE WHEN ready AND et = 'error' THEN fact END) OVER z AS se,
  max(CASE WHEN ready AND et = 'purchase' THEN fact END) OVER y AS pp, max(CASE WHEN ready AND et = 'error' THEN fact END) OVER y AS pe
  FROM r WINDOW z AS (PARTITION BY obj ORDER BY fact ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), y AS (PARTITION BY obj ORDER BY fact ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT fact, obj, src AS source_at FROM t WHERE ready AND sp > src AND se > src AND NOT (coalesce(pp > src, false) AND coalesce(pe > src, false))""")
def lifecycle_all_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark, sf_dir, completion="all_sinks", sinks=[_is("purchase"), _is("error")]).select("fact", "obj", "source_at")


@query(W + " SELECT count(*) AS cleared FROM w WHERE et = 'purchase' AND lm > src AND lm < lw")
def lifecycle_clear_on_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinks at which a later write had cleared the requirement: those that only the version without clearing reports."""
    kept = _flow(spark, sf_dir, sinks=[_is("purchase")]).select("fact")
    loose = _flow(spark, sf_dir, requirements=[lifecycle.Requirement(_is("click") & (F.col("k") >= 50))], sinks=[_is("purchase")]).select("fact")
    return loose.join(kept, "fact", "left_anti").agg(F.count("*").alias("cleared"))


@query("SELECT l_orderkey, CASE WHEN bool_and(l_quantity > 10) THEN 'definite' ELSE 'possible' END AS certainty, count(*) AS paths FROM lineitem GROUP BY 1 HAVING bool_or(l_quantity > 10)")
def certainty_definite_possible(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("l_quantity") > 10
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(hit).alias("all"), F.bool_or(hit).alias("any"), F.count("*").alias("paths"))
    return rows.filter("any").select("l_orderkey", F.when(F.col("all"), "definite").otherwise("possible").alias("certainty"), "paths")


@query()
def branching_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path-sensitive form: every user is a function; errors open a branch that a view closes."""
    f = _stream(spark, sf_dir)
    action = F.when(_is("signup"), "source").when(_is("click") & (F.col("k") >= 50), "match:0").when(_is("click"), "write:0").when(_is("purchase"), "sink")
    control = F.when(_is("error"), "if").when(_is("view"), "endif")
    rows = f.select(F.lit("events").alias("path"), F.col("obj").alias("function_id"), "fact", F.when(control.isNull(), F.col("obj")).alias("object"), action.alias("action"), control.alias("control"))
    rows = rows.withColumnRenamed("fact", "fact_id")
    depth = Window.partitionBy("function_id").orderBy("fact_id")
    before = F.last("control", ignorenulls=True).over(depth.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("prev", before).filter("control IS NULL OR (control = 'if' AND coalesce(prev, 'endif') = 'endif') OR (control = 'endif' AND prev = 'if')").drop("prev")
    return branching.branching(rows, need=1)


# evidence and findings ----------------------------------------------------------------------------
@query("""WITH r AS (SELECT event_type, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank, count(*) OVER (PARTITION BY event_type) AS total FROM events)
SELECT event_type, event_id, CAST(rank AS INTEGER) AS rank, total, true AS truncated FROM r WHERE rank <= 5""")
def evidence_groups_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "event_id").withColumn("path", F.lit("events"))
    return evidence.present(rows, ["event_type"], ["event_id"], per_group=5, groups=10, scope=["path"]).select("event_type", "event_id", "rank", "total", "truncated")


@query("SELECT event_type, user_id, count(*) AS count, count(DISTINCT event_id) AS occurrences, CASE WHEN bool_and(value > 5) THEN 'definite' ELSE 'possible' END AS certainty FROM events GROUP BY 1, 2")
def evidence_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("definite", F.col("value") > 5)
    grouped = evidence.group_evidence(rows, ["event_type", "user_id"], ["event_id"])
    return grouped.select("event_type", "user_id", "count", F.size("occurrences").cast("long").alias("occurrences"), "certainty")


@query("SELECT event_type, user_id, count(*) AS merged, CASE WHEN bool_or(value > 20) THEN 'definite' ELSE 'possible' END AS certainty FROM events GROUP BY 1, 2")
def finding_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("definite", F.col("value") > 20)
    return evidence.merge_findings(rows, ["event_type", "user_id"])


R = "SELECT event_id, user_id, event_id AS s, event_id + CAST(json_extract_string(props, '$.k') AS INTEGER) * 20 AS e FROM events"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_id").alias("start"), (F.col("event_id") + k * 20).alias("end"))


@query(f"""WITH r AS ({R}), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r)
SELECT event_id, user_id FROM m WHERE reach IS NULL OR e > reach""")
def nested_range_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.outermost(_ranges(spark, sf_dir), ["user_id"]).select("event_id", "user_id")


@query(f"""WITH r AS ({R}), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
k AS (SELECT *, CASE WHEN reach IS NULL OR e > reach THEN s END AS kept FROM m)
SELECT event_id, max(kept) OVER (PARTITION BY user_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS into_start FROM k""")
def overlap_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.absorb(_ranges(spark, sf_dir), ["user_id"]).select("event_id", "into_start")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS position FROM events")
def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence.in_order(table(spark, sf_dir, "events"), ["user_id"], [F.col("value").desc(), F.col("event_id")])
    return rows.select("event_id", "position")


@query("""WITH f AS (SELECT event_id, user_id, CASE WHEN event_type = 'signup' THEN value END AS v FROM events)
SELECT event_id, arg_max(v, event_id) FILTER (WHERE v IS NOT NULL) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reaching FROM f""")
def reaching_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest assignment that a use can see."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") == "signup", F.col("value")))
    return rows.select("event_id", F.last("v", ignorenulls=True).over(w).alias("reaching"))


# rule selection -----------------------------------------------------------------------------------
RULES = [("js:eval", "medium"), ("js:timer", "low"), ("node:fs", "high"), ("node:net", "medium"), ("browser:read", "high")]
OVERRIDES = [(1, "node:*", True), (2, "js:*", True), (3, "node:net", False), (4, "js:timer", False), (5, "js:t*", True)]


@query("""WITH rules(rule_id, confidence) AS (VALUES ('js:eval', 'medium'), ('js:timer', 'low'), ('node:fs', 'high'), ('node:net', 'medium'), ('browser:read', 'high')),
o(ordinal, pattern, enabled) AS (VALUES (1, '^node:.*$', true), (2, '^js:.*$', true), (3, '^node:net$', false), (4, '^js:timer$', false), (5, '^js:t.*$', true)),
l AS (SELECT rule_id, arg_max(enabled, ordinal) AS last FROM rules JOIN o ON regexp_matches(rule_id, pattern) GROUP BY 1)
SELECT r.rule_id, r.confidence, coalesce(last, confidence = 'high') AS enabled FROM rules r LEFT JOIN l ON r.rule_id = l.rule_id""")
def rule_selection_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule_id string, confidence string")
    overrides = spark.createDataFrame([(k, selection.selector_to_regex(s), e) for k, s, e in OVERRIDES], "ordinal int, pattern string, enabled boolean")
    return selection.select_rules(rules, overrides, "confidence", "high")


SEV = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END"


@query(f"SELECT event_id, {SEV} AS severity FROM events WHERE {SEV} IN ('warning', 'error')")
def severity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    return report.failing(table(spark, sf_dir, "events").select("event_id", severity.alias("severity")), "warning")


# scalar functions ---------------------------------------------------------------------------------
ADDRESSES = ["http://10.1.2.3/x", "8.8.8.8", "192.168.0.1:80", "x127.0.0.1", "127.0.0.1", "172.32.0.1", "172.31.255.255", "256.10.0.1", "localhost:3000", "mylocalhost", "localhost.example.com", "see 169.254.1.1.", "100.64.0.1 and 1.1.1.1"]


@query("""WITH v(id, s) AS (VALUES %s),
a AS (SELECT id, unnest(regexp_extract_all(s, '(^|[^0-9A-Za-z.])([0-9]{1,3}(\\.[0-9]{1,3}){3})', 2)) AS ip FROM v),
n AS (SELECT id, CAST(split_part(ip, '.', 1) AS INT) AS p, CAST(split_part(ip, '.', 2) AS INT) AS q FROM a)
SELECT id, id IN (SELECT id FROM n WHERE p IN (0, 10, 127) OR (p = 100 AND q BETWEEN 64 AND 127) OR (p = 169 AND q = 254) OR (p = 172 AND q BETWEEN 16 AND 31) OR (p = 192 AND q = 168))
  OR regexp_matches(s, '(^|[^A-Za-z0-9_.-])localhost($|[^A-Za-z0-9_.-])') AS private FROM v""" % ", ".join(f"({k}, '{s}')" for k, s in enumerate(ADDRESSES)))
def private_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(ADDRESSES)), "id int, s string")
    return rows.select("id", fn.private_ipv4_or_localhost(F.col("s")).alias("private"))


@query()
def private_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(0, "[::1]:80"), (1, "fe80::1"), (2, "fd00::12"), (3, "2001:db8::1"), (4, "::ffff:10.0.0.1"), (5, "a:b"), (6, None)], "id int, s string")
    return rows.select("id", fn.private_ipv6(F.col("s")).alias("private"))


@query("SELECT page_id, CASE WHEN starts_with(u, '@') THEN split_part(u, '/', 1) || '/' || split_part(u, '/', 2) ELSE split_part(u, '/', 1) END AS package, regexp_matches(u, '^[./#]') AS internal FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '@' ELSE '' END || regexp_replace(url, '^[a-z]+://', '') AS u FROM pages)")
def package_of_specifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.concat(F.when(F.col("page_id") % 3 == 0, "@").otherwise(""), F.regexp_replace("url", "^[a-z]+://", ""))
    return table(spark, sf_dir, "pages").select("page_id", u.alias("u")).select("page_id", fn.package_root(F.col("u")).alias("package"), fn.is_internal_request(F.col("u")).alias("internal"))


@query("SELECT p_partkey, split_part(c, '.', 2) || '.' || split_part(c, '.', 3) AS suffix, c = 'x.' || p_brand OR starts_with(c, 'x.' || p_brand || '.') AS descends FROM (SELECT p_partkey, p_brand, 'x.' || p_brand || '.' || p_size AS c FROM part)")
def chain_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = F.concat_ws(".", F.lit("this.x"), "p_brand", F.col("p_size").cast("string"), F.lit("bind"))
    plain = fn.strip_bind(fn.strip_this(chain))
    return table(spark, sf_dir, "part").select("p_partkey", fn.chain_suffix(plain, 1).alias("suffix"), fn.chain_is_descendant(plain, F.concat(F.lit("x."), "p_brand")).alias("descends"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || CAST(o_custkey AS VARCHAR) END AS text, CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderkey + o_custkey AS VARCHAR) END AS number, o_orderstatus || '-' || o_orderpriority AS template FROM orders")
def constant_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("o_orderkey") % 2 == 0
    text = F.when(even, F.col("o_orderstatus"))
    number = F.when(~even, F.col("o_orderkey"))
    added = fn.js_add(text, number, F.lit(None).cast("string"), F.col("o_custkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", added.alias("a"), fn.js_template(F.col("o_orderstatus"), F.lit("-"), F.col("o_orderpriority")).alias("template"))
    return rows.select("o_orderkey", "a.text", F.col("a.number").cast("string").alias("number"), "template")


PATHS = ["a/./b", "a/../b", "../x", "/abs", "C:/x", "a//b/", "a\\b", "..", "a/b/../../c"]


@query("SELECT * FROM (VALUES %s) AS t(id, path)" % ", ".join(f"({k}, {v})" for k, v in enumerate(["'a/b'", "'b'", "NULL", "NULL", "NULL", "'a/b'", "'a/b'", "NULL", "'c'"])))
def path_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(PATHS)), "id int, p string")
    return rows.select("id", fn.normalize_path(F.col("p")).alias("path"))


# graphs -------------------------------------------------------------------------------------------
EDGES = "SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + n_regionkey) % 25 FROM nation"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(k.alias("src"), ((k * 7 + 3) % 25).alias("dst")).unionByName(n.select(k.alias("src"), ((k + F.col("n_regionkey")) % 25).alias("dst"))).distinct()


@query(f"WITH RECURSIVE e AS ({EDGES}), r(node) AS (SELECT 4 UNION SELECT dst FROM r JOIN e ON src = node) SELECT CAST(node AS INTEGER) AS node FROM r")
def call_graph_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(_edges(spark, sf_dir), spark.createDataFrame([(4,)], "node int")).select("node")


@query(f"WITH RECURSIVE e AS ({EDGES}), r(origin, node) AS (SELECT n_nationkey, n_nationkey FROM nation WHERE n_nationkey % 5 = 0 UNION SELECT origin, dst FROM r JOIN e ON src = node) SELECT origin, CAST(node AS INTEGER) AS node FROM r")
def source_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "nation").filter("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("origin"), F.col("n_nationkey").alias("node"))
    return graph.propagate(_edges(spark, sf_dir), seeds)


@query("SELECT count(*) AS edges, count(DISTINCT src) AS modules FROM (%s)" % EDGES)
def edge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).agg(F.count("*").alias("edges"), F.count_distinct("src").alias("modules"))


@query()
def export_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own exports of every part; each supplier re-exports the parts it sells, each nation its suppliers,
    each region its nations and, in a cycle, the next region."""

    def module(kind: str, key: str) -> Column:
        return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))

    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    name = F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"))
    own = table(spark, sf_dir, "part").select(module("part", "p_partkey").alias("module"), name.alias("name"), F.col("p_brand").alias("target"))
    stars = table(spark, sf_dir, "lineitem").select(module("supplier", "l_suppkey").alias("module"), module("part", "l_partkey").alias("source"))
    stars = stars.unionByName(table(spark, sf_dir, "supplier").select(module("nation", "s_nationkey").alias("module"), module("supplier", "s_suppkey").alias("source")))
    stars = stars.unionByName(nation.select(module("region", "n_regionkey").alias("module"), module("nation", "n_nationkey").alias("source")))
    n = region.count()
    after = F.concat(F.lit("region:"), ((F.col("r_regionkey") + 1) % n).cast("string"))
    stars = stars.unionByName(region.select(module("region", "r_regionkey").alias("module"), after.alias("source")))
    # Three levels, then round the cycle: a target comes, and may turn ambiguous later, once round each.
    return graph.resolve_exports(own, stars, rounds=3 + 2 * n + 1)


# reports ------------------------------------------------------------------------------------------
@query("""SELECT p_type, before, after FROM (SELECT p_type, count(*) FILTER (WHERE l_linestatus = 'F') AS before, count(*) FILTER (WHERE l_linestatus = 'O') AS after
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) WHERE before <> after""")
def rule_count_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by type of part: those shipped against those open."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return report.compare_counts(lines.filter("l_linestatus = 'F'"), lines.filter("l_linestatus = 'O'"), "p_type")


@query("""WITH x(event_type, c) AS (VALUES ('view', NULL), ('click', 0), ('nothing', NULL), ('absent', 0), ('error', 1)), n AS (SELECT event_type, count(*) AS found FROM events GROUP BY 1)
SELECT event_type, coalesce(found, 0) AS found, CASE WHEN x.event_type IS NULL THEN 'unexpected' WHEN c IS NULL THEN CASE WHEN found > 0 THEN 'met' ELSE 'missing' END
  WHEN c = coalesce(found, 0) THEN 'met' WHEN c = 0 THEN 'forbidden' ELSE 'wrong count' END AS status FROM x FULL OUTER JOIN n USING (event_type)""".replace("x.event_type IS NULL", "NOT EXISTS (SELECT 1 FROM x y WHERE y.event_type = n.event_type) AND found IS NOT NULL"))
def expectation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([("view", None), ("click", 0), ("nothing", None), ("absent", 0), ("error", 1)], "event_type string, count long")
    return report.check_expectations(expected, table(spark, sf_dir, "events"), ["event_type"])


@query("SELECT count(DISTINCT user_id) AS files, count(*) AS findings, count(*) FILTER (WHERE event_type = 'error') AS diagnostics, max(value) AS peak, bool_or(event_type = 'error') AS is_partial FROM events")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("files"), F.count("*").alias("findings"), F.count_if(error).alias("diagnostics"), F.max("value").alias("peak"), F.bool_or(error).alias("is_partial"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS median FROM events GROUP BY 1")
def median_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(report.lower_median("value").alias("median"))


@query("SELECT user_id, sha256(string_agg(CAST(event_id AS VARCHAR) || ':' || event_type, chr(10) ORDER BY event_id)) AS digest FROM events GROUP BY 1")
def evidence_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.struct("event_id", F.concat_ws(":", F.col("event_id").cast("string"), "event_type").alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"])
    return table(spark, sf_dir, "events").groupBy("user_id").agg(report.digest(ordered).alias("digest"))


# sources ------------------------------------------------------------------------------------------
@query("""SELECT page_id, CAST(k - 1 AS INTEGER) AS block, script, CAST(nullif(regexp_extract(script, 'track\\(([0-9]+)\\)', 1), '') AS BIGINT) AS tracked FROM (
SELECT page_id, generate_subscripts(scripts, 1) AS k, unnest(scripts) AS script FROM (SELECT page_id, regexp_extract_all(html, '<script[^>]*>(.*?)</script>', 1, 's') AS scripts FROM pages))""")
def page_script_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every script block of every page, and what it tracks."""
    blocks = F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), 1)
    pages = table(spark, sf_dir, "pages").select("page_id", F.posexplode(blocks).alias("block", "script"))
    tracked = F.regexp_extract("script", r"track\(([0-9]+)\)", 1)
    return pages.select("page_id", "block", "script", F.when(tracked != "", tracked).cast("long").alias("tracked"))


@query()
def page_script_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script text through the front end, then a call query on the facts."""
    from .sources.javascript import facts_of

    blocks = F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), 1)
    pages = table(spark, sf_dir, "pages").select("page_id", F.posexplode(blocks).alias("block", "text"))
    # Facts are numbered by source: a page's later blocks are sources of their own.
    path = F.concat(F.col("page_id").cast("string"), F.when(F.col("block") > 0, F.concat(F.lit("#"), F.col("block").cast("string"))).otherwise(""))
    sources = pages.select(path.alias("path"), "text")
    return run_rule(facts_of(sources), EventQuery.call_heuristic("track").with_arg(0, Value.any_value())).select("path", "fact_id", "symbol")


@query("SELECT CAST(page_id AS VARCHAR) AS path, octet_length(encode(html)) AS n_bytes, sha256(html) AS digest FROM pages WHERE octet_length(encode(html)) <= 2000")
def source_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.files import admit, manifest

    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return manifest(admit(pages, max_bytes=2000))


@query("SELECT page_id, regexp_matches(p, '^(.*/)?[^/]*\\.html$') AND NOT regexp_matches(p, '^en/.*$') AS included FROM (SELECT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS p FROM pages)")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.files import included

    p = F.regexp_extract("url", "://[^/]*/([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", included(p, ["*.html"], ["en/**"]).alias("included"))


# the other modules of queries register theirs in the same tables
from . import link_queries, rule_queries  # noqa: E402, F401
