"""Queries of single event constructors: every part is one event.

Its noun is the name, its type the package, ``lib`` a path inside; sizes decide how it is
proved: as a global, as a module's export or as a namespace's member.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.facts import complete
from .plans import EventQuery, Value
from .queries import query, run_rule
from .sources.tables import table

Q = EventQuery
NAMES: list[str] = []


def part_facts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Every part as one event of this kind."""
    size, noun = F.col("p_size"), F.element_at(F.split("p_name", " "), 2)
    chain = F.concat(F.when(size <= 10, F.lit("window.")).otherwise(F.lit("")), "p_type", F.lit("."), noun)
    module = F.when(size.between(21, 40), F.concat("p_type", F.lit("/lib"))).otherwise(F.col("p_type"))
    proof = F.when(size <= 15, "global").when(size <= 32, "module").otherwise("namespace")
    net = F.when(size <= 10, "10.0.0.").when(size <= 20, "8.8.8.").when(size <= 30, "192.168.1.").otherwise("172.40.0.")
    none = F.lit(None).cast("string")
    arg = F.struct(none.alias("static_string"), F.lit(None).cast("map<string,string>").alias("object"), chain.alias("rooted_chain"), F.lit(False).alias("known"))
    return complete(
        table(spark, sf_dir, "part").select(
            F.lit("part").alias("path"), F.col("p_partkey").alias("fact_id"), F.lit(kind).alias("kind"), noun.alias("name"), noun.alias("member"), proof.alias("proof"),
            module.alias("module"), chain.alias("rooted_chain"), F.concat("p_type", F.lit("."), noun).alias("syntactic_path"), F.col("p_type").alias("producer"),
            F.col("p_type").alias("class_module"), F.get(F.split("p_name", " "), F.lit(0)).alias("class_export"), F.concat("p_type", F.lit(" at http://"), net, size, F.lit(":80/")).alias("text"),
            F.when(F.col("p_brand") < "Brand#2", "declaration").otherwise("superclass").alias("role"), F.array(arg).alias("args"), F.lit(True).alias("definite"),
        )
    )


PARTS = """SELECT p_partkey, p_size, p_type AS package, split_part(p_name, ' ', 1) AS class, split_part(p_name, ' ', 2) AS name, p_brand < 'Brand#2' AS declared,
CASE WHEN p_size BETWEEN 21 AND 40 THEN p_type || '/lib' ELSE p_type END AS module,
CASE WHEN p_size <= 15 THEN 'global' WHEN p_size <= 32 THEN 'module' ELSE 'namespace' END AS proof FROM part"""


def _event(name: str, kind: str, asked: EventQuery, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_rule(part_facts(spark, sf_dir, kind), asked).select(F.col("fact_id").alias("p_partkey"), "symbol")

    run.__name__ = name
    NAMES.append(name)
    query(f"SELECT p_partkey, '{asked.symbol}' AS symbol FROM ({PARTS}) WHERE {where}")(run)


RING = "package = 'ECONOMY' AND name = 'ring'"
IN_MODULE, IN_PACKAGE = "module = 'ECONOMY' AND name = 'ring'", RING
_event("call_module", "call", Q.call_module("ECONOMY", "ring"), f"proof = 'module' AND {IN_MODULE}")
_event("call_package", "call", Q.call_package("ECONOMY", "ring"), f"proof = 'module' AND {IN_PACKAGE}")
_event("member_call_rooted", "member_call", Q.member_call_rooted("ECONOMY.ring"), RING)
_event("member_call_heuristic", "member_call", Q.member_call_heuristic("ECONOMY.ring"), RING)
_event("member_call_module", "member_call", Q.member_call_module("ECONOMY", "ring"), f"proof = 'namespace' AND {IN_MODULE}")
_event("member_call_module_path", "member_call", Q.member_call_module("ECONOMY/lib", "ring"), "proof = 'namespace' AND module = 'ECONOMY/lib' AND name = 'ring'")
_event("member_call_package", "member_call", Q.member_call_package("ECONOMY", "ring"), f"proof = 'namespace' AND {IN_PACKAGE}")
_event("property_write_rooted", "property_write", Q.property_write_rooted("window.ECONOMY.ring"), RING)
_event("member_read_module", "member_read", Q.member_read_module("ECONOMY/lib", "ring"), "proof = 'namespace' AND module = 'ECONOMY/lib' AND name = 'ring'")
_event("member_read_package", "member_read", Q.member_read_package("ECONOMY", "ring"), f"proof = 'namespace' AND {IN_PACKAGE}")
_event("import_exact_module", "import", Q.import_exact("ECONOMY/lib"), "module = 'ECONOMY/lib'")
_event("import_package_module", "import", Q.import_package("ECONOMY"), "package = 'ECONOMY'")
_event("string_private_address", "string_reference", Q.string_private_network_address(), "p_size <= 10 OR p_size BETWEEN 21 AND 30")
_event("class_heuristic", "class_reference", Q.class_heuristic("ring"), "name = 'ring'")
_event("class_module", "class_reference", Q.class_module("ECONOMY", "ring"), f"proof = 'module' AND {IN_MODULE} AND NOT declared")
_event("constructor_global", "construct", Q.constructor_global("ring"), "proof = 'global' AND name = 'ring'")
_event("constructor_rooted", "construct", Q.constructor_rooted("ECONOMY.ring"), RING)
_event("constructor_heuristic", "construct", Q.constructor_heuristic("ring"), "name = 'ring'")
_event("constructor_module", "construct", Q.constructor_module("ECONOMY", "ring"), f"proof = 'module' AND {IN_MODULE}")
_event("member_call_returned", "member_call", Q.member_call_returned("ECONOMY", "ring"), RING)
_event("member_call_instance", "member_call", Q.member_call_instance("ECONOMY", "small", "ring"), f"{RING} AND class = 'small'")
_event("arg_rooted_expressions", "call", Q.call_heuristic("ring").with_arg(0, Value.rooted_expressions(["ECONOMY.ring", "self.LARGE.ring"])), "name = 'ring' AND package IN ('ECONOMY', 'LARGE')")
