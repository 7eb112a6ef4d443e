"""Sources to findings: the front end, the scan, lifecycles, evidence and the report's order.

Sources are read once; their facts are written to the shared folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import evidence, flows, places, scan
from .plans import Catalog, compile_queries
from .shipping import ship
from .sources.javascript import facts_and_diagnostics


@dataclass
class Report:
    findings: DataFrame
    diagnostics: DataFrame


def lint(sources: DataFrame, catalog: Catalog, per_group: int = 65_536, groups: int = 65_536) -> Report:
    """sources: path, text. Findings: path, rule_id, message, severity, start, end,
    certainty, position, truncated, and start_line, start_col, end_line, end_col (from 1, columns in code points)."""
    ship(sources.sparkSession)
    roots, lifecycles = compile_queries(catalog)
    facts, diagnostics = facts_and_diagnostics(sources)
    hits = scan.scan(facts, roots).unionByName(flows.completions(facts, lifecycles))
    shown = evidence.present(hits, ["evidence", "symbol"], ["start", "end", "fact_id"], per_group, groups, ["path", "rule_id"])
    outer = evidence.outermost(shown.select("path", "rule_id", "start", "end", "definite", "truncated").distinct(), ["path", "rule_id"])
    merged = outer.groupBy("path", "rule_id", "start", "end").agg(F.when(F.bool_or("definite"), "definite").otherwise("possible").alias("certainty"), F.bool_or("truncated").alias("truncated"))
    rules = sources.sparkSession.createDataFrame([(r.id, r.message, r.severity) for r in catalog.rules], "rule_id string, message string, severity string")
    named = merged.join(F.broadcast(rules), "rule_id")  # as many rows as the catalog has rules
    named = places.located(named, sources)
    return Report(evidence.in_order(named, ["path"], ["start", "end", "rule_id"]), diagnostics)
