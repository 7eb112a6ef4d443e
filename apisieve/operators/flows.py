"""Declared lifecycles over facts: each event query of a lifecycle is scanned like a rule's own,
and the hits of one object, in source order, go through the linear lifecycle's window.

An object is what a source's call or construction gave; conditions and sinks belong to the
object they are called, read or written on; of these, a name without a dot is the object's
member, whatever the object is called. Hits without an object take no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import Lifecycle
from ..plans.physical import Root, roots_of
from . import scan
from .lifecycle import Requirement, linear

MEMBERS = ("member_call", "member_read", "property_write")


def _of_object(root: Root) -> Root:
    event, _, kind = root.index.rpartition("_")
    return replace(root, index=f"{event}_member") if kind == "heuristic" and event in MEMBERS and "." not in root.key else root


def completions(facts: DataFrame, flows: Sequence[tuple[str, Lifecycle]]) -> DataFrame:
    """Occurrences, as ``scan`` gives them, of the facts at which lifecycles complete."""
    roots = []
    for n, (_, flow) in enumerate(flows):
        for role, queries in (("source", flow.sources), ("condition", flow.conditions), ("sink", flow.sinks)):
            for k, query in enumerate(queries):
                own = roots_of(f"{n}|{role}|{0 if role == 'source' else k}", query)
                roots += own if role == "source" else map(_of_object, own)
    hits = scan.scan(facts, sorted(set(roots), key=repr))
    columns = hits.columns
    if not flows:
        return hits
    part = F.split("rule_id", r"\|")
    is_source = part[1] == "source"
    hits = hits.withColumns({"flow": part[0].cast("int"), "role": F.concat(part[1], part[2]), "object": F.when(is_source, F.col("result")).otherwise(F.col("receiver"))})
    hits = hits.filter("object IS NOT NULL")
    found = []
    for n, (rule_id, flow) in enumerate(flows):
        own = hits.filter(F.col("flow") == n)
        is_ = lambda role: F.col("role") == role
        needs = [Requirement(is_(f"condition{k}")) for k in range(len(flow.conditions))]
        sinks = [is_(f"sink{k}") for k in range(len(flow.sinks))]
        done = linear(own, ["path", "object"], "fact_id", is_("source0"), needs, flow.mode, flow.completion, sinks)
        found.append(done.withColumns({"rule_id": F.lit(rule_id), "evidence": F.lit("lifecycle"), "symbol": F.lit(flow.symbol)}).select(*columns).distinct())
    return reduce(DataFrame.unionByName, found)
