"""Roots over facts: one broadcast equi-join on the facts' index entries.

Every fact has a few entries (index, key). Roots are few, made by rule authors and
bounded by their limits, so their side is broadcast; the facts are read once, whatever
the number of rules. Roots that can't be a key lookup (substrings, addresses) are
filters over the string references, in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical_chain, package_root, private_ipv4_or_localhost, private_ipv6
from ..functions.chains import GLOBAL_OBJECTS
from ..plans.physical import Root
from .predicates import all_hold

def _canonical(chain: str) -> str:
    head, dot, rest = chain.partition(".")
    return rest if dot and head in GLOBAL_OBJECTS else chain


def entries(facts: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """(fact columns, index, key): the facts' inverted-list entries, one row each; only of the wanted indexes, if given."""
    c = F.col
    both = lambda m, n: F.concat(m, F.lit("|"), n)
    at = lambda kind: c("kind") == kind
    root = package_root(c("module"))
    chain = canonical_chain(c("rooted_chain"))
    declared = F.coalesce(c("role"), F.lit("")) == "declaration"
    made: list[tuple[Column, str, Column]] = []
    for kind in ("call", "construct", "class_reference"):
        own = at(kind) & ~declared if kind == "class_reference" else at(kind)
        made += [
            (own & (c("proof") == "global"), f"{kind}_global", c("name")),
            (at(kind), f"{kind}_heuristic", c("name")),
            (own & (c("proof") == "module"), f"{kind}_module", both(c("module"), c("name"))),
            (own & (c("proof") == "module"), f"{kind}_package", both(root, c("name"))),
        ]
    made.append((at("construct"), "construct_rooted", chain))
    for kind in ("member_call", "member_read", "property_write"):
        made += [
            (at(kind), f"{kind}_rooted", chain),
            (at(kind), f"{kind}_heuristic", c("syntactic_path")),
            (at(kind), f"{kind}_member", c("member")),
            (at(kind) & (c("proof") == "namespace"), f"{kind}_namespace", both(c("module"), c("member"))),
            (at(kind) & (c("proof") == "namespace"), f"{kind}_package_namespace", both(root, c("member"))),
        ]
    made += [
        (at("member_call"), "returned_rooted", both(canonical_chain(c("producer")), c("member"))),
        (at("member_call"), "instance_module", F.concat_ws("|", both(c("class_module"), c("class_export")), c("member"))),
        (at("member_call"), "instance_package", F.concat_ws("|", both(package_root(c("class_module")), c("class_export")), c("member"))),
        (at("import"), "import_literal", c("module")),
        (at("import"), "import_package_specifier", root),
    ]
    slots = F.array(*[F.when(F.coalesce(test, F.lit(False)) & key.isNotNull(), F.struct(F.lit(index).alias("index"), key.alias("key"))) for test, index, key in made if wanted is None or index in wanted])
    return facts.withColumn("entry", F.explode(F.array_compact(slots))).select(*facts.columns, "entry.index", "entry.key")


def join_key(root: Root) -> str:
    chained = root.index.endswith("_rooted")
    if root.producer:
        return f"{_canonical(root.producer) if chained else root.producer}|{root.key}"
    return _canonical(root.key) if chained else root.key


def scan(facts: DataFrame, roots: Sequence[Root]) -> DataFrame:
    """Occurrences: rule_id, evidence, symbol and the fact's place, one row for each root and fact that fit."""
    keyed = [(n, r) for n, r in enumerate(roots) if r.index not in ("string_reference_literal", "string_reference_private_network")]
    loose = [(n, r) for n, r in enumerate(roots) if (n, r) not in keyed]
    out = ["rule_id", "evidence", "symbol", "path", "fact_id", "start", "end", "function_id", "receiver", "result", "definite"]
    parts = []
    if not roots:
        kinds = {"start": "long", "end": "long", "fact_id": "long", "function_id": "long", "receiver": "long", "result": "long", "definite": "boolean"}
        return facts.sparkSession.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in out))
    if keyed:
        rows = [(n, r.rule_id, r.evidence, r.symbol, r.index, join_key(r)) for n, r in keyed]
        plan = facts.sparkSession.createDataFrame(rows, "root int, rule_id string, evidence string, symbol string, index string, key string")
        found = entries(facts, {r.index for _, r in keyed}).join(F.broadcast(plan), ["index", "key"])
        for n, r in keyed:
            if r.args:
                found = found.filter((F.col("root") != n) | all_hold(F.col("args"), r.args))
        parts.append(found.select(*out))
    if loose:  # all of them in one pass over the strings
        address = private_ipv4_or_localhost(F.col("text")) | private_ipv6(F.col("text"))
        fits = []
        for _, r in loose:
            test = F.contains("text", F.lit(r.key)) if r.index.endswith("literal") else address
            fits.append(F.when(test, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.evidence).alias("evidence"), F.lit(r.symbol).alias("symbol"))))
        strings = facts.filter(F.col("kind") == "string_reference")
        parts.append(strings.select(F.explode(F.array_compact(F.array(*fits))).alias("root"), *out[3:]).select("root.rule_id", "root.evidence", "root.symbol", *out[3:]))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def matched_bytes(text: Column, needle: Column, start: Column) -> tuple[Column, Column]:
    """Byte span of the first place of ``needle`` in a string that starts at byte ``start``."""
    at = F.position(needle, text)
    before = F.octet_length(F.substring(text, F.lit(1), at - 1))
    return start + before, start + before + F.octet_length(needle)
