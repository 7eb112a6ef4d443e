"""From declarations to physical roots: alternatives flattened, contradictions and repeats dropped."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from .dsl import AnyQuery, Catalog, EventQuery, Lifecycle, Value


@dataclass(frozen=True, order=True)
class Root:
    """One scan: the index bucket it reads and the predicates on what it finds."""

    rule_id: str
    index: str
    key: str
    evidence: str
    symbol: str
    args: tuple[tuple[int, Value], ...] = ()
    producer: str = ""

    @property
    def operator(self) -> str:
        if self.index.startswith("returned"):
            return "ReturnedSubject"
        if self.index.startswith("instance"):
            return "InstanceSubject"
        return "ConstrainedScan" if self.args else "IndexedScan"


def bucket(query: EventQuery) -> tuple[str, str, str]:
    """(index, key, producer) of a query."""
    i = query.identity
    producer = ""
    if query.producer is not None:
        producer = f"{query.producer.module}|{query.producer.name}" if query.producer.module else query.producer.name
    index = f"{query.event}_{i.kind}" if query.subject == "direct" else f"{query.subject}_{query.producer.kind}"
    key = f"{i.module}|{i.name}" if i.module and i.name else i.module or i.name
    return index, key, producer


def _strings(args) -> dict[int, list[Value]]:
    groups: dict[int, list[Value]] = {}
    for index, value in args:
        groups.setdefault(index, []).append(value)
    return groups


def contradictory(query: EventQuery) -> bool:
    """Whether no string argument can satisfy all predicates of one index.

    Exact sets are intersected; what is left must fit the prefixes and substrings;
    without an exact set, two prefix sets need a pair of which one begins the other.
    """
    for values in _strings(query.args).values():
        exact = [set(v.values) for v in values if v.op == "equals"]
        prefixes = [v.values for v in values if v.op == "prefix"]
        if exact:
            left = set.intersection(*exact)
            for v in values:
                if v.op == "prefix":
                    left = {x for x in left if any(x.startswith(p) for p in v.values)}
                elif v.op == "contains_any":
                    left = {x for x in left if any(p in x for p in v.values)}
                elif v.op == "contains_all":
                    left = {x for x in left if all(p in x for p in v.values)}
            if not left:
                return True
        for n, a in enumerate(prefixes):
            for b in prefixes[n + 1 :]:
                if not any(x.startswith(y) or y.startswith(x) for x in a for y in b):
                    return True
        if any(v.op == "keys" for v in values) and exact:
            return True
    return False


def roots_of(rule_id: str, query: EventQuery | AnyQuery) -> list[Root]:
    branches = query.branches if isinstance(query, AnyQuery) else (query,)
    symbol = query.symbol if isinstance(query, AnyQuery) else None
    return [Root(rule_id, *bucket(b)[:2], b.evidence, symbol or b.symbol, b.args, bucket(b)[2]) for b in branches if not contradictory(b)]


def compile_queries(catalog: Catalog) -> tuple[list[Root], list[tuple[str, Lifecycle]]]:
    """Sorted distinct roots of all rules, and their lifecycles."""
    roots: set[Root] = set()
    flows: list[tuple[str, Lifecycle]] = []
    for rule in catalog.rules:
        for q in rule.queries:
            if isinstance(q, Lifecycle):
                flows.append((rule.id, q))
            else:
                roots.update(roots_of(rule.id, q))
    return sorted(roots, key=repr), flows


def requirements(roots: Iterable[Root]) -> set[str]:
    """Which inputs a plan needs: its indexes, and arguments if a root constrains them."""
    out = set()
    for r in roots:
        out.add(r.index)
        if r.args:
            out.add("arguments")
    return out


def explain_query(query: EventQuery) -> str:
    index, key, producer = bucket(query)
    lines = [f"{query.event} proved by {query.identity.kind} [{index} = {key}]"]
    if producer:
        lines.append(f"  on what {producer} gave ({query.subject})")
    lines += [f"  argument {i}: {v.op} {', '.join(v.values)}".rstrip() for i, v in query.args]
    return "\n".join(lines)


def explain(roots: Iterable[Root]) -> str:
    return "\n".join(f"{r.operator} {r.index}[{r.key}] -> {r.rule_id} {r.evidence}:{r.symbol}" + "".join(f" arg{i} {v.op}" for i, v in r.args) for r in roots)
