"""Authoring limits and the legal pairs of events and identities."""

from __future__ import annotations

import re
from collections.abc import Sequence

MAX_VALUES, MAX_INDEX, MAX_PREDICATES, MAX_GROUPS = 256, 255, 32, 64
#: Which identities may prove which events.
LEGAL = {
    "call": {"global", "heuristic", "module", "package"},
    "construct": {"global", "rooted", "heuristic", "module"},
    "member_call": {"rooted", "heuristic", "namespace", "package_namespace", "returned", "instance"},
    "member_read": {"rooted", "namespace", "package_namespace"},
    "property_write": {"rooted"},
    "class_reference": {"heuristic", "module"},
    "import": {"literal", "package_specifier"},
    "string_reference": {"literal", "private_network"},
}


class InvalidQuery(ValueError):
    """A declaration that can't be compiled."""


def check_name(name: str) -> str:
    name = name.strip()
    if not name:
        raise InvalidQuery("names must not be empty")
    return name


def check_chain(chain: str) -> str:
    chain = check_name(chain)
    if not all(chain.split(".")):
        raise InvalidQuery(f"bad member chain {chain!r}")
    return chain


def check_package(package: str) -> str:
    package = check_name(package)
    if not re.fullmatch(r"@[^/\s]+/[^/\s]+|[^@/.\s][^/\s]*", package):
        raise InvalidQuery(f"a package root has one segment, or two if scoped: {package!r}")
    return package


def check_values(values: Sequence[str]) -> tuple[str, ...]:
    out = sorted({check_name(v) for v in values})
    if not 1 <= len(out) <= MAX_VALUES:
        raise InvalidQuery(f"1 to {MAX_VALUES} values are needed")
    return tuple(out)


def check_index(index: int) -> int:
    if not 0 <= index <= MAX_INDEX:
        raise InvalidQuery(f"argument index {index} is out of range")
    return index


def check_event(query) -> None:
    if query.event not in LEGAL:
        raise InvalidQuery(f"unknown event {query.event!r}")
    if query.identity.kind not in LEGAL[query.event]:
        raise InvalidQuery(f"{query.identity.kind} can't prove {query.event}")
    if query.args and query.event not in ("call", "member_call"):
        raise InvalidQuery("only calls take argument predicates")
    groups: dict[int, int] = {}
    for index, _ in query.args:
        groups[index] = groups.get(index, 0) + 1
    if len(groups) > MAX_GROUPS or max(groups.values(), default=0) > MAX_PREDICATES:
        raise InvalidQuery("too many argument predicates")
