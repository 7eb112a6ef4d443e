"""What rule authors write: typed, immutable query declarations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from .validate import InvalidQuery, check_chain, check_event, check_index, check_name, check_package, check_values


@dataclass(frozen=True, order=True)
class Identity:
    """What proves that an event is about the API meant: how (kind), and its names."""

    kind: str
    name: str = ""
    module: str = ""


@dataclass(frozen=True, order=True)
class Value:
    """A predicate on one argument."""

    op: str
    values: tuple[str, ...] = ()
    prop: str = ""
    inner: Value | None = None

    @staticmethod
    def any_value() -> Value:
        return Value("any")

    @staticmethod
    def static_string() -> Value:
        return Value("static")

    @staticmethod
    def equals_any(values: Sequence[str]) -> Value:
        return Value("equals", check_values(values))

    @staticmethod
    def starts_with_any(values: Sequence[str]) -> Value:
        return Value("prefix", check_values(values))

    @staticmethod
    def contains_any(values: Sequence[str]) -> Value:
        return Value("contains_any", check_values(values))

    @staticmethod
    def contains_all(values: Sequence[str]) -> Value:
        return Value("contains_all", check_values(values))

    @staticmethod
    def object_keys(keys: Sequence[str]) -> Value:
        return Value("keys", check_values(keys))

    @staticmethod
    def rooted_expressions(chains: Sequence[str]) -> Value:
        return Value("rooted", tuple(check_chain(c) for c in check_values(chains)))

    @staticmethod
    def object_property_value(prop: str, inner: Value) -> Value:
        return Value("property", (), check_name(prop), inner)


@dataclass(frozen=True, order=True)
class EventQuery:
    """One kind of event under one identity, with predicates on its arguments."""

    event: str
    identity: Identity
    args: tuple[tuple[int, Value], ...] = ()
    subject: str = "direct"
    producer: Identity | None = None
    evidence: str = ""
    symbol: str = ""

    def __post_init__(self):
        check_event(self)

    # constructors ---------------------------------------------------------------------------------
    @staticmethod
    def _of(event: str, kind: str, name: str = "", module: str = "") -> EventQuery:
        symbol = f"{module}.{name}" if module and name else module or name
        return EventQuery(event, Identity(kind, name, module), evidence=event, symbol=symbol)

    @classmethod
    def call_global(cls, name: str) -> EventQuery:
        return cls._of("call", "global", check_name(name))

    @classmethod
    def call_heuristic(cls, name: str) -> EventQuery:
        return cls._of("call", "heuristic", check_name(name))

    @classmethod
    def call_module(cls, module: str, export: str) -> EventQuery:
        return cls._of("call", "module", check_name(export), check_name(module))

    @classmethod
    def call_package(cls, package: str, export: str) -> EventQuery:
        return cls._of("call", "package", check_name(export), check_package(package))

    @classmethod
    def member_call_rooted(cls, chain: str) -> EventQuery:
        return cls._of("member_call", "rooted", check_chain(chain))

    @classmethod
    def member_call_heuristic(cls, chain: str) -> EventQuery:
        return cls._of("member_call", "heuristic", check_chain(chain))

    @classmethod
    def member_call_module(cls, module: str, member: str) -> EventQuery:
        return cls._of("member_call", "namespace", check_name(member), check_name(module))

    @classmethod
    def member_call_package(cls, package: str, member: str) -> EventQuery:
        return cls._of("member_call", "package_namespace", check_name(member), check_package(package))

    @classmethod
    def member_read_rooted(cls, chain: str) -> EventQuery:
        return cls._of("member_read", "rooted", check_chain(chain))

    @classmethod
    def property_write_rooted(cls, chain: str) -> EventQuery:
        return cls._of("property_write", "rooted", check_chain(chain))

    @classmethod
    def member_read_module(cls, module: str, member: str) -> EventQuery:
        return cls._of("member_read", "namespace", check_name(member), check_name(module))

    @classmethod
    def member_read_package(cls, package: str, member: str) -> EventQuery:
        return cls._of("member_read", "package_namespace", check_name(member), check_package(package))

    @classmethod
    def import_exact(cls, module: str) -> EventQuery:
        return cls._of("import", "literal", module=check_name(module))

    @classmethod
    def import_package(cls, package: str) -> EventQuery:
        return cls._of("import", "package_specifier", module=check_package(package))

    @classmethod
    def string_contains(cls, value: str) -> EventQuery:
        return cls._of("string_reference", "literal", check_name(value))

    @classmethod
    def string_private_network_address(cls) -> EventQuery:
        return cls._of("string_reference", "private_network", "private network address")

    @classmethod
    def class_heuristic(cls, name: str) -> EventQuery:
        return cls._of("class_reference", "heuristic", check_name(name))

    @classmethod
    def class_module(cls, module: str, export: str) -> EventQuery:
        return cls._of("class_reference", "module", check_name(export), check_name(module))

    @classmethod
    def constructor_global(cls, name: str) -> EventQuery:
        return cls._of("construct", "global", check_name(name))

    @classmethod
    def constructor_rooted(cls, chain: str) -> EventQuery:
        return cls._of("construct", "rooted", check_chain(chain))

    @classmethod
    def constructor_heuristic(cls, name: str) -> EventQuery:
        return cls._of("construct", "heuristic", check_name(name))

    @classmethod
    def constructor_module(cls, module: str, export: str) -> EventQuery:
        return cls._of("construct", "module", check_name(export), check_name(module))

    @classmethod
    def member_call_returned(cls, producer: str, member: str) -> EventQuery:
        """A member called on what a rooted call returned."""
        return cls("member_call", Identity("returned", check_name(member)), (), "returned", Identity("rooted", check_chain(producer)), "member_call", f"{producer}().{member}")

    @classmethod
    def member_call_instance(cls, module: str, export: str, member: str, package: bool = False) -> EventQuery:
        """A member called on an instance of a module's class."""
        kind = Identity("package" if package else "module", check_name(export), check_package(module) if package else check_name(module))
        return cls("member_call", Identity("instance", check_name(member)), (), "instance", kind, "member_call", f"{module}.{export}#{member}")

    # argument predicates --------------------------------------------------------------------------
    def with_arg(self, index: int, value: Value) -> EventQuery:
        return replace(self, args=tuple(sorted({*self.args, (check_index(index), value)})))

    def with_arg_static_string(self, index: int) -> EventQuery:
        return self.with_arg(index, Value.static_string())

    def with_arg_static_strings(self, index: int, values: Sequence[str]) -> EventQuery:
        return self.with_arg(index, Value.equals_any(values))

    def with_arg_static_string_contains(self, index: int, values: Sequence[str]) -> EventQuery:
        return self.with_arg(index, Value.contains_any(values))

    def with_arg_object_property_value(self, index: int, prop: str, value: Value) -> EventQuery:
        return self.with_arg(index, Value.object_property_value(prop, value))

    def with_arg_object_keys(self, index: int, keys: Sequence[str]) -> EventQuery:
        return self.with_arg(index, Value.object_keys(keys))

    def explain(self) -> str:
        from .physical import explain_query

        return explain_query(self)


@dataclass(frozen=True)
class AnyQuery:
    """Alternatives; all of them give the same kind of evidence under one symbol."""

    branches: tuple[EventQuery, ...]
    symbol: str | None = None


def any_of(branches: Sequence[EventQuery | AnyQuery], symbol: str | None = None) -> AnyQuery:
    flat: list[EventQuery] = []
    for b in branches:
        flat += b.branches if isinstance(b, AnyQuery) else [b]
    if not 1 <= len(flat) <= 256:
        raise InvalidQuery("any takes 1 to 256 branches")
    if symbol is None and len({(b.evidence, b.symbol) for b in flat}) > 1:
        raise InvalidQuery("branches of any differ in evidence; give a symbol")
    return AnyQuery(tuple(sorted(set(flat))), symbol)


def all_of(event: EventQuery, requirements: Sequence[EventQuery]) -> EventQuery:
    """A conjunction on one and the same event: its predicates together."""
    args = set(event.args)
    for r in requirements:
        if (r.event, r.identity, r.subject, r.producer) != (event.event, event.identity, event.subject, event.producer):
            raise InvalidQuery("all combines predicates of one event only")
        args |= set(r.args)
    return replace(event, args=tuple(sorted(args)))


@dataclass(frozen=True)
class Lifecycle:
    """Source, then conditions (any or all of them), then completion, on one object."""

    symbol: str
    sources: tuple[EventQuery, ...]
    conditions: tuple[EventQuery, ...]
    mode: str = "any"
    completion: str = "any_sink"
    sinks: tuple[EventQuery, ...] = ()

    def __post_init__(self):
        if not self.sources or not self.conditions:
            raise InvalidQuery("a lifecycle needs a source and a condition")
        if self.mode not in ("any", "all") or self.completion not in ("configuration", "any_sink", "all_sinks"):
            raise InvalidQuery("unknown lifecycle mode or completion")
        if (self.completion == "configuration") == bool(self.sinks):
            raise InvalidQuery("sinks go with any_sink and all_sinks only")
        if max(map(len, (self.sources, self.conditions, self.sinks))) > 64:
            raise InvalidQuery("a lifecycle takes 64 sources, conditions and sinks at most")


@dataclass(frozen=True)
class Rule:
    id: str
    message: str
    severity: str
    confidence: str
    queries: tuple[EventQuery | AnyQuery | Lifecycle, ...]

    def __post_init__(self):
        from ..functions.ranks import CONFIDENCES, SEVERITIES

        if self.id.count(":") != 1 or not all(self.id.split(":")):
            raise InvalidQuery(f"rule id must be provider:name, not {self.id!r}")
        if not self.message or not self.queries or self.severity not in SEVERITIES or self.confidence not in CONFIDENCES:
            raise InvalidQuery(f"rule {self.id} lacks a required field")


@dataclass(frozen=True)
class Catalog:
    rules: tuple[Rule, ...]

    def __post_init__(self):
        ids = [r.id for r in self.rules]
        if len(ids) != len(set(ids)):
            raise InvalidQuery("duplicate rule id")

    def combine(self, other: Catalog) -> Catalog:
        return Catalog(self.rules + other.rules)
