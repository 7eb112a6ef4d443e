"""Argument predicates as columns. Unknown values fail every predicate but ``any``."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import canonical_chain
from ..plans.dsl import Value


def on_string(text: Column, value: Value) -> Column:
    if value.op == "equals":
        test = text.isin(*value.values)
    elif value.op == "prefix":
        test = reduce(lambda a, b: a | b, [F.startswith(text, F.lit(v)) for v in value.values])
    elif value.op == "contains_any":
        test = reduce(lambda a, b: a | b, [F.contains(text, F.lit(v)) for v in value.values])
    elif value.op == "contains_all":
        test = reduce(and_, [F.contains(text, F.lit(v)) for v in value.values])
    elif value.op == "static":
        test = text.isNotNull()
    elif value.op == "any":
        test = F.lit(True)
    else:
        test = F.lit(False)
    return F.coalesce(test, F.lit(False))


def on_argument(arg: Column, value: Value) -> Column:
    """``arg`` is a struct of the fact table, null where the call has no such argument."""
    if value.op == "keys":
        wanted = F.array(*[F.lit(v) for v in value.values])
        test = F.size(F.array_except(wanted, F.map_keys(arg["object"]))) == 0
    elif value.op == "rooted":
        same = canonical_chain(arg["rooted_chain"])
        test = reduce(lambda a, b: a | b, [same == canonical_chain(F.lit(v)) for v in value.values])
    elif value.op == "property":
        inside = on_string(F.try_element_at(arg["object"], F.lit(value.prop)), value.inner)
        test = F.when(arg["object"].isNotNull(), F.map_contains_key(arg["object"], F.lit(value.prop)) & inside).otherwise(on_string(arg["static_string"], value.inner))
    else:
        test = on_string(arg["static_string"], value)
    return F.coalesce(arg.isNotNull() & test, F.lit(False))


def all_hold(args: Column, wanted: tuple[tuple[int, Value], ...]) -> Column:
    return reduce(and_, [on_argument(F.get(args, F.lit(i)), v) for i, v in wanted], F.lit(True))
