"""Member chains (``window.document.title``) as strings, one name between dots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Global objects that stand for one another at the head of a chain.
GLOBAL_OBJECTS = ("window", "self", "globalThis", "global")


def chain_parts(chain: Column) -> Column:
    return F.split(chain, r"\.")


def chain_suffix(chain: Column, start: int) -> Column:
    """The chain without its first ``start`` names; null if nothing is left."""
    parts = chain_parts(chain)
    return F.when(F.size(parts) > start, F.array_join(F.slice(parts, start + 1, F.size(parts)), "."))


def chain_is_descendant(chain: Column, of: Column) -> Column:
    """Equal, or deeper below it."""
    return (chain == of) | F.startswith(chain, F.concat(of, F.lit(".")))


def strip_this(chain: Column) -> Column:
    return F.regexp_replace(chain, r"^this\.", "")


def strip_bind(chain: Column) -> Column:
    return F.regexp_replace(chain, r"\.bind$", "")


def canonical_chain(chain: Column) -> Column:
    """Chains under a global object lose it, so that aliases have one key."""
    head = F.get(chain_parts(chain), F.lit(0))
    rest = F.regexp_replace(chain, r"^[^.]+\.", "")
    return F.when(head.isin(*GLOBAL_OBJECTS) & chain.contains("."), rest).otherwise(chain)
