"""Lifecycles of objects over straight-line facts: one window pass, no self-join.

Every source starts a new object, so what counts is what happened since the newest
source. A requirement is met by its newest match, if no write to the same property
came after it, and the match is newer than the source. A kill ends the object.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Requirement:
    """``match`` meets it; ``write``, if given, is every write that clears it first."""

    match: Column
    write: Column | None = None


def linear(
    facts: DataFrame,
    partition: list[str],
    order: str,
    source: Column,
    requirements: list[Requirement],
    mode: str = "any",
    completion: str = "any_sink",
    sinks: list[Column] | None = None,
    kill: Column | None = None,
) -> DataFrame:
    """The facts at which a lifecycle completes, with ``source_at``, ``requirement_at`` and ``prior_sinks``."""
    sinks = sinks or []
    so_far = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda test, w=so_far: F.max(F.when(test, F.col(order))).over(w)

    cols = {"source_at": last(source)}
    for k, r in enumerate(requirements):
        cols[f"__m{k}"] = last(r.match)
        if r.write is not None:
            cols[f"__w{k}"] = last(r.write)
    if kill is not None:
        cols["__kill"] = last(kill)
    df = facts.withColumns(cols)
    alive = F.col("source_at").isNotNull()
    if kill is not None:
        alive = alive & (F.col("__kill").isNull() | (F.col("__kill") < F.col("source_at")))
    met = []
    for k, r in enumerate(requirements):
        one = F.col(f"__m{k}") > F.col("source_at")
        if r.write is not None:
            one = one & (F.col(f"__m{k}") == F.col(f"__w{k}"))
        met.append(F.coalesce(one, F.lit(False)))
    ready = F.coalesce(alive & reduce(and_ if mode == "all" else or_, met), F.lit(False))
    positions = F.array_compact(F.array(*[F.when(test, F.col(f"__m{k}")) for k, test in enumerate(met)]))
    df = df.withColumns({"__ready": ready, "requirement_at": positions})
    if completion == "configuration":
        here = reduce(or_, [F.coalesce(r.match, F.lit(False)) for r in requirements])
        done = df.filter(F.col("__ready") & here).withColumn("prior_sinks", F.array().cast("array<bigint>"))
    elif completion == "any_sink":
        done = df.filter(F.col("__ready") & reduce(or_, [F.coalesce(s, F.lit(False)) for s in sinks])).withColumn("prior_sinks", F.array().cast("array<bigint>"))
    else:
        df = df.withColumns({f"__s{k}": last(F.col("__ready") & s) for k, s in enumerate(sinks)} | {f"__p{k}": last(F.col("__ready") & s, before) for k, s in enumerate(sinks)})
        now = [F.coalesce(F.col(f"__s{k}") > F.col("source_at"), F.lit(False)) for k in range(len(sinks))]
        was = [F.coalesce(F.col(f"__p{k}") > F.col("source_at"), F.lit(False)) for k in range(len(sinks))]
        prior = F.array_compact(F.array(*[F.when(t, F.col(f"__p{k}")) for k, t in enumerate(was)]))
        done = df.withColumn("prior_sinks", prior).filter(F.col("__ready") & reduce(and_, now) & ~reduce(and_, was))
    return done.select(*facts.columns, "source_at", "requirement_at", "prior_sinks")
