"""Join-shaped operators that decide which API an event is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlay(base: DataFrame, identities: DataFrame, key: list[str], remap: dict[str, str]) -> DataFrame:
    """Rows of ``base`` re-keyed by resolved identity. A row with an identity is masked
    in its old place and appears once for each identity in its new one; others stay.

    One left join does mask and remap together, so the base is read and shuffled once.
    ``remap`` takes columns of base to columns of ``identities``.
    """
    marked = identities.withColumn("__has", F.lit(True))
    joined = base.join(marked, key, "left")
    new = {c: F.when(F.col("__has"), F.col(to)).otherwise(F.col(c)) for c, to in remap.items()}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in base.columns])


def with_wildcard(rows: DataFrame, identities: DataFrame, module: str, export: str, value: str) -> DataFrame:
    """The identity of (module, export), else that of (module, ``*``) with the export kept."""
    exact = identities.filter(F.col(export) != "*").select(module, export, F.col(value).alias("__exact"))
    wild = identities.filter(F.col(export) == "*").select(module, F.col(value).alias("__wild"))
    joined = rows.join(exact, [module, export], "left").join(wild, [module], "left")
    return joined.select(*rows.columns, F.coalesce("__exact", "__wild").alias(value))


def returned_subject(consumers: DataFrame, producers: DataFrame, receiver: str, result: str) -> DataFrame:
    """Consumers whose receiver a producer returned, once each however many producers there are."""
    made = producers.select(F.col(result).alias(receiver))
    return consumers.join(made, receiver, "left_semi")


def agreement(rows: DataFrame, key: list[str], value: str, unknown: str = "ambiguous") -> DataFrame:
    """The one value that all rows of a key agree on; ``unknown`` if they don't."""
    seen = rows.groupBy(*key).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count("*").alias("n"), F.count(value).alias("__n"))
    agreed = (F.col("__lo") == F.col("__hi")) & (F.col("n") == F.col("__n"))
    return seen.select(*key, F.when(agreed, F.col("__lo").cast("string")).otherwise(F.lit(unknown)).alias(value), "n")


def direct_over_star(direct: DataFrame, star: DataFrame, key: list[str], value: str) -> DataFrame:
    """Direct exports win; among stars all must agree."""
    agreed = agreement(star, key, value).select(*key, F.col(value).alias("__star"))
    joined = direct.select(*key, F.col(value).alias("__direct")).join(agreed, key, "full_outer")
    return joined.select(*key, F.coalesce("__direct", "__star").alias(value))


def linked_string(local: Column, linked: Column) -> Column:
    """An argument's own constant, else the one that its import resolves to."""
    return F.coalesce(local, linked)
