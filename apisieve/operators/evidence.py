"""From occurrences to evidence groups and findings.

Evidence is possible if any occurrence is; a finding is definite if any of its
evidence is. The two rules differ on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_evidence(occurrences: DataFrame, key: list[str], order: list[str], definite: str = "definite") -> DataFrame:
    """Per key: ``count`` before duplicates go, distinct occurrences in order, certainty."""
    place = F.struct(*order)
    return occurrences.groupBy(*key).agg(
        F.count("*").alias("count"),
        F.array_sort(F.collect_set(place)).alias("occurrences"),
        F.when(F.bool_and(definite), "definite").otherwise("possible").alias("certainty"),
    )


def present(occurrences: DataFrame, key: list[str], order: list[str], per_group: int, groups: int, scope: list[str]) -> DataFrame:
    """At most ``per_group`` first occurrences of each group, and of each scope the ``groups``
    first groups by their first place; ``truncated`` if anything of a group, or any group, was cut.

    Ranks are taken in windows of one group and of one scope's group heads, so nothing is collected.
    """
    own = Window.partitionBy(*scope, *key).orderBy(*order)
    whole = Window.partitionBy(*scope, *key)
    ranked = occurrences.withColumns({"rank": F.row_number().over(own), "total": F.count("*").over(whole)}).filter(F.col("rank") <= per_group)
    heads = ranked.filter("rank = 1").select(*scope, *key, F.row_number().over(Window.partitionBy(*scope).orderBy(*order, *key)).alias("group_rank"), F.count("*").over(Window.partitionBy(*scope)).alias("n_groups"))
    kept = heads.filter(F.col("group_rank") <= groups)
    return ranked.join(kept, [*scope, *key]).withColumn("truncated", (F.col("total") > per_group) | (F.col("n_groups") > groups)).drop("n_groups")


def merge_findings(findings: DataFrame, key: list[str], definite: str = "definite") -> DataFrame:
    """Findings of one rule at one place become one, definite if any is."""
    return findings.groupBy(*key).agg(F.count("*").alias("merged"), F.when(F.bool_or(definite), "definite").otherwise("possible").alias("certainty"))


def outermost(ranges: DataFrame, scope: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Ranges that lie in no other one of their scope; of equal ones the first stays."""
    earlier = Window.partitionBy(*scope).orderBy(F.col(start).asc(), F.col(end).desc()).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(earlier)
    return ranges.withColumn("__reach", reach).filter(F.col("__reach").isNull() | (F.col(end) > F.col("__reach"))).drop("__reach")


def absorb(ranges: DataFrame, scope: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Every range with ``into_start``: the start of the newest retained range that begins no later."""
    order = Window.partitionBy(*scope).orderBy(F.col(start).asc(), F.col(end).desc())
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = ranges.withColumn("__kept", F.when(reach.isNull() | (F.col(end) > reach), F.col(start)))
    return df.withColumn("into_start", F.last("__kept", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__kept")


def in_order(findings: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """The report's order as a number, within each scope."""
    return findings.withColumn("position", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))
