"""Connected components of links, by alternating large and small stars.

Every round is a few aggregations and joins; links never leave the executors. Each
round is written to the shared folder, which cuts the lineage. The rounds grow with
the logarithm of the longest chain, and end when the links are stars on the least
member of each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _links(df: DataFrame) -> DataFrame:
    return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def components(links: DataFrame, name: str = "links", rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b) that is not its component's least one."""
    now = cut(_links(links), name)
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, cut(_links(small.unionByName(low.select("a", F.col("m").alias("b")))), name)
        discard(last)
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        before, state = state, (row["n"], row["h"])
        if state == before or not row["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError(f"components: not stable after {rounds} rounds")
