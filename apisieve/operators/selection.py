"""Which rules run: a baseline, then ordered overrides of which the last that fits wins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import confidence_meets


def selector_to_regex(selector: str) -> str:
    """``provider:name`` with ``*`` for any stretch."""
    return "^" + ".*".join(re.escape(p) for p in selector.split("*")) + "$"


def select_rules(rules: DataFrame, overrides: DataFrame, baseline: str = "all", least: str = "high") -> DataFrame:
    """rules: rule_id, confidence. overrides: ordinal, pattern, enabled. Adds ``enabled``.

    Both are catalogs: bounded by what people write, so the overrides are broadcast.
    """
    start = {"all": F.lit(True), "none": F.lit(False), "confidence": confidence_meets(F.col("confidence"), least)}[baseline]
    hits = rules.join(F.broadcast(overrides), F.expr("rlike(rule_id, pattern)"))
    last = hits.groupBy("rule_id").agg(F.max_by("enabled", "ordinal").alias("__last"))
    return rules.join(last, "rule_id", "left").select(*rules.columns, F.coalesce("__last", start).alias("enabled"))


def unmatched_overrides(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides that fit no rule, which is an error of the configuration."""
    return overrides.join(rules.select("rule_id"), F.expr("rlike(rule_id, pattern)"), "left_anti")
