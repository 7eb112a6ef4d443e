"""Ordered enumerations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("info", "warning", "error")
CONFIDENCES = ("high", "medium", "low")


def _rank(value: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(None).cast("int")
    for k, name in enumerate(names):
        out = F.when(value == name, k).otherwise(out)
    return out


def severity_rank(value: Column) -> Column:
    return _rank(value, SEVERITIES)


def confidence_meets(value: Column, least: str) -> Column:
    """High meets every level; low only low."""
    return _rank(value, CONFIDENCES) <= CONFIDENCES.index(least)
