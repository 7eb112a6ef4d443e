"""Constant evaluation over columns: unknown is null, and null makes the result unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_add(a_text: Column, a_number: Column, b_text: Column, b_number: Column) -> Column:
    """struct<text, number> of ``a + b``: text if either side is text, else a checked whole-number sum."""
    known = (a_text.isNotNull() | a_number.isNotNull()) & (b_text.isNotNull() | b_number.isNotNull())
    is_text = a_text.isNotNull() | b_text.isNotNull()
    text = F.concat(F.coalesce(a_text, a_number.cast("string")), F.coalesce(b_text, b_number.cast("string")))
    return F.struct(F.when(known & is_text, text).alias("text"), F.when(known & ~is_text, F.try_add(a_number, b_number)).alias("number"))


def js_template(*parts: Column, most: int = 16 * 1024) -> Column:
    """Text of a template literal; unknown if a part is, or if it grows beyond ``most`` bytes."""
    whole = F.concat(*parts)
    return F.when(F.octet_length(whole) <= most, whole)


def js_object_merge(*objects: Column) -> Column:
    """Spread of objects: later keys win."""
    entries = F.flatten(F.array(*[F.map_entries(o) for o in objects]))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


def property_key(text: Column, number: Column) -> Column:
    return F.coalesce(text, number.cast("string"))
