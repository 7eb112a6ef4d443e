"""Module specifiers and project paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def package_root(specifier: Column) -> Column:
    """First segment of a specifier, the first two if it is scoped."""
    parts = F.split(specifier, "/")
    return F.when(F.startswith(specifier, F.lit("@")), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.get(parts, F.lit(0)))


def is_internal_request(specifier: Column) -> Column:
    return specifier.rlike(r"^[./#]")


def normalize_path(path: Column) -> Column:
    """Resolves ``.`` and ``..``; null for absolute paths, drive prefixes and paths that leave the root."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    start = F.expr("named_struct('at', cast(array() AS array<string>), 'ok', true)")

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        skip = (part == ".") | (part == "")
        at = F.when(skip, acc["at"]).when(up, F.slice(acc["at"], 1, F.greatest(F.size(acc["at"]) - 1, F.lit(0)))).otherwise(F.concat(acc["at"], F.array(part)))
        return F.struct(at.alias("at"), (acc["ok"] & ~(up & (F.size(acc["at"]) == 0))).alias("ok"))

    folded = F.aggregate(parts, start, step, lambda acc: F.when(acc["ok"] & (F.size(acc["at"]) > 0), F.array_join(acc["at"], "/")))
    return F.when(~path.rlike(r"^([A-Za-z]:|/|\\)"), folded)


def glob_to_regex(pattern: str) -> str:
    """Anchored expression for a glob; a pattern without a slash fits a path's last name too."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^(?:.*/)?{out}$" if "/" not in pattern else f"^{out}$"
