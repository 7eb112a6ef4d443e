"""Reports: summaries, comparisons, expectations, digests and sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity_rank
from ..functions.ranks import SEVERITIES

REPORT_VERSION = 1


def compare_counts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Histograms side by side; only keys whose counts differ."""
    a = before.groupBy(key).agg(F.count("*").alias("before"))
    b = after.groupBy(key).agg(F.count("*").alias("after"))
    both = a.join(b, key, "full_outer").select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return both.filter("before <> after")


def check_expectations(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """expected: key, ``count`` (null: one at least; 0: forbidden). found: one row a finding. Status of every key."""
    n = found.groupBy(*key).agg(F.count("*").alias("found"))
    both = expected.withColumn("__listed", F.lit(True)).join(n, key, "full_outer").withColumn("found", F.coalesce("found", F.lit(0)))
    status = (
        F.when(F.col("__listed").isNull(), "unexpected")
        .when(F.col("count").isNull(), F.when(F.col("found") > 0, "met").otherwise("missing"))
        .when(F.col("count") == F.col("found"), "met")
        .when(F.col("count") == 0, "forbidden")
        .otherwise("wrong count")
    )
    return both.select(*key, "found", status.alias("status"))


def merge_occurrences(base: DataFrame, overlay: DataFrame, key: list[str], place: list[str]) -> DataFrame:
    """Occurrences of a base and its overlay in one order per key; those at the same place of a
    key stay as often as they are there. ``position`` counts from 1."""
    both = base.select(*key, *place).unionByName(overlay.select(*key, *place))
    return both.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy(*place)).cast("long"))


def distinct_occurrences(rows: DataFrame, key: list[str], place: list[str]) -> DataFrame:
    """One row for each place of a key."""
    return rows.dropDuplicates([*key, *place])


def merge_reports(reports: DataFrame, counters: list[str]) -> DataFrame:
    """Reports of parts as one: counters are added, it is partial if any part is."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters]
    return reports.agg(*sums, F.coalesce(F.bool_or("is_partial"), F.lit(False)).alias("is_partial"))


def evidence_metrics(findings: DataFrame, traces: str) -> DataFrame:
    """``traces``: an array of traces, each an array of steps. Totals of both; null traces count as none."""
    steps = F.aggregate(F.col(traces), F.lit(0).cast("long"), lambda n, t: n + F.greatest(F.size(t), F.lit(0)))
    return findings.agg(
        F.coalesce(F.sum(F.greatest(F.size(traces), F.lit(0)).cast("long")), F.lit(0)).alias("n_traces"),
        F.coalesce(F.sum(F.coalesce(steps, F.lit(0))), F.lit(0)).alias("n_steps"),
    )


def lower_median(column: str) -> Column:
    """The sorted element at (n - 1) / 2, never an average."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}`)")


def digest(parts: Column) -> Column:
    """SHA-256 over ordered parts, one separator between them."""
    return F.sha2(F.array_join(parts, "\n"), 256)


def failing(findings: DataFrame, fail_on: str) -> DataFrame:
    """Findings at or above the threshold; none for ``never``."""
    if fail_on == "never":
        return findings.limit(0)
    return findings.filter(severity_rank(F.col("severity")) >= SEVERITIES.index(fail_on))


def exit_status(findings: DataFrame, fail_on: str) -> int:
    return 0 if failing(findings, fail_on).isEmpty() else 1


def write_json(findings: DataFrame, diagnostics: DataFrame, path: str) -> None:
    """The versioned report as JSON lines, in one folder a kind; executors write it."""
    for name, df in (("findings", findings), ("diagnostics", diagnostics)):
        df.select(F.lit(REPORT_VERSION).alias("schema_version"), "*").write.mode("overwrite").json(f"{path}/{name}")


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A table for people; for listings of rules and other bounded rows."""
    lines = ["| " + " | ".join(columns) + " |", "|" + " - |" * len(columns)]
    lines += ["| " + " | ".join(str(r.get(c, "")) for c in columns) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def stale(document: str, rows: list[dict], columns: list[str]) -> bool:
    """Check mode of a generated document."""
    return document != markdown(rows, columns)


def pretty(findings: list[dict], sources: dict[str, str], width: int = 100) -> str:
    """Findings by rule with the lines they point at; tabs are four columns, wide characters two."""
    import unicodedata

    def shown(text: str) -> str:
        out, used = "", 0
        for c in text.replace("\t", "    "):
            w = 2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1
            if used + w > width:
                break
            out, used = out + c, used + w
        return out

    lines: list[str] = []
    for rule in sorted({f["rule_id"] for f in findings}):
        lines.append(rule)
        for f in sorted((f for f in findings if f["rule_id"] == rule), key=lambda f: (f["path"], f["start_line"], f["start_col"])):
            lines.append(f"  {f['path']}:{f['start_line']}:{f['start_col']} {f['severity']} {f['message']} ({f['certainty']})")
            text = sources.get(f["path"], "").splitlines()
            if 0 < f["start_line"] <= len(text):
                lines.append("    | " + shown(text[f["start_line"] - 1]))
    return "\n".join(lines) + "\n"


def as_json(row: dict) -> str:
    return json.dumps({"schema_version": REPORT_VERSION, **row}, indent=2, sort_keys=True)
