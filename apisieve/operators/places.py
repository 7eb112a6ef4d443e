"""Byte offsets of findings as lines and columns.

Lines end at ``\\n`` only, so a ``\\r`` before it is the line's last character. Lines and
columns count from 1, columns in code points. An offset inside a character belongs to it.

Line starts and offsets of one source are merged by one window (an as-of join), so a
source of many lines and many findings costs their sum, and each line's text is cut once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_starts(sources: DataFrame) -> DataFrame:
    """(path, line, at, content): every line of every source and the byte it starts at. Null texts are empty."""
    lines = sources.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "content"))
    before = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.octet_length("content") + 1).over(before), F.lit(0)).cast("long")
    return lines.select("path", (F.col("n") + 1).cast("long").alias("line"), at.alias("at"), "content")


def chars_within(content: Column, n_bytes: Column) -> Column:
    """Code points of ``content`` that begin before its first ``n_bytes`` bytes end: bytes that don't continue a character."""
    head = F.substring(F.encode(content, "UTF-8"), F.lit(1), n_bytes.cast("int"))
    # Latin-1 makes a character of every byte; those from 0x80 to 0xBF continue one.
    return F.length(F.regexp_replace(F.decode(head, "ISO-8859-1"), "[\u0080-¿]", ""))


def with_position(rows: DataFrame, sources: DataFrame, offset: str, line: str, column: str) -> DataFrame:
    """Adds line and column of the byte ``offset``; both are null where the path has no source or the offset is null."""
    names = rows.columns
    own = rows.select("path", F.col(offset).alias("at"), F.lit(1).alias("turn"), F.lit(None).cast("struct<line:bigint,at:bigint,content:string>").alias("start"), F.struct(*names).alias("row"))
    marks = line_starts(sources).select("path", "at", F.lit(0).alias("turn"), F.struct("line", "at", "content").alias("start"), F.lit(None).cast(own.schema["row"].dataType).alias("row"))
    newest = F.last("start", ignorenulls=True).over(Window.partitionBy("path").orderBy(F.col("at").asc_nulls_first(), "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = marks.unionByName(own).withColumn("start", newest).filter("turn = 1")
    into = F.when(F.col("at").isNotNull(), F.col("at") - F.col("start.at"))
    return found.select(
        *[F.col("row")[c].alias(c) for c in names],
        F.when(into.isNotNull(), F.col("start.line")).alias(line),
        F.when(into.isNotNull(), chars_within(F.col("start.content"), into) + 1).cast("long").alias(column),
    )


def located(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """Findings (path, start, end in bytes) with start_line, start_col, end_line and end_col."""
    return with_position(with_position(findings, sources, "start", "start_line", "start_col"), sources, "end", "end_line", "end_col")
