"""Source files: scans, bounds, boundaries, globs, manifests, samples and frontier reads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import glob_to_regex
from ..operators.graph import cut

EXTENSIONS = ("js", "cjs", "mjs", "ts", "cts", "mts")
MAX_BYTES, MAX_FILES, MAX_TOTAL = 8 << 20, 10_000, 512 << 20


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, n_bytes) of the source files below a folder; listing and reading are Spark's."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root)
    base = F.lit(root.rstrip("/") + "/")
    rest = F.regexp_replace("path", r"^file:/+", "/")
    path = F.when(F.startswith(rest, base), F.substring(rest, F.length(base) + 1, F.length(rest))).otherwise(rest)
    return files.select(path.alias("path"), "content", F.col("length").alias("n_bytes")).filter(~F.col("path").rlike(r"\.d\.[cm]?ts$"))


def language(path: Column) -> Column:
    return F.when(path.rlike(r"\.[cm]?ts$"), "TypeScript").otherwise("JavaScript")


def classify(path: Column, excluded: Sequence[str] = ("node_modules", ".git")) -> Column:
    """accepted, excluded, unsupported or outside."""
    parts = F.split(path, "/")
    return (
        F.when(path.rlike(r"^(\.\.(/|$)|/|[A-Za-z]:)"), "outside")
        .when(F.arrays_overlap(parts, F.array(*[F.lit(e) for e in excluded])), "excluded")
        .when(~path.rlike(rf"\.({'|'.join(EXTENSIONS)})$") | path.rlike(r"\.d\.[cm]?ts$"), "unsupported")
        .otherwise("accepted")
    )


def included(path: Column, include: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """Fits an include and no exclude pattern."""
    fits = lambda globs: reduce(or_, [path.rlike(glob_to_regex(g)) for g in globs], F.lit(False))
    return fits(include) & ~fits(exclude)


def admit(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files within the size bound that are UTF-8, decoded; ``refused`` tells of the others."""
    sound = (F.octet_length("content") <= max_bytes) & F.is_valid_utf8(F.col("content").cast("string"))
    return files.filter(sound).select("path", F.decode("content", "UTF-8").alias("text"), F.octet_length("content").alias("n_bytes"))


def refused(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, code) of the files that ``admit`` leaves out."""
    code = F.when(F.octet_length("content") > max_bytes, "too large").when(~F.is_valid_utf8(F.col("content").cast("string")), "invalid encoding")
    return files.select("path", code.alias("code")).filter("code IS NOT NULL")


def admission_problems(files: DataFrame) -> DataFrame:
    """Paths given more than once."""
    return files.groupBy("path").count().filter("count > 1").select("path", F.lit("duplicate path").alias("code"))


def within_budget(files: DataFrame, max_files: int = MAX_FILES, max_total: int = MAX_TOTAL) -> bool:
    n = files.agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b")).first()
    return n["n"] <= max_files and (n["b"] or 0) <= max_total


def manifest(files: DataFrame) -> DataFrame:
    """(path, n_bytes, digest): what a corpus holds."""
    return files.select("path", "n_bytes", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))


def changed(manifest_before: DataFrame, now: DataFrame) -> DataFrame:
    """Files that are missing, new or different."""
    a = manifest_before.select("path", F.col("digest").alias("before"))
    b = now.select("path", F.col("digest").alias("now"))
    return a.join(b, "path", "full_outer").filter(~F.col("before").eqNullSafe(F.col("now")))


def sample(files: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` files, the same for a seed whatever the partitioning."""
    return files.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(n)


def input_order(results: DataFrame) -> DataFrame:
    """Results of a batch in the order of its inputs, as a number."""
    return results.withColumn("position", F.row_number().over(Window.partitionBy("batch").orderBy("idx")))


def close_frontier(sources: DataFrame, imports: DataFrame, entries: DataFrame, waves: int = 1000) -> DataFrame:
    """(path, wave) of every file that the entries reach through internal imports (importer, target).

    A wave joins only the files found in the last one; targets that are no files end there.
    """
    known = sources.select("path")
    seen = cut(entries.select("path").distinct().join(known, "path", "left_semi").withColumn("wave", F.lit(0)))
    frontier = seen.select("path")
    for wave in range(1, waves):
        new = frontier.join(imports, frontier["path"] == imports["importer"]).select(F.col("target").alias("path")).distinct()
        new = cut(new.join(known, "path", "left_semi").join(seen, "path", "left_anti").withColumn("wave", F.lit(wave)))
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new))
        frontier = new.select("path")
    return seen
