"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows written into the plan itself, so that no Python worker makes them."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(t).alias(c) for v, (c, t) in zip(row, fields, strict=True)]) for row in rows]
    empty = F.array().cast("array<struct<" + ",".join(f"{c}:{t}" for c, t in fields) + ">>")
    return spark.range(1).select(F.inline(F.array(*structs) if rows else empty))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests on one machine) a temporary folder is made and remembered.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        found = "file://" + tempfile.mkdtemp(prefix="apisieve-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    and a lost executor costs only the tasks it ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def discard(*frames: DataFrame | None) -> None:
    """Deletes the tables that ``cut`` wrote for these frames; nothing may read them any more."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path is not None:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % F.lit(n)


#: Rows of an Arrow batch: texts are a few kilobytes, some a hundred times that.
BATCH_ROWS = 500


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what a Python worker holds at once; rows here are whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: What modules keep in a Python worker between tasks.
KEPT = (("apisieve.llm.packing", "chunks_of"),)


def trim() -> None:
    """Gives this process's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def tidy(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``run`` for Python workers that operators before have used: what these keep goes first, what ``run`` freed goes at its end."""

    def tidied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for module, name in KEPT:
            if (found := sys.modules.get(module)) is not None:
                getattr(found, name).cache_clear()
        trim()
        yield from run(batches)
        trim()

    return tidied


def settle(spark: SparkSession) -> None:
    """Lets go of spent plans and of their broadcast tables and shuffle files, here and on the executors:
    else they stay until the driver's heap happens to be full."""
    gc.collect()
    trim()
    spark._jvm.System.gc()
