"""Parquet tables, and adapters that show them as facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import complete
from ..shipping import ship

__all__ = ["complete", "table", "texts_as_strings", "urls_as_imports"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_as_strings(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every row's text as a string reference."""
    return complete(df.select(F.lit(key).alias("path"), F.col(key).alias("fact_id"), F.lit("string_reference").alias("kind"), F.col(text).alias("text"), F.lit(True).alias("definite")))


def urls_as_imports(pages: DataFrame) -> DataFrame:
    """Every URL as an import of host and path."""
    module = F.regexp_extract("url", r"://([^?#]*)", 1)
    return complete(pages.select(F.lit("pages").alias("path"), F.col("page_id").alias("fact_id"), F.lit("import").alias("kind"), module.alias("module"), F.lit(True).alias("definite")))
