"""The corpus pipeline: documents in, packed training sequences out.

Toxic documents go, one document of each group of near copies stays, personal data is
replaced, and what is left is packed. Each stage reads what its predecessor wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apisieve.llm import common, ngram_join, packing, pii, queries, toxicity

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies share PERCENT of their distinct shingles of WORDS words (op9's own query keeps its 3 and 90).
WORDS, PERCENT = 5, 80
#: SQL can express none of the stages' models; they are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; labels are learnt from two thirds of the labelled rows."""
    rows = toxicity.labelled(docs, common.table(spark, sf_dir, "labels"), lambda doc_id: common.crc_mod(doc_id, 3) != 1)
    return toxicity.score_documents(docs, toxicity.train(rows)).filter("predicted = 0").select(*DOCUMENT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of least id; of rows that repeat an id and text, one.
    Rows of one id with different texts are documents of their own. Rows without an id stay."""
    named = docs.filter("doc_id IS NOT NULL")
    texts = named.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"))
    shared = not texts.filter("lo <> hi").isEmpty()
    key = F.xxhash64("doc_id", "text") if shared else F.col("doc_id").cast("long")
    named = named.withColumn("key", key)
    groups = ngram_join.jaccard_components(named.select(F.col("key").alias("doc_id"), "text"), size=WORDS, percent=PERCENT, name="pipeline-jaccard")
    groups = common.cut(groups.select(F.col("doc_id").alias("key"), "component_id"), "pipeline-groups")
    if shared:  # keys have no order of ids
        ids = groups.distinct().join(named.select("key", "doc_id").distinct(), "key")
        least = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("least")).select("component_id", F.col("least.key").alias("key"))
        groups = groups.join(least, ["component_id", "key"], "left_semi")
    else:
        groups = groups.filter("key = component_id")
    kept = groups.groupBy("key").count()
    size = kept.agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    few = size["n"] <= ngram_join.BROADCAST_IDS
    single = named.join(F.broadcast(kept) if few else kept, "key", "left_semi")
    if (size["most"] or 0) > 1:
        single = single.dropDuplicates(["key"])
    return single.select(*DOCUMENT).unionByName(docs.filter("doc_id IS NULL").select(*DOCUMENT))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, and their new lengths."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return packing.digest(packing.pack_documents(docs, queries.tokenizer("byte_bpe_50k.json"), queries.pattern(), kept=200_000))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("pii", redact_pii), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs, f"pipeline-{name}")
    return docs
