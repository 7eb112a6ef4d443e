"""The registered queries of this subpackage: thin wrappers that derive the stated
columns from the operators' outputs, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, lattice, lbl, ngram_join, oph, packing, pii, toxicity, urlfilter
from .common import crc_mod, literal_rows, table

#: Host and path rules of op6, with their verdicts.
OP6_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[pii.count_kind(F.col("base_spans"), kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(F.encode("base_spans", "UTF-8"), 256).alias("base_sha256"),
        "spans",
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    words = "</s>[INST] ok [/INST]"
    extra = literal_rows(spark, [(-7, 0, "user", words), (-7, 1, "assistant", words)], "conv_id long, turn long, role string, text string")
    done = chat.format_reply_trees(chat.conversations_as_trees(rows.unionByName(extra)), branches=1)
    roles, texts = chat.parse(F.col("formatted"))
    done = done.select("conv_id", "formatted", "loss_spans", roles.alias("roles"), texts.alias("texts"))
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    loss = F.array_join(
        F.transform("loss_spans", lambda s: chat.unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )
    done = done.select("conv_id", "formatted", F.size("roles").cast("long").alias("n_turns"), turns.alias("turns"), loss.alias("loss"))
    return done.select(
        "conv_id",
        "n_turns",
        F.sha2(F.encode("turns", "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*(?:\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>))', '\1\\\2', 'g'))
    + length(role) + length('<|im_start|><|im_sep|><|im_end|>') + 1 AS chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e WHERE conv_id IS NOT NULL GROUP BY conv_id
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), pattern(), end_id=0)
    return packing.digest(pieces)


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.labelled(docs, table(spark, sf_dir, "labels"), lambda doc_id: crc_mod(doc_id, 3) != 1)
    scored = toxicity.score_documents(docs, toxicity.train(rows))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [urlfilter.host_rule(t, v) for t, v in OP6_RULES] + list(urlfilter.PATTERNS)
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), rules)


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM q)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host, '(^|[.-])(casino|spam|poker|viagra|porn|xxx|warez)([.-]|$)') THEN 'block'
  WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9])(best|buy|cheap|discount|download|free|live|online|order|win)([^A-Za-z0-9]+[A-Za-z0-9]+){0,2}[^A-Za-z0-9]+(betting|casino|cialis|crack|diploma|escort|essays|followers|jackpot|keygen|loans|lottery|pills|poker|porn|replica|slots|viagra|warez|xxx)([^A-Za-z0-9]|$)') THEN 'block'
  WHEN regexp_matches(host || path, '^[^/]*/([^/]*/)*(ad-click|affiliate-offers|doorway-page|free-followers|link-exchange|link-farm|paid-links|parked-domain|spam-trap)(/|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oph.fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("byte_bpe_multi_50k.tiktoken")
    coded = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern())
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lbl.score_documents(docs, crc_mod(F.col("doc_id"), 10) != 0)


QUERIES = {f.__name__: f for f in (op1_pii, op2_chat_format, op3_packing, op4_lattice, op5_toxicity, op6_url_filter, op7_fingerprints, op8_bpe, op9_ngram_join, op10_language_model)}
ORACLES = {"op2_chat_format": OP2_SQL, "op6_url_filter": OP6_SQL}
