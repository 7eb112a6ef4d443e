"""URL filter: pattern rules found through their rarest literal token.

Every rule is a regular expression over ``host || path`` with the literal tokens
(maximal runs of letters and digits) that any URL it fits must contain. Token
counts over all URLs choose the rarest of them as the rule's key. A URL's own
tokens then fetch candidate rules by an equi-join, and only those candidates run
their expression. Rules without a safe token are candidates for every URL.

Distinct (host, path) pairs are judged once, so repeated URLs cost one judgement.

Defined cases: null urls and urls without ``://`` have an empty host and path and
fit no rule; of fitting rules of one rank the greater label, then ``block``, decides; repeated rows are each returned; columns of the input other than the
id and the url are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import literal_rows

#: Beyond so many index rows the index is shuffled instead of broadcast.
BROADCAST_ROWS = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``label`` is null for pattern rules; ``rank`` orders fitting rules, highest first."""

    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int
    label: str | None = None


def bounded_tokens(literal: str) -> tuple[str, ...]:
    """Tokens of a literal prefix that are whole tokens in every URL it fits:
    the last one counts only if a delimiter follows it inside the literal."""
    return tuple(dict.fromkeys(re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", literal)))


def host_rule(text: str, verdict: str) -> Rule:
    """``example.com/en/``: the host and its subdomains, paths that start with ``/en/``; longest wins."""
    host, slash, path = text.partition("/")
    return Rule(r"^(?:[^/]*\.)?" + re.escape(host + slash + path), bounded_tokens(text), verdict, 1000 + len(text), text)


def word_rule(word: str, verdict: str = "block") -> Rule:
    """A word that stands alone, between dots or hyphens, anywhere in the host."""
    return Rule(rf"^(?:[^/]*[.-])?{re.escape(word)}(?:[./-]|$)", (word,), verdict, 1)


def phrase_rule(first: str, second: str, verdict: str = "block") -> Rule:
    """Two whole tokens in this order, with two other tokens between them at most, anywhere in the URL."""
    return Rule(rf"(?:^|[^A-Za-z0-9]){first}(?:[^A-Za-z0-9]+[A-Za-z0-9]+){{0,2}}[^A-Za-z0-9]+{second}(?:[^A-Za-z0-9]|$)", (first, second), verdict, 1)


def section_rule(name: str, verdict: str = "block") -> Rule:
    """A whole segment of the path."""
    return Rule(rf"^[^/]*/(?:[^/]*/)*{re.escape(name)}(?:/|$)", tuple(name.split("-")), verdict, 1)


#: The method's own rules: words of link farms and of gambling or adult hosts, ...
WORDS = ("casino", "spam", "poker", "viagra", "porn", "xxx", "warez")
#: ... what is advertised and how, ...
OFFERS = ("best", "buy", "cheap", "discount", "download", "free", "live", "online", "order", "win")
GOODS = ("betting", "casino", "cialis", "crack", "diploma", "escort", "essays", "followers", "jackpot", "keygen", "loans", "lottery", "pills", "poker", "porn", "replica", "slots", "viagra", "warez", "xxx")
#: ... and sections of sites. Letters of paths count as they are.
SECTIONS = ("ad-click", "affiliate-offers", "doorway-page", "free-followers", "link-exchange", "link-farm", "paid-links", "parked-domain", "spam-trap")
PATTERNS = (*map(word_rule, WORDS), *(phrase_rule(a, b) for a in OFFERS for b in GOODS), *map(section_rule, SECTIONS))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (label of the rule that decided, if it has one), verdict."""
    spark = pages.sparkSession
    host, path = split_url(pages[url_col])
    pages = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    keys = pages.select("host", "path").distinct()
    tokens = keys.select("host", "path", F.explode(F.array_distinct(F.split(F.concat("host", "path"), "[^A-Za-z0-9]+"))).alias("token"))

    rule_rows = literal_rows(
        spark,
        [(i, r.pattern, r.verdict, r.rank, r.label) for i, r in enumerate(rules)],
        "rule_id int, pattern string, verdict string, rank int, rule string",
    )
    rule_tokens = literal_rows(spark, [(i, t) for i, r in enumerate(rules) for t in r.tokens], "rule_id int, token string")
    small = sum(len(r.tokens) for r in rules) <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)

    wanted = rule_tokens.select("token").distinct()
    counts = tokens.join(hint(wanted), "token").groupBy("token").agg(F.count("*").alias("n"))
    index = (
        rule_tokens.join(counts, "token", "left")
        .groupBy("rule_id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
        .select("rule_id", F.col("rarest.token").alias("token"))
        .join(rule_rows, "rule_id")
    )
    candidates = tokens.join(hint(index), "token")
    loose = [i for i, r in enumerate(rules) if not r.tokens]
    if loose:
        every = keys.withColumn("rule_id", F.explode(F.array(*[F.lit(i) for i in loose])))
        candidates = candidates.drop("token").unionByName(every.join(hint(rule_rows), "rule_id").select("host", "path", "rule_id", "pattern", "verdict", "rank", "rule"))
    fits = candidates.filter(F.expr("rlike(concat(host, path), pattern)"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("rank", "rule", "verdict")).alias("best"))
    return pages.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
