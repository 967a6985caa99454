"""Operator 2, URL filters: pattern rules indexed by their rarest literal token.

Every rule has a regular expression and the literal tokens that any URL it
matches must hold. Tokens of all URLs are counted, each rule is filed under its
rarest one, URL tokens fetch candidate rules, and regular expressions run on
those candidates only. A rule without a literal token is a candidate for every URL. Of the rules that match, host rules win over patterns and
the longer rule wins within a kind.

The work is done once per distinct URL, so copies of one URL cost one row.
The rule index is broadcast while it has at most ``MAX_BROADCAST_RULES`` rows;
beyond that the same join shuffles by token.

Defined results: a null url, or one without ``://``, has empty host and path, no
rule and the verdict allow; an empty table gives an empty result; repeated rows
are judged alike; other columns of the input stay beside the new ones, but those
with the name of a new one (host, path, rule, pattern, verdict) are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ascii_lower

MAX_BROADCAST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """kind 0: host and path rule, written host/path; kind 1: a pattern."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    kind: int = 1


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the path starts with ``path``."""
    pattern = rf"^(?:[^/?#]*\.)?(?i:{re.escape(host)}){re.escape(path)}"
    tokens = tuple(re.findall(r"[a-z0-9]+", host.lower()))
    return Rule(host + path, verdict, pattern, tokens, 0)


# The host rules of the contract.
HOST_RULES = [
    host_rule("block", "net", "/"),
    host_rule("allow", "example.net", "/en/"),
    host_rule("block", "example.com", "/de/"),
    host_rule("allow", "org", "/fr/"),
]


def pattern_rule(name: str, verdict: str, pattern: str, *tokens: str) -> Rule:
    return Rule(name, verdict, pattern, tokens)


# Default patterns for pages that are rarely prose: adult, betting, shops' carts, log-ins, feeds.
PATTERN_RULES = [
    pattern_rule("adult-host", "block", r"(?i)^[^/?#]*\b(?:porn)\b", "porn"),
    pattern_rule("xxx-host", "block", r"(?i)^[^/?#]*\bxxx\b", "xxx"),
    pattern_rule("casino-host", "block", r"(?i)^[^/?#]*\bcasino\b", "casino"),
    pattern_rule("cart-page", "block", r"(?i)^[^?#]*/cart(?:/|$|[?#])", "cart"),
    pattern_rule("checkout-page", "block", r"(?i)^[^?#]*/checkout(?:/|$|[?#])", "checkout"),
    pattern_rule("login-page", "block", r"(?i)^[^?#]*/login(?:/|$|[?#])", "login"),
    pattern_rule("signup-page", "block", r"(?i)^[^?#]*/signup(?:/|$|[?#])", "signup"),
    pattern_rule("wp-admin", "block", r"(?i)^[^?#]*/wp-admin(?:/|$|[?#])", "wp", "admin"),
    pattern_rule("session-link", "block", r"(?i)[?&]phpsessid=", "phpsessid"),
    pattern_rule("reply-link", "block", r"(?i)[?&]replytocom=", "replytocom"),
    pattern_rule("rss-feed", "block", r"(?i)^[^?#]*\.rss(?:$|[?#])", "rss"),
]


def after_scheme():
    """The url from behind its first ``://``; empty without one. Patterns see this part."""
    return F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))


def with_parts(pages: DataFrame) -> DataFrame:
    """host and path: what stands after the first ``://``."""
    rest = after_scheme()
    before = F.regexp_extract(rest, r"^[^?#]*+", 0)
    host = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    path = F.regexp_extract(before, r"^[^/]*+([\s\S]*)$", 1)
    return pages.withColumn("host", ascii_lower(host)).withColumn("path", path)


def tokens_of(url):
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(url), F.lit(r"[a-z0-9]+"), F.lit(0)))


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """pages with host, path, rule (of a host rule), pattern (of a pattern) and verdict."""
    spark = pages.sparkSession
    rules = HOST_RULES + PATTERN_RULES if rules is None else rules
    urls = pages.select("url").where("url is not null").distinct()
    tokens = tokens_of(F.col("url"))
    if any(not r.tokens for r in rules):  # the empty token is in every URL
        tokens = F.array_append(tokens, "")
    seen = urls.select("url", F.explode(tokens).alias("token"))
    schema = "rule_id int, name string, rule_verdict string, pattern string, kind int, rank int, tokens array<string>"
    table = spark.createDataFrame(
        [(i, r.name, r.verdict, r.pattern, r.kind, len(r.name), [t.lower() for t in r.tokens] or [""]) for i, r in enumerate(rules)], schema
    )
    # Each rule's rarest token, by how many distinct URLs hold it.
    wanted = table.select("rule_id", F.explode("tokens").alias("token"))
    keys = wanted.select("token").distinct()
    small = len(rules) <= MAX_BROADCAST_RULES
    hint = F.broadcast if small else (lambda df: df)
    frequency = seen.join(hint(keys), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        wanted.join(frequency, "token", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("r", F.row_number().over(W.partitionBy("rule_id").orderBy("n", F.desc(F.length("token")), "token")))
        .where("r = 1")
        .select("rule_id", "token")
    )
    index = table.drop("tokens").join(rarest, "rule_id")
    hits = (
        seen.join(hint(index), "token")
        .where(F.rlike(after_scheme(), F.col("pattern")))
        .groupBy("url")
        .agg(
            F.max(F.when(F.col("kind") == 0, F.struct("rank", "name", "rule_verdict"))).alias("host_hit"),
            F.max(F.when(F.col("kind") == 1, F.struct("rank", "name", "rule_verdict"))).alias("pattern_hit"),
        )
    )
    clash = [c for c in pages.columns if c in ("host", "path", "rule", "pattern", "verdict", "host_hit", "pattern_hit")]
    return (
        with_parts(pages.drop(*clash))
        .join(hits, "url", "left")
        .withColumn("rule", F.col("host_hit.name"))
        .withColumn("pattern", F.when(F.col("host_hit").isNull(), F.col("pattern_hit.name")))
        .withColumn("verdict", F.coalesce("host_hit.rule_verdict", "pattern_hit.rule_verdict", F.lit("allow")))
        .drop("host_hit", "pattern_hit")
    )
