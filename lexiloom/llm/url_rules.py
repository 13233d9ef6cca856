"""URL filter: pattern rules indexed by their rarest literal token.

Every rule names literal tokens that any URL it matches must contain. Over all URLs Spark counts how
often these tokens occur, files each rule under its rarest one, and lets the tokens of a URL fetch
candidate rules; only those run their regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import query, table, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
NOT_TOKEN = "[^A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` (Java syntax) is searched in host + path; ``tokens`` stand whole in whatever it matches."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def site_rule(verdict: str, site: str) -> Rule:
    """Rule for a host, its subdomains and a path prefix, such as ``example.com/en/``."""
    host, _, path = site.partition("/")
    literal = f"{host}/{path}"
    tokens = [t for t in re.split(NOT_TOKEN, literal.lower()) if t]
    if re.search(r"[A-Za-z0-9]$", literal):  # the last token may go on in the URL
        tokens = tokens[:-1]
    return Rule(site, verdict, rf"(?s)^(?:[^/]*\.)?{re.escape(literal)}", tuple(tokens))


def word_rule(verdict: str, word: str) -> Rule:
    """Rule for a word that stands whole anywhere in host or path, in either case."""
    return Rule(word, verdict, rf"(?is)(?<![A-Za-z0-9]){re.escape(word)}(?![A-Za-z0-9])", (word.lower(),))


SITE_RULES = (
    site_rule("allow", "com/"),
    site_rule("block", "example.com/en/"),
    site_rule("allow", "www.example.com/en/"),
    site_rule("block", "net/es/"),
    site_rule("block", "net/fr/"),
)
#: Words of a host or path that block a URL to which no site rule applies.
BLOCKED_WORDS = ("casino", "porn", "xxx", "viagra", "escort", "torrent", "warez", "malware", "spam", "phishing")
WORD_RULES = tuple(word_rule("block", w) for w in BLOCKED_WORDS)


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(text_or_empty(url), URL_PARTS, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(text_or_empty(url), URL_PARTS, 2)


def tokens_of(address: Column) -> Column:
    """Distinct literal tokens, in lower case."""
    parts = F.split(F.translate(address, UPPER, LOWER), NOT_TOKEN)
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def _rules_table(spark: SparkSession, site_rules: Iterable[Rule], more: Iterable[Rule]) -> DataFrame:
    rows = [(i == 0, r.name, r.verdict, r.pattern, list(r.tokens)) for i, rs in enumerate((site_rules, more)) for r in rs]
    for row in rows:
        if not row[4]:
            raise ValueError(f"rule {row[1]!r} has no literal token to be indexed by")
    return spark.createDataFrame(rows, "site boolean, rule string, verdict string, pattern string, tokens array<string>")


def judge_urls(
    pages: DataFrame,
    url_col: str = "url",
    site_rules: Iterable[Rule] = SITE_RULES,
    more_rules: Iterable[Rule] = WORD_RULES,
    default: str = "allow",
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and word_rule (struct column ``judged``).

    The longest site rule that fits decides; without one, the longest of ``more_rules``; without
    either, ``default``. Ties go to the name that sorts first. A null URL or one without ``://`` has
    an empty host and path and gets the default. Every row is kept, also repeated ones; input
    columns are returned untouched, except one already called ``judged``, which is replaced.
    """
    spark = pages.sparkSession
    rules = _rules_table(spark, site_rules, more_rules)
    address = F.concat("__host", "__path")
    rows = pages.drop("judged").withColumns({"__host": url_host(F.col(url_col)), "__path": url_path(F.col(url_col))})
    sites = rows.select("__host", "__path").distinct()
    tokens = sites.select("__host", "__path", F.explode(tokens_of(address)).alias("token"))
    filed = rules.withColumn("token", F.explode("tokens")).drop("tokens")
    wanted = filed.select("token").distinct()
    counts = tokens.join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("site", "rule", "pattern").orderBy(F.coalesce("n", F.lit(0)), "token")
    index = filed.join(counts, "token", "left").withColumn("k", F.row_number().over(rarest)).filter("k = 1").drop("k", "n")

    hits = tokens.join(index, "token").filter(F.call_function("rlike", address, F.col("pattern")))

    def best(kind: Column) -> Column:
        first = F.min(F.when(kind, F.struct((-F.length("rule")).alias("size"), "rule", "verdict")))
        return F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict"))

    found = hits.groupBy("__host", "__path").agg(
        best(F.col("site")).alias("__site"), best(~F.col("site")).alias("__word")
    )
    judged = F.struct(
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__site.rule").alias("rule"),
        F.coalesce("__site.verdict", "__word.verdict", F.lit(default)).alias("verdict"),
        F.col("__word.rule").alias("word_rule"),
    )
    return rows.join(found, ["__host", "__path"], "left").select(
        *[F.col(c) for c in pages.columns if c != "judged"], judged.alias("judged")
    )


def _sql() -> str:
    sites = ", ".join(f"('{r.name}', '{r.verdict}')" for r in SITE_RULES)
    words = "|".join(BLOCKED_WORDS)
    return rf"""
WITH u AS (SELECT row_number() OVER () AS k, page_id,
    translate(regexp_extract(coalesce(url, ''), '{URL_PARTS}', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '{URL_PARTS}', 2) AS path FROM pages),
r(rule, v) AS (VALUES {sites}),
f AS (SELECT k, rule, v, row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC, rule) AS n FROM u, r
  WHERE ('.' || host) LIKE '%.' || split_part(rule, '/', 1)
    AND starts_with(path, substr(rule, strpos(rule, '/'))))
SELECT page_id, host, path, rule,
  coalesce(v, CASE WHEN regexp_matches(host || path, '(?i)(^|[^A-Za-z0-9])({words})([^A-Za-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f ON u.k = f.k AND f.n = 1"""


@query("op7_url_rules", _sql())
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")
