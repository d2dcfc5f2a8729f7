"""URL filter lists by hashed expressions.

A rule (host, path, verdict) fits a url whose host is the rule's host or one of its subdomains and whose path starts
with the rule's path. Every url is expanded into expressions: each suffix of its host at a dot, put before each prefix
of its path that ends with a slash (and before the empty one). A rule is filed under the expression of its host and its
path up to the last slash, so each url that it fits has that expression. Both sides meet on the first ``PREFIX`` hex
digits of the expression's SHA-256, a short key that different expressions may share; a candidate is then confirmed
by the full SHA-256 of the rule's host and whole path, against the url's host suffix and as many characters of its
path. Of the rules that fit, the one with the longest text wins, then the longer host, then ``block``.

Expressions deeper than any rule's can fit none and are not made. Urls are reduced to distinct (host, path) before they
are expanded, and only those that some rule fits are joined back to the rows.

Defined results: a null url or one without ``://`` has an empty host and path; a url that no rule fits, those included,
gets the default verdict and no rule; rows with equal ids or urls are judged alike, and each is returned; of two equal
rules with different verdicts ``block`` wins; a rule with a null part fits nothing; without rows or rules nothing fails.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PREFIX = 8  # hex digits of the short key: 32 bits
DEFAULT = "allow"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``host, path, verdict`` of a short list of rules; a long list is a table of that form."""
    rows = json.dumps([{"host": h, "path": p, "verdict": v} for h, p, v in rules])
    one = spark.range(1).select(F.from_json(F.lit(rows), "array<struct<host:string,path:string,verdict:string>>").alias("r"))
    return one.select(F.inline("r"))


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, its A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What stands after the host up to the next ``?`` or ``#``."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _filed(rules: DataFrame) -> DataFrame:
    """Rules with the short key of their expression, their full digest and their depth."""
    known = rules.select(rules["host"].alias("r_host"), rules["path"].alias("r_path"), rules["verdict"].alias("verdict")) \
        .where("r_host IS NOT NULL AND r_path IS NOT NULL AND verdict IS NOT NULL")
    folder = F.regexp_extract("r_path", "(?s)^(.*/)?", 0)
    text = F.concat("r_host", "r_path")
    return known.select(
        F.substr(_digest(F.concat("r_host", folder)), F.lit(1), F.lit(PREFIX)).alias("key"), _digest(text).alias("full"),
        F.length("r_path").alias("r_length"), text.alias("rule"), "verdict", F.length("r_host").alias("h_length"),
        F.size(F.split("r_host", "\\.")).alias("labels"), F.size(F.split(folder, "/")).alias("folders"))


def expressions(urls: DataFrame, labels: int, folders: int) -> DataFrame:
    """``host, path, suffix, key`` of every expression of ``urls(host, path)`` with at most so many labels and folders."""
    parts = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
                           lambda n: F.concat_ws(".", F.slice(parts, -n, n)))
    steps = F.split("path", "/")  # a path with s slashes has s + 1 steps, and s + 1 prefixes with the empty one
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(steps), F.lit(folders)) - 1),
                           lambda n: F.when(n == 0, "").otherwise(F.concat(F.concat_ws("/", F.slice(steps, F.lit(1), n)), F.lit("/"))))
    return (urls.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
            .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
            .select("host", "path", "suffix",
                    F.substr(_digest(F.concat("suffix", "prefix")), F.lit(1), F.lit(PREFIX)).alias("key")))


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, verdict`` of those of the distinct ``urls(host, path)`` that some rule fits."""
    filed = _filed(rules)
    deepest = filed.agg(F.max("labels"), F.max("folders")).first()
    found = expressions(urls, deepest[0] or 0, deepest[1] or 0) if deepest[0] else expressions(urls.where("false"), 1, 1)
    text = F.concat("suffix", F.substr("path", F.lit(1), F.col("r_length")))
    # The candidates of a key: a rule list may hold more than one, of which the confirmed ones remain.
    fits = found.join(filed, "key").where((F.length("suffix") == F.col("h_length")) & (_digest(text) == F.col("full")))
    rank = F.struct(F.length("rule"), "h_length", (F.col("verdict") == "block").alias("stops"), "rule")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = DEFAULT) -> DataFrame:
    """``<id>, host, path, rule, verdict`` of every row."""
    url = pages[f"`{url_col}`"]
    rows = pages.select(pages[f"`{id_col}`"].alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    best = judged(rows.select("host", "path").distinct(), rules)
    return rows.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


OP13_SQL = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS row FROM parts),
rules(host, path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
best AS (
  SELECT s.row, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
    arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
  GROUP BY s.row)
SELECT page_id, s.host, s.path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM split s LEFT JOIN best USING (row)"""
