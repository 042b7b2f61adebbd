"""URL filters: rules found by their rarest literal token, then run as regular expressions.

A rule's literals are tokens (runs of a-z and 0-9, lower case) that stand whole
in every URL it fits. Of these, the one that fewest URLs hold keys the rule; a
rule without literals is tried on every URL. The URL's own tokens fetch its
candidate rules, and only those run their regular expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's rules (verdict, host, path).
HOST_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: The method's own rules (name, literals, regular expression over host + path, lower case); they block where no host rule decides.
PATTERN_RULES = [
    ("spam-host", ["spam"], r"^(?:[^/]*[.-])?spam(?:[.-][^/]*)?(?:/|$)"),
    ("pills-host", ["pills"], r"^(?:[^/]*[.-])?pills(?:[.-][^/]*)?(?:/|$)"),
    ("casino-host", ["casino"], r"^(?:[^/]*[.-])?casino(?:[.-][^/]*)?(?:/|$)"),
    ("adult-host", ["xxx"], r"^(?:[^/]*[.-])?xxx(?:[.-][^/]*)?(?:/|$)"),
    ("login-path", ["login"], r"^[^/]*/(?:.*/)?login(?:[./]|$)"),
    ("click-bait", ["click", "here"], r"^[^/]*/.*click-here"),
]

RULE_SCHEMA = "rule string, verdict string, literals array<string>, regex string, size int, own boolean"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", text.lower()) if t]


def host_rule(verdict: str, host: str, path: str) -> tuple:
    """A rule for a host, its subdomains, and paths that start with path.

    The last token of a path that does not end in a delimiter may go on in the URL and is no literal.
    """
    literals = tokens(host) + (tokens(path) if re.search(r"[^A-Za-z0-9]$", path) else tokens(path)[:-1])
    return (f"{host}{path}", verdict, sorted(set(literals)), rf"^(?:[^/]*\.)?\Q{host}{path}\E", len(host + path), False)


def default_rules(spark: SparkSession) -> DataFrame:
    rows = [host_rule(*r) for r in HOST_RULES] + [(n, "block", l, x, 0, True) for n, l, x in PATTERN_RULES]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """(url, host, path, rule, own_rule, verdict) for each distinct non-null URL of pages.

    Equal URLs are judged once. Of the fitting host rules the longest wins (of equal ones, the smaller name);
    where none fits, a fitting pattern rule decides, else default. An empty table gives an empty one.
    The rules meet the tokens in an ordinary equi-join, which Spark broadcasts only below its size threshold.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(url_col).alias("url")).where("url is not null").distinct().select("url", host.alias("host"), path.alias("path"))
    target = F.concat("host", "path")
    held = F.array_append(F.array_distinct(F.split(lower_ascii(target), "[^a-z0-9]+")), F.lit("*"))
    held = urls.select("url", target.alias("target"), F.explode(held).alias("token")).where("token <> ''")

    # how many URLs hold each literal; those that none holds count 0 and are the rarest
    literals = rules.select("rule", F.explode("literals").alias("token"))
    counts = held.join(literals.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("n"))
    key = (
        literals.join(counts, "token", "left")
        .groupBy("rule")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("k"))
        .select("rule", F.col("k.token").alias("token"))
    )
    index = rules.join(key, "rule", "left").withColumn("token", F.coalesce("token", F.lit("*")))

    fits = F.when(F.col("own"), F.expr("regexp(lower(target), regex)")).otherwise(F.expr("regexp(target, regex)"))
    best = (
        held.join(index, "token")
        .where(fits)
        .groupBy("url")
        .agg(
            F.max_by(F.struct("rule", "verdict"), F.when(~F.col("own"), F.struct("size", "verdict", "rule"))).alias("host_rule"),
            F.max_by(F.struct("rule", "verdict"), F.when(F.col("own"), F.struct("size", "verdict", "rule"))).alias("own"),
        )
    )
    return urls.join(best, "url", "left").select(
        "url", "host", "path", F.col("host_rule.rule").alias("rule"), F.col("own.rule").alias("own_rule"),
        F.coalesce("host_rule.verdict", "own.verdict", F.lit(default)).alias("verdict"),
    )


def filter_urls(pages: DataFrame, rules: DataFrame | None = None, url_col: str = "url", keep: str = "allow") -> DataFrame:
    """The rows of pages whose URL's verdict is keep, unchanged; a null URL is judged like one that no rule fits."""
    judged = judge_urls(pages, rules if rules is not None else default_rules(pages.sparkSession), url_col)
    bad = judged.where(F.col("verdict") != keep).select(F.col("url").alias("_judged_url"))
    return pages.join(bad, pages[url_col] == bad["_judged_url"], "left_anti")


def op7(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row per row of pages; repeated rows stay. A null or strange URL has empty host and path and the default verdict."""
    judged = judge_urls(pages, default_rules(spark))
    rows = pages.select("page_id", "url")
    return rows.join(judged, "url", "left").select(
        "page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule",
        F.coalesce("verdict", F.lit("allow")).alias("verdict"), "own_rule",
    )


def _own_sql() -> str:
    return " ".join(f"WHEN regexp_matches(lower(host || path), '{x}') THEN '{n}'" for n, _, x in sorted(PATTERN_RULES, reverse=True))


ORACLE = f"""
WITH r(rule, verdict, rhost, rpath) AS (VALUES {", ".join(f"('{h}{p}', '{v}', '{h}', '{p}')" for v, h, p in HOST_RULES)}),
u AS (SELECT row_number() OVER () AS i, page_id,
  coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
h AS (SELECT i, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT i, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict FROM h JOIN r
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY i),
o AS (SELECT *, CASE {_own_sql()} END AS own_rule FROM h)
SELECT page_id, host, path, b.rule, coalesce(b.verdict, CASE WHEN own_rule IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, own_rule
FROM o LEFT JOIN b USING (i)
"""
