"""The engine's logical tables as projections of the star-schema tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The time that decay is computed for.
AS_OF = "2024-02-15 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed messages: id, person, speaker, content, source, ts, salience, metadata."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.expr("concat('u', user_id)").alias("person"),
        F.expr("case when event_id % 2 = 0 then concat('u', user_id) else 'self' end").alias("speaker"),
        F.expr("concat(event_type, ' worth ', cast(cast(value as int) as string))").alias("content"), F.col("event_type").alias("source"), "ts",
        F.least(F.lit(1.0), F.col("value") / 100).alias("salience"), F.col("props").alias("metadata"),
    )


MESSAGES = """messages AS (SELECT event_id AS id, concat('u', user_id) AS person, CASE WHEN event_id % 2 = 0 THEN concat('u', user_id) ELSE 'self' END AS speaker,
  concat(event_type, ' worth ', trunc(value)::INT) AS content, event_type AS source, ts, least(1.0, value / 100) AS salience, props AS metadata FROM events)"""


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text messages of conversations: person, ord, speaker, content."""
    return table(spark, sf_dir, "conversations").select(
        F.expr("concat('c', conv_id)").alias("person"), F.col("turn").alias("ord"), F.expr("case when role = 'assistant' then 'self' else role end").alias("speaker"), F.col("text").alias("content")
    )


TALK = "talk AS (SELECT concat('c', conv_id) AS person, turn AS ord, CASE WHEN role = 'assistant' THEN 'self' ELSE role END AS speaker, text AS content FROM conversations)"

KINDS = ["episode", "summary", "thread", "factual", "realization"]


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, content, kind, tags, salience, tokens, access_count, last_accessed, created, metadata from documents."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 5 + 1).cast("int"))
    day = F.lit("2024-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), kind.alias("kind"), F.array("lang", "source").alias("tags"),
        (F.col("doc_id") * 37 % 100 / 100).alias("salience"), F.expr("greatest(1L, length(text) div 4)").alias("tokens"), (F.col("doc_id") % 7).alias("access_count"),
        (day + F.expr("make_dt_interval(0, doc_id % 1000)")).alias("last_accessed"), (day + F.expr("make_dt_interval(0, doc_id % 700)")).alias("created"),
        F.expr("case when doc_id % 3 = 0 then concat('{\"consolidated_into\": ', doc_id div 3, '}') end").alias("metadata"),
    )


TRACES = """traces AS (SELECT doc_id AS id, text AS content, (['episode', 'summary', 'thread', 'factual', 'realization'])[doc_id % 5 + 1] AS kind, [lang, source] AS tags,
  doc_id * 37 % 100 / 100 AS salience, greatest(1, length(text) // 4)::BIGINT AS tokens, doc_id % 7 AS access_count,
  TIMESTAMP '2024-01-01' + to_hours((doc_id % 1000)::INT) AS last_accessed, TIMESTAMP '2024-01-01' + to_hours((doc_id % 700)::INT) AS created,
  CASE WHEN doc_id % 3 = 0 THEN concat('{"consolidated_into": ', doc_id // 3, '}') END AS metadata FROM documents)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal readings of a person in order: id, person, ts and four facets."""
    part = lambda k, m: (F.col("event_id") * k % m / m)
    facets = {"alignment": part(31, 97), "embodiment": part(17, 89), "clarity": part(13, 83), "vitality": part(7, 79)}
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr("concat('u', user_id)").alias("person"), "ts", *[v.alias(k) for k, v in facets.items()])


SIGNALS = """signals AS (SELECT event_id AS id, concat('u', user_id) AS person, ts, event_id * 31 % 97 / 97 AS alignment, event_id * 17 % 89 / 89 AS embodiment,
  event_id * 13 % 83 / 83 AS clarity, event_id * 7 % 79 / 79 AS vitality FROM events)"""

TIERS = ["core", "inner_circle", "friend", "acquaintance", "stranger"]


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person, tier_name, source from customer."""
    tier = F.element_at(F.array(*map(F.lit, [*TIERS, "Inner Circle", "someone"])), (F.col("c_custkey") % 7 + 1).cast("int"))
    source = F.expr("case c_mktsegment when 'HOUSEHOLD' then 'direct' when 'MACHINERY' then 'CLI' when 'FURNITURE' then 'opencode' when 'BUILDING' then 'discord' else 'api' end")
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("person"), tier.alias("tier_name"), source.alias("source"))


PEOPLE = """people AS (SELECT c_name AS person, (['core', 'inner_circle', 'friend', 'acquaintance', 'stranger', 'Inner Circle', 'someone'])[c_custkey % 7 + 1] AS tier_name,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'direct' WHEN 'MACHINERY' THEN 'CLI' WHEN 'FURNITURE' THEN 'opencode' WHEN 'BUILDING' THEN 'discord' ELSE 'api' END AS source FROM customer)"""
