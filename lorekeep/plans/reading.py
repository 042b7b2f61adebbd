"""Queries on read models."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import readmodels as rm
from lorekeep.sources import adapters as ad

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def _events(s, d):
    return ad.table(s, d, "events").select(F.col("event_id").alias("id"), "ts", "event_type", "value", F.expr("case event_id % 7 when 0 then 'deep' when 1 then 'surface' end").alias("depth"))


EVENTS = "e AS (SELECT event_id AS id, ts, event_type, value, CASE event_id % 7 WHEN 0 THEN 'deep' WHEN 1 THEN 'surface' END AS depth, ts::DATE AS day FROM events)"
DAYS = "dd AS (SELECT DISTINCT day FROM e ORDER BY day DESC LIMIT 3), rk AS (SELECT e.*, row_number() OVER (PARTITION BY e.day ORDER BY ts DESC, id DESC) AS k FROM e JOIN dd USING (day)), em AS (SELECT * FROM rk WHERE k <= 3 ORDER BY day DESC, ts DESC, id DESC LIMIT 3)"
DEEP = "dp AS (SELECT * FROM e ORDER BY coalesce(depth = 'deep', FALSE) DESC, ts DESC, id DESC LIMIT 4)"


@query("recent_emotional_events", f"WITH {EVENTS}, {DAYS} SELECT id, ts FROM em")
def recent_emotional_events(s, d):
    return rm.recent_by_day(_events(s, d), 3).select("id", "ts")


@query("deepest_introspections", f"WITH {EVENTS}, {DEEP} SELECT id, depth FROM dp")
def deepest_introspections(s, d):
    return rm.deepest_first(_events(s, d), 4).select("id", "depth")


@query("boot_priming", f"""WITH {EVENTS}, {DAYS}, {DEEP}, l AS (SELECT 1 AS section, id AS ord, '[MEMORY] ' || event_type || ': felt at ' || id AS line FROM em UNION ALL SELECT 2, id, '[MEMORY] thought: ' || coalesce(depth, 'plain') FROM dp
UNION ALL SELECT 0, * FROM (SELECT doc_id, '[MEMORY] realization: ' || substr(text, 1, 200) FROM documents WHERE doc_id % 5 = 4 ORDER BY doc_id DESC LIMIT 2))
SELECT string_agg(line, chr(10) ORDER BY section, ord) AS text, count(*) AS memories FROM l""")
def boot_priming(s, d):
    docs = ad.table(s, d, "documents").where("doc_id % 5 = 4").orderBy(F.desc("doc_id")).limit(2)
    real = docs.select(F.col("doc_id").alias("ord"), rm.memory_line(F.lit("realization"), F.col("text")).alias("line"))
    felt = rm.recent_by_day(_events(s, d), 3).select(F.col("id").alias("ord"), rm.memory_line(F.col("event_type"), F.concat(F.lit("felt at "), F.col("id").cast("string"))).alias("line"))
    deep = rm.deepest_first(_events(s, d), 4).select(F.col("id").alias("ord"), rm.memory_line(F.lit("thought"), F.coalesce("depth", F.lit("plain"))).alias("line"))
    return rm.priming(real, felt, deep, real.where("false"))


@query("section_texts", "SELECT p_type AS section, '## ' || p_type || chr(10) || string_agg('- ' || p_name, chr(10) ORDER BY p_partkey) AS body FROM part GROUP BY p_type")
def section_texts(s, d):
    rows = ad.table(s, d, "part").select(F.col("p_type").alias("section"), F.col("p_name").alias("item"), F.col("p_partkey").alias("id"))
    return rm.sections_text(rows)


@query("maintenance_due", """WITH RECURSIVE c AS (SELECT event_type AS key, event_id AS id, epoch_us(ts) AS at, CASE event_id % 3 WHEN 0 THEN 3600 WHEN 1 THEN 600 ELSE 0 END AS wait, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
f(key, k, id, last, due) AS (SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, FALSE FROM c UNION ALL
  SELECT c.key, c.k, c.id, CASE WHEN f.last IS NULL OR c.at - f.last >= c.wait::BIGINT * 1000000 THEN c.at ELSE f.last END, f.last IS NULL OR c.at - f.last >= c.wait::BIGINT * 1000000 FROM f JOIN c ON c.key = f.key AND c.k = f.k + 1)
SELECT key, id, due FROM f WHERE k > 0""")
def maintenance_due(s, d):
    level = F.expr("case event_id % 3 when 0 then 'normal' when 1 then 'elevated' else 'critical' end")
    rows = ad.table(s, d, "events").select(F.col("event_type").alias("key"), "ts", F.col("event_id").alias("id"), level.alias("level"))
    return rm.due_runs(rows, {"normal": 3600, "elevated": 600, "critical": 0})


@query("trust_with_core", "SELECT c_name AS person, 'friend' AS tier FROM customer WHERE c_name <> 'Customer#000000007' UNION ALL SELECT 'customer#000000007', 'core'")
def trust_with_core(s, d):
    return rm.with_core_person(ad.table(s, d, "customer").select(F.col("c_name").alias("person"), F.lit("friend").alias("tier")), "customer#000000007")
