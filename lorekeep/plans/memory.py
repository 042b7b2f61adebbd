"""Queries on recall, time, salience and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import recall, rollup, salience, temporal
from lorekeep.sources import adapters as ad
from lorekeep.sources.adapters import MESSAGES, SIGNALS, TALK, TRACES

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


R6 = lambda c: F.round(c, 6)
AS_OF = ad.AS_OF
DECAYED = f"""decayed AS (SELECT *, exp(-(ln(2.0) / 168 * 1.0) * h * r) * salience AS nd FROM (SELECT *, epoch_us(TIMESTAMP '{AS_OF}') / 3.6e9 - epoch_us(last_accessed) / 3.6e9 AS h,
  1.0 / (1 + access_count * 0.1) * CASE WHEN kind IN ('summary', 'thread', 'arc') THEN 0.2 ELSE 1.0 END AS r FROM traces))"""
DECAYED_VALUE = "CASE WHEN h <= 0 OR abs(salience - nd) <= 1e-6 THEN salience ELSE nd END"


@query("recall_top_salience", f"""WITH {TRACES}, {DECAYED}, v AS (SELECT id, kind, tags[1] AS tag, round({DECAYED_VALUE}, 6) AS decayed FROM decayed),
q AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY decayed DESC, id) AS pos FROM v) SELECT tag, pos::INT AS pos, id, kind, decayed FROM q WHERE pos <= 10""")
def recall_top_salience(s, d):
    from pyspark.sql import Window

    rows = salience.decay(ad.traces(s, d), AS_OF).select("id", "kind", F.get("tags", F.lit(0)).alias("tag"), R6("decayed").alias("decayed"))
    pos = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("decayed"), "id"))
    return rows.withColumn("pos", pos).where("pos <= 10").select("tag", "pos", "id", "kind", "decayed")


@query("messages_filtered", f"WITH {MESSAGES} SELECT id, person, source, ts, round(salience, 6) AS salience FROM messages WHERE salience >= 0.2 AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, id DESC LIMIT 50")
def messages_filtered(s, d):
    since, until = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-03", "2024-01-20"))
    return recall.get_messages(ad.messages(s, d), since=since, until=until, min_salience=0.2).select("id", "person", "source", "ts", R6("salience").alias("salience"))


@query("recent_per_person_k", f"""WITH {MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY ts DESC, id DESC) AS k FROM messages)
SELECT person, id, ts, row_number() OVER (PARTITION BY person ORDER BY ts, id)::INT AS pos FROM r WHERE k <= 20""")
def recent_per_person_k(s, d):
    return recall.recent_per_person(ad.messages(s, d), 20).select("person", "id", "ts", "pos")


@query("traces_by_tag", f"WITH {TRACES}, t AS (SELECT * FROM traces WHERE salience >= 0.3 ORDER BY salience DESC, id LIMIT 200) SELECT id, kind, round(salience, 6) AS salience FROM t WHERE list_contains(tags, 'fr') OR list_contains(tags, 'src3')")
def traces_by_tag(s, d):
    return recall.get_traces(ad.traces(s, d), tags=["FR", "src3"], min_salience=0.3, limit=200).select("id", "kind", R6("salience").alias("salience"))


@query("salient_for_tag", f"WITH {TRACES}, t AS (SELECT * FROM traces ORDER BY salience DESC, id LIMIT 90) SELECT id, round(salience, 6) AS salience FROM t WHERE list_contains(tags, 'de') ORDER BY salience DESC, id LIMIT 30")
def salient_for_tag(s, d):
    return recall.get_by_salience(ad.traces(s, d), "DE", 30).select("id", R6("salience").alias("salience"))


@query("traces_by_kind", f"WITH {TRACES} SELECT id, round(salience, 6) AS salience, tokens FROM traces WHERE kind = 'summary' AND salience >= 0.5 ORDER BY salience DESC, id LIMIT 40")
def traces_by_kind(s, d):
    return recall.get_traces(ad.traces(s, d), kind="summary", min_salience=0.5, limit=40).select("id", R6("salience").alias("salience"), "tokens")


@query("messages_in_range", f"WITH {MESSAGES} SELECT id, person, ts FROM messages WHERE person = 'u7' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' ORDER BY ts, id LIMIT 100")
def messages_in_range(s, d):
    since, until = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05", "2024-01-25"))
    return recall.in_range(ad.messages(s, d), since, until, person="u7").select("id", "person", "ts")


@query("traces_in_range", f"WITH {TRACES} SELECT id, created, round(salience, 6) AS salience FROM traces WHERE created BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-12' ORDER BY salience DESC, id LIMIT 50")
def traces_in_range(s, d):
    since, until = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-02", "2024-01-12"))
    return recall.traces_in_range(ad.traces(s, d), since, until).select("id", "created", R6("salience").alias("salience"))


@query("metadata_key_filter", f"WITH {TRACES} SELECT id, json_extract_string(metadata, '$.consolidated_into')::BIGINT AS parent FROM traces WHERE json_extract_string(metadata, '$.consolidated_into') IS NOT NULL")
def metadata_key_filter(s, d):
    rows = recall.with_metadata(ad.traces(s, d), "consolidated_into")
    return rows.select("id", F.get_json_object("metadata", "$.consolidated_into").cast("long").alias("parent"))


@query("unarchived_messages", f"WITH {MESSAGES} SELECT person, count(*) AS n FROM messages WHERE coalesce(json_extract_string(metadata, '$.archived')::INT, 0) = 0 GROUP BY person")
def unarchived_messages(s, d):
    return recall.unarchived(ad.messages(s, d)).groupBy("person").agg(F.count("*").alias("n"))


@query("unconsolidated_episodes", f"WITH {TRACES} SELECT id, kind, created FROM traces WHERE kind IN ('episode', 'summary') AND metadata IS NULL ORDER BY created, id LIMIT 200")
def unconsolidated_episodes(s, d):
    return recall.unconsolidated(ad.traces(s, d), ["episode", "summary"], 200).select("id", "kind", "created")


@query("distinct_people", f"WITH {MESSAGES} SELECT DISTINCT person FROM messages WHERE person IS NOT NULL")
def distinct_people(s, d):
    return ad.messages(s, d).where("person is not null").select("person").distinct()


@query("events_by_type_counts", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def events_by_type_counts(s, d):
    return ad.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,2)")), 2).cast("double").alias("total"))


@query("memory_stats", f"""WITH {MESSAGES}, {TRACES}, t AS (SELECT count(*) AS traces, coalesce(round(avg(salience), 4), 0.0) AS avg_salience FROM traces),
p AS (SELECT *, (SELECT count(*) FROM messages) AS messages, (SELECT count(*) FROM events) AS events, round(least(1.0, traces / 50000), 6) AS pressure FROM t)
SELECT messages, traces, avg_salience, events, pressure, CASE WHEN pressure > 0.9 THEN 'critical' WHEN pressure > 0.7 THEN 'warning' ELSE 'ok' END AS status FROM p""")
def memory_stats(s, d):
    return salience.memory_stats(ad.messages(s, d), ad.traces(s, d), ad.table(s, d, "events"))


@query("pressure_state", f"""WITH {TRACES}, c AS (SELECT tags[2] AS tag, count(*) AS n FROM traces GROUP BY ALL)
SELECT tag, n, CASE WHEN n / 60 >= 0.8 THEN 'critical' WHEN n / 60 >= 0.6 THEN 'elevated' ELSE 'normal' END AS level FROM c""")
def pressure_state(s, d):
    rows = ad.traces(s, d).groupBy(F.get("tags", F.lit(1)).alias("tag")).agg(F.count("*").alias("n"))
    return rows.withColumn("level", salience.pressure_level(F.col("n"), F.lit(60)))


@query("decay_pass", f"WITH {TRACES}, {DECAYED} SELECT id, round({DECAYED_VALUE}, 6) AS decayed FROM decayed")
def decay_pass(s, d):
    return salience.decay(ad.traces(s, d), AS_OF).select("id", R6("decayed").alias("decayed"))


@query("decay_twice", f"WITH {TRACES}, {DECAYED}, o AS (SELECT *, {DECAYED_VALUE} AS v1 FROM decayed) SELECT id, round(CASE WHEN h <= 0 OR abs(v1 - v1 * exp(-(ln(2.0) / 168) * h * r)) <= 1e-6 THEN v1 ELSE v1 * exp(-(ln(2.0) / 168) * h * r) END, 6) AS decayed FROM o")
def decay_twice(s, d):
    return salience.decay(ad.traces(s, d), AS_OF, passes=2).select("id", R6("decayed").alias("decayed"))


@query("decay_then_prune", f"WITH {TRACES}, {DECAYED}, v AS (SELECT id, kind, round({DECAYED_VALUE}, 6) AS decayed FROM decayed) SELECT id, kind, decayed FROM v WHERE decayed >= 0.05 OR kind IN ('summary', 'thread', 'arc')")
def decay_then_prune(s, d):
    rows = salience.decay(ad.traces(s, d), AS_OF).select("id", "kind", R6("decayed").alias("decayed"))
    return salience.prune(rows, "decayed", 0.05)


SESSIONS = f"""{MESSAGES}, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 7200000000 THEN 1 ELSE 0 END AS n FROM messages WINDOW w AS (PARTITION BY person ORDER BY ts, id)),
k AS (SELECT *, sum(n) OVER (PARTITION BY person ORDER BY ts, id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g),
sessions AS (SELECT person, session, min(ts) AS started, max(ts) AS ended, count(*) AS message_count FROM k GROUP BY person, session)"""


@query("sessions_by_gap", f"WITH {SESSIONS} SELECT * FROM sessions")
def sessions_by_gap(s, d):
    return temporal.sessions(ad.messages(s, d))


@query("session_stats", f"WITH {SESSIONS} SELECT person, count(*) AS n_sessions, max(message_count) AS longest, max(epoch_us(ended) - epoch_us(started)) AS longest_us FROM sessions GROUP BY person")
def session_stats(s, d):
    size = temporal.micros("ended") - temporal.micros("started")
    return temporal.sessions(ad.messages(s, d)).groupBy("person").agg(F.count("*").alias("n_sessions"), F.max("message_count").alias("longest"), F.max(size).alias("longest_us"))


@query("sessions_overlapping_range", f"WITH {SESSIONS} SELECT person, started, ended FROM sessions WHERE started <= TIMESTAMP '2024-01-10 12:00:00' AND ended >= TIMESTAMP '2024-01-10' ORDER BY started DESC, person LIMIT 20")
def sessions_overlapping_range(s, d):
    since, until = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-10 00:00:00", "2024-01-10 12:00:00"))
    return recall.sessions_in_range(temporal.sessions(ad.messages(s, d)), since, until).select("person", "started", "ended")


WINDOWS = "w AS (SELECT event_id AS wid, ts AS since, ts + INTERVAL 3 HOUR AS until FROM events WHERE event_type = 'signup')"


@query("session_window_join", f"WITH {SESSIONS}, {WINDOWS} SELECT wid, count(*) AS n FROM sessions JOIN w ON started <= until AND ended >= since GROUP BY wid")
def session_window_join(s, d):
    w = ad.table(s, d, "events").where("event_type = 'signup'").selectExpr("event_id as wid", "ts as since", "ts + interval 3 hours as until")
    return recall.overlap_counts(temporal.sessions(ad.messages(s, d)), w).select("wid", "n")


SEGMENTS = """g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > {us} THEN 1 ELSE 0 END AS nw FROM {src} WINDOW w AS (PARTITION BY person ORDER BY ts, id)),
k AS (SELECT *, sum(nw) OVER (PARTITION BY person ORDER BY ts, id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g),
seg AS (SELECT *, ((row_number() OVER (PARTITION BY person, session ORDER BY ts, id) - 1) // {size})::BIGINT AS part FROM k)"""


@query("compaction_segments", f"WITH {MESSAGES}, {SEGMENTS.format(us=86400000000, src='messages', size=5)} SELECT person, session, part, count(*) AS n, min(id) AS first_id FROM seg GROUP BY ALL")
def compaction_segments(s, d):
    return temporal.segments(ad.messages(s, d), 5, 24.0).groupBy("person", "session", "part").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("compaction_summaries", f"""WITH {MESSAGES}, c AS (SELECT *, count(*) OVER (PARTITION BY person) AS n, row_number() OVER (PARTITION BY person ORDER BY ts DESC, id DESC) AS b FROM messages),
o AS (SELECT * EXCLUDE (n, b) FROM c WHERE n >= 40 AND b > 20), {SEGMENTS.format(us=86400000000, src='o', size=30)},
r AS (SELECT *, row_number() OVER (PARTITION BY person, session, part ORDER BY salience DESC, ts, id) AS k2 FROM seg)
SELECT person, session, part, string_agg('[' || speaker || ']: ' || substr(content, 1, 300), chr(10) ORDER BY ts, id) FILTER (WHERE k2 <= 5) AS summary, count(*) AS n_messages, min(ts) AS since, max(ts) AS until FROM r GROUP BY person, session, part""")
def compaction_summaries(s, d):
    return rollup.compact(ad.messages(s, d), hours=24.0)


THREADS = f"""{TRACES}, e AS (SELECT *, coalesce(list_filter(tags, lambda t: lower(t) NOT IN ('consolidation', 'compaction', 'test'))[1], '_unknown') AS person FROM traces WHERE kind IN ('episode', 'summary') AND metadata IS NULL),
g AS (SELECT *, CASE WHEN epoch_us(created) - lag(epoch_us(created)) OVER w > 25200000000 THEN 1 ELSE 0 END AS nw FROM e WINDOW w AS (PARTITION BY person ORDER BY created, id)),
k AS (SELECT *, sum(nw) OVER (PARTITION BY person ORDER BY created, id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY person, cluster ORDER BY salience DESC, created, id) AS k2 FROM k),
threads AS (SELECT person, cluster, count(*) AS n, string_agg('- ' || substr(content, 1, 250), chr(10) ORDER BY created, id) FILTER (WHERE k2 <= 5) AS content, min(created) AS since, max(created) AS until,
  string_agg(id, ',' ORDER BY id) AS children, 0.75::DOUBLE AS salience FROM r GROUP BY person, cluster HAVING count(*) >= 5)"""


def _threads(s, d):
    free = recall.unconsolidated(ad.traces(s, d), ["episode", "summary"])
    return rollup.consolidate_threads(free.withColumn("salience", F.col("salience").cast("double")), hours=7.0)


@query("thread_clusters", f"WITH {THREADS} SELECT * FROM threads")
def thread_clusters(s, d):
    return _threads(s, d).withColumn("children", F.array_join(F.transform("child_ids", lambda x: x.cast("string")), ",")).drop("child_ids")


@query("arc_rollup", f"""WITH {THREADS} SELECT person, count(*) AS n, string_agg(substr(content, 1, 300), chr(10) || chr(10) ORDER BY since, cluster) AS content, min(since) AS since, max(until) AS until, 0.85::DOUBLE AS salience
FROM threads GROUP BY person HAVING count(*) >= 3""")
def arc_rollup(s, d):
    return rollup.consolidate_arcs(_threads(s, d))


LINKS = "l AS (SELECT id, json_extract_string(metadata, '$.consolidated_into')::BIGINT AS parent FROM traces)"


@query("lineage_ancestors", f"""WITH RECURSIVE {TRACES}, {LINKS}, a(id, ancestor, depth) AS (SELECT id, parent, 1 FROM l WHERE parent IS NOT NULL AND parent <> id UNION ALL SELECT a.id, l.parent, depth + 1 FROM a JOIN l ON l.id = a.ancestor WHERE l.parent IS NOT NULL AND l.parent <> l.id)
SELECT id, ancestor, depth::INT AS depth FROM a""")
def lineage_ancestors(s, d):
    links = ad.traces(s, d).select("id", F.get_json_object("metadata", "$.consolidated_into").cast("long").alias("parent"))
    return rollup.lineage(links)


HEALTH = f"{SIGNALS}, h AS (SELECT *, .35 * alignment + .25 * embodiment + .20 * clarity + .20 * vitality AS health FROM signals)"


def _health(s, d):
    from lorekeep.functions.signal import health

    return ad.signals(s, d).withColumn("health", health())


@query("signal_health_state", f"""WITH {HEALTH} SELECT id, round(health, 6) AS health, CASE WHEN round(health, 9) >= .75 THEN 'coherent' WHEN round(health, 9) >= .5 THEN 'developing' WHEN round(health, 9) >= .35 THEN 'drifting' ELSE 'dissociated' END AS state,
  CASE least(alignment, embodiment, clarity, vitality) WHEN alignment THEN 'alignment' WHEN embodiment THEN 'embodiment' WHEN clarity THEN 'clarity' ELSE 'vitality' END AS weakest,
  round(greatest(alignment, embodiment, clarity, vitality) - least(alignment, embodiment, clarity, vitality), 6) AS gap FROM h""")
def signal_health_state(s, d):
    from lorekeep.functions import signal

    return _health(s, d).select("id", R6("health").alias("health"), signal.health_state(F.round("health", 9)).alias("state"), signal.weakest_facet().alias("weakest"), R6(signal.polarity_gap()).alias("gap"))


ROLLING = f"""{HEALTH}, r AS (SELECT *, row_number() OVER w AS nth, avg(health) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent, avg(health) OVER (w ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) AS before,
  lag(health) OVER w AS last FROM h WINDOW w AS (PARTITION BY person ORDER BY ts, id)),
rr AS (SELECT *, CASE WHEN last < .5 AND health > last THEN health - last END AS rise FROM r)"""


@query("rolling_health", f"WITH {ROLLING} SELECT id, person, nth::INT AS nth, round(recent, 6) AS recent_health FROM r")
def rolling_health(s, d):
    return temporal.rolling_health(_health(s, d)).select("id", "person", F.col("nth").cast("int").alias("nth"), R6("recent_health").alias("recent_health"))


@query("health_trend", f"WITH {ROLLING} SELECT id, CASE WHEN recent - before > 0.05 THEN 'improving' WHEN recent - before < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM r")
def health_trend(s, d):
    return temporal.rolling_health(_health(s, d)).select("id", "trend")


@query("recovery_rate", f"WITH {ROLLING} SELECT id, CASE WHEN nth < 3 THEN 0.0 ELSE round(coalesce(avg(rise) OVER (PARTITION BY person ORDER BY ts, id ROWS BETWEEN 48 PRECEDING AND CURRENT ROW), 0.0), 6) END AS recovery_rate FROM rr")
def recovery_rate(s, d):
    return temporal.rolling_health(_health(s, d)).select("id", R6("recovery_rate").alias("recovery_rate"))


LAST10 = "b AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY ts DESC, id DESC) AS back, count(*) OVER (PARTITION BY person) AS total FROM signals)"


@query("confidence_report", f"""WITH {SIGNALS}, {LAST10}, l AS (SELECT *, least(total, 10) AS kept FROM b WHERE back <= 10),
a AS (SELECT person, avg(clarity) AS a, avg(clarity) FILTER (WHERE back > kept - kept // 2) AS f, avg(clarity) FILTER (WHERE back <= kept - kept // 2) AS sc, count(*) AS n, count(*) FILTER (WHERE clarity > .7) AS high, count(*) FILTER (WHERE clarity < .4) AS low FROM l GROUP BY person)
SELECT person, round(a, 4) AS average, CASE WHEN n >= 4 AND sc > f + 0.1 THEN 'increasing' WHEN n >= 4 AND sc < f - 0.1 THEN 'decreasing' ELSE 'stable' END AS trend, high, low FROM a""")
def confidence_report(s, d):
    return temporal.confidence_report(ad.signals(s, d).withColumn("confidence", F.col("clarity")))


@query("belief_solidification", f"""WITH {SIGNALS}, {LAST10}, a AS (SELECT person, count(*) AS total, avg(vitality) AS a, avg(vitality) FILTER (WHERE back <= 10) AS r, count(*) FILTER (WHERE 1 - vitality >= .5) AS reinforcements_needed FROM b GROUP BY person)
SELECT person, total, reinforcements_needed, round(a, 4) AS average_belief, round(r, 4) AS recent_average, CASE WHEN r > a + 1e-12 THEN 'improving' ELSE 'stable' END AS trend, CASE WHEN r > 0.8 THEN 'solid' ELSE 'developing' END AS status FROM a""")
def belief_solidification(s, d):
    return temporal.solidification(ad.signals(s, d).withColumn("belief", F.col("vitality")))


@query("stability", f"""WITH {SIGNALS}, {LAST10}, a AS (SELECT person, avg(abs(alignment - .5) + abs(vitality - .5)) AS m, count(*) AS n FROM b WHERE back <= 10 GROUP BY person)
SELECT person, round(m, 6) AS mean_change, CASE WHEN n < 5 THEN 'insufficient_data' WHEN m < .1 THEN 'very_stable' WHEN m < .2 THEN 'stable' WHEN m < .4 THEN 'moderate' ELSE 'volatile' END AS stability FROM a""")
def stability(s, d):
    rows = ad.signals(s, d).withColumns({"valence_delta": F.col("alignment") - 0.5, "arousal_delta": F.col("vitality") - 0.5})
    return temporal.stability(rows)


@query("valence_trend", f"""WITH {SIGNALS}, {LAST10}, a AS (SELECT person, max_by(alignment, back) AS f, min_by(alignment, back) AS l, count(*) AS n FROM b WHERE back <= 5 GROUP BY person)
SELECT person, CASE WHEN n < 2 THEN 'insufficient_data' WHEN l - f > .1 THEN 'improving' WHEN l - f < -.1 THEN 'declining' ELSE 'stable' END AS trend FROM a""")
def valence_trend(s, d):
    return temporal.value_trend(ad.signals(s, d), "alignment")


@query("mode_history", """WITH t AS (SELECT concat('u', user_id) AS person, event_id AS id, ts, (['quiet_presence', 'active', 'deep_work', 'sleep'])[event_id // 3 % 4 + 1] AS mode FROM events),
c AS (SELECT *, lag(mode) OVER (PARTITION BY person ORDER BY ts, id) AS was FROM t), k AS (SELECT * FROM c WHERE was IS NULL OR was <> mode),
e AS (SELECT *, lead(ts) OVER (PARTITION BY person ORDER BY ts, id) AS ended FROM k)
SELECT person, mode, ts AS started, ended, round((epoch_us(ended) - epoch_us(ts)) / 1e6, 1) AS seconds FROM e""")
def mode_history(s, d):
    mode = F.expr("element_at(array('quiet_presence', 'active', 'deep_work', 'sleep'), cast(event_id div 3 % 4 + 1 as int))")
    return temporal.mode_durations(ad.table(s, d, "events").select(F.expr("concat('u', user_id)").alias("person"), F.col("event_id").alias("id"), "ts", mode.alias("mode")))


EXCHANGES = f"{HEALTH}, x AS (SELECT id AS exchange_id, health, [id % 997, (id * 7 + 1) % 997] AS trace_ids, CASE WHEN id % 4 = 0 THEN [id % 997] ELSE [] END AS cited_ids FROM h)"
LOG = """log AS (SELECT unnest(cited_ids) AS trace_id, exchange_id, 0 AS step, 0.025 AS delta FROM x
UNION ALL SELECT unnest(trace_ids), exchange_id, 1, CASE WHEN round(health, 9) > .7 THEN .05 ELSE -.03 END FROM x WHERE round(health, 9) > .7 OR round(health, 9) < .4)"""


def _exchanges(s, d):
    i = F.col("id")
    cited = F.when(i % 4 == 0, F.array(i % 997)).otherwise(F.array().cast("array<bigint>"))
    return _health(s, d).select(i.alias("exchange_id"), F.round("health", 9).alias("health"), F.array(i % 997, (i * 7 + 1) % 997).alias("trace_ids"), cited.alias("cited_ids"))


@query("hebbian_adjust", f"WITH {EXCHANGES}, {LOG} SELECT trace_id, exchange_id, step::INT AS step, delta::DOUBLE AS delta FROM log")
def hebbian_adjust(s, d):
    return salience.hebbian(_exchanges(s, d))


@query("salience_fold", f"""WITH RECURSIVE {TRACES}, {EXCHANGES}, {LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY exchange_id, step) AS k FROM log),
f(id, k, v) AS (SELECT id, 0::BIGINT, salience::DOUBLE FROM traces UNION ALL SELECT f.id, o.k, greatest(0.0, least(1.0, f.v + o.delta::DOUBLE)) FROM f JOIN o ON o.trace_id = f.id AND o.k = f.k + 1),
m AS (SELECT id, max(k) AS k FROM f GROUP BY id)
SELECT f.id, round(f.v, 6) AS adjusted, f.k::INT AS n_adjustments FROM f JOIN m ON m.id = f.id AND m.k = f.k""")
def salience_fold(s, d):
    rows = salience.apply_adjustments(ad.traces(s, d).select("id", "salience"), salience.hebbian(_exchanges(s, d)))
    return rows.select("id", R6("adjusted").alias("adjusted"), "n_adjustments")


@query("access_log", "SELECT event_id % 997 AS trace_id, count(*) AS access_count, max(ts) AS last_accessed FROM events GROUP BY ALL")
def access_log(s, d):
    return salience.access_stats(ad.table(s, d, "events").select((F.col("event_id") % 997).alias("trace_id"), "ts"))


@query("archive_marks", f"""WITH {MESSAGES}, c AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY ts DESC, id DESC) AS b FROM messages)
SELECT id, CASE WHEN b > 20 THEN json_merge_patch(metadata, '{{"archived":1}}')::VARCHAR ELSE metadata END AS metadata FROM c""")
def archive_marks(s, d):
    from pyspark.sql import Window

    rows = ad.messages(s, d)
    old = rows.withColumn("b", F.row_number().over(Window.partitionBy("person").orderBy(F.desc("ts"), F.desc("id")))).where("b > 20").select("id")
    out = rollup.mark(rows, old, "archived", F.lit(1))
    return out.select("id", "metadata")


@query("derived_salience", f"""WITH {TALK}, n AS (SELECT *, lead(content) OVER w AS reply, lead(speaker) OVER w AS who FROM talk WINDOW w AS (PARTITION BY person ORDER BY ord)),
x AS (SELECT person, ord, 0.6 AS h, length(content) + length(reply) AS size FROM n WHERE speaker = 'user' AND who = 'self')
SELECT person, ord, round(greatest(.05, least(1.0, CASE WHEN size < 50 THEN h * .7 WHEN size > 2000 THEN least(1.0, h * 1.15) ELSE h END)), 6)::DOUBLE AS salience FROM x""")
def derived_salience(s, d):
    from pyspark.sql import Window

    from lorekeep.functions.text import derive_salience

    w = Window.partitionBy("person").orderBy("ord")
    rows = ad.talk(s, d).withColumns({"reply": F.lead("content").over(w), "who": F.lead("speaker").over(w)}).where("speaker = 'user' and who = 'self'")
    return rows.select("person", "ord", R6(derive_salience(F.lit(0.6), F.col("content"), F.col("reply"))).alias("salience"))
