"""Queries on look-ups, writers' results, extraction, injuries, workspace and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.functions import signal, text
from lorekeep.operators import readmodels as rm
from lorekeep.operators import recall, rollup, salience, search, state, temporal, textindex
from lorekeep.plans.knowledge import BIG5, BIG5_SQL, MOODS, _feelings, _items, _traits, documents_index
from lorekeep.plans.memory import EXCHANGES, HEALTH, LOG, SESSIONS, THREADS, _exchanges, _health, _threads
from lorekeep.session import checkpointed, shared_folder
from lorekeep.sources import adapters as ad
from lorekeep.sources import snapshot
from lorekeep.sources.adapters import MESSAGES, SIGNALS, TALK, TRACES

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


R6 = lambda c: F.round(c, 6)
q = lambda s: "'" + s.replace("'", "''") + "'"
NTZ = lambda s: F.lit(s).cast("timestamp_ntz")


def _events(s, d):
    return ad.table(s, d, "events").select(F.col("event_id").alias("id"), F.expr("concat('u', user_id)").alias("person"), "event_type", "ts", "value")


@query("events_filtered", "SELECT event_id AS id, ts FROM events WHERE event_type = 'click' AND user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 50")
def events_filtered(s, d):
    return recall.get_events(_events(s, d), "click", "u7").select("id", "ts")


@query("trace_lookup", f"WITH {TRACES} SELECT id, kind, content FROM traces WHERE id IN (3, 42, 1000000007)")
def trace_lookup(s, d):
    return recall.by_id(ad.traces(s, d), [3, 42, 1000000007]).select("id", "kind", "content")


#: Sessions whose last message is as late as this are still open.
OPEN_FROM = "2024-01-28"
LIVE = f"{SESSIONS}, live AS (SELECT person, session, started, CASE WHEN ended < TIMESTAMP '{OPEN_FROM}' THEN ended END AS ended, message_count FROM sessions)"


def _live(s, d):
    return temporal.sessions(ad.messages(s, d)).withColumn("ended", F.when(F.col("ended") < NTZ(OPEN_FROM), F.col("ended")))


@query("active_sessions", f"WITH {LIVE} SELECT person, max(started) AS started FROM live WHERE ended IS NULL GROUP BY person")
def active_sessions(s, d):
    return recall.active_session(_live(s, d))


@query("recent_sessions", f"WITH {LIVE} SELECT person, started, ended FROM live ORDER BY started DESC, person LIMIT 10")
def recent_sessions(s, d):
    return recall.recent_sessions(_live(s, d)).select("person", "started", "ended")


@query("open_sessions_in_range", f"WITH {LIVE} SELECT person, started, ended FROM live WHERE started <= TIMESTAMP '2024-01-29 12:00:00' AND (ended >= TIMESTAMP '2024-01-29' OR ended IS NULL) ORDER BY started DESC, person LIMIT 20")
def open_sessions_in_range(s, d):
    return recall.sessions_in_range(_live(s, d), NTZ("2024-01-29 00:00:00"), NTZ("2024-01-29 12:00:00")).select("person", "started", "ended")


@query("open_session_windows", f"WITH {LIVE}, w AS (SELECT event_id AS wid, ts AS since, ts + to_hours((event_id % 400)::INT) AS until FROM events WHERE event_type = 'signup') SELECT wid, count(*) AS n, count(ended) AS n_ended FROM live JOIN w ON started <= until AND (ended >= since OR ended IS NULL) GROUP BY wid")
def open_session_windows(s, d):
    w = ad.table(s, d, "events").where("event_type = 'signup'").selectExpr("event_id as wid", "ts as since", "ts + make_dt_interval(0, event_id % 400) as until")
    return recall.overlap_counts(_live(s, d), w)


@query("unconsolidated_threads", f"WITH {TRACES} SELECT id, created FROM traces WHERE kind = 'thread' AND metadata IS NULL")
def unconsolidated_threads(s, d):
    return recall.unconsolidated(ad.traces(s, d), ["thread"]).select("id", "created")


@query("correction_links", f"""WITH {TRACES}, c AS (SELECT id, id // 11 AS original FROM traces WHERE id % 11 = 3)
SELECT c.id, original, round(t.salience, 6) AS was FROM c LEFT JOIN traces t ON t.id = original""")
def correction_links(s, d):
    marked = ad.traces(s, d).withColumn("metadata", F.when(F.col("id") % 11 == 3, F.concat(F.lit('{"corrects": '), F.expr("cast(id div 11 as string)"), F.lit("}"))))
    return recall.corrections(marked).select("id", "original", R6("was").alias("was"))


@query("consolidation_marks", f"""WITH {TRACES}, p AS (SELECT doc_id AS id, 1000000 + doc_id // 4 AS parent FROM documents WHERE doc_id % 9 < 5)
SELECT id, CASE WHEN parent IS NULL THEN metadata ELSE json_merge_patch(coalesce(metadata, '{{}}'), json_object('consolidated_into', parent))::VARCHAR END AS metadata FROM traces LEFT JOIN p USING (id)""")
def consolidation_marks(s, d):
    rows = ad.traces(s, d)
    parents = rows.where("id % 9 < 5").groupBy((F.lit(1000000) + F.expr("id div 4")).alias("id")).agg(F.collect_list("id").alias("child_ids"))
    return rollup.mark_consolidated(rows, parents).select("id", "metadata")


#: Metadata of every kind: a number, a boolean and an object, a list with a null, a text that is no JSON, one that is no object, and none.
MIXED = """CASE id % 6 WHEN 0 THEN concat('{"a": 1, "k": ', id, '}') WHEN 1 THEN concat('{"b": true, "k": "', id, '", "o": {"x": [1, 2.5]}}')
  WHEN 2 THEN concat('{"l": [null, ', id, '], "reviewed": 0}') WHEN 3 THEN concat('k: ', id) WHEN 4 THEN concat('[', id, ']') END"""


@query("metadata_writes", f"""WITH {MESSAGES}, m AS (SELECT id, salience, speaker, {MIXED} AS metadata FROM messages),
v AS (SELECT *, CASE WHEN json_valid(metadata) AND json_type(CASE WHEN json_valid(metadata) THEN metadata END) = 'OBJECT' THEN metadata ELSE '{{}}' END AS old FROM m)
SELECT id, CASE WHEN salience > .5 THEN json_merge_patch(json_merge_patch(old, '{{"reviewed":null}}'), json_object('reviewed', speaker))::VARCHAR ELSE metadata END AS metadata FROM v""")
def metadata_writes(s, d):
    rows = ad.messages(s, d).withColumn("metadata", F.expr(MIXED))
    return rollup.with_key(rows, "reviewed", F.when(F.col("salience") > 0.5, F.col("speaker"))).select("id", "metadata")


@query("belief_evolution", f"""WITH {SIGNALS}, b AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY ts DESC, id DESC) AS back FROM signals)
SELECT person, count(*) AS n, round(avg(vitality), 4) AS average, round(min(vitality), 4) AS least, round(max(vitality), 4) AS greatest, string_agg((round(vitality * 1000))::BIGINT, ' ' ORDER BY ts, id) FILTER (WHERE back <= 50) AS scores FROM b GROUP BY person""")
def belief_evolution(s, d):
    out = temporal.belief_evolution(ad.signals(s, d).withColumn("belief", F.col("vitality")))
    return out.withColumn("scores", F.array_join(F.transform("scores", lambda v: F.round(v * 1000).cast("long").cast("string")), " "))


@query("workspace_items", """WITH RECURSIVE e AS (SELECT concat('u', user_id) AS person, event_id, concat(event_type, event_id % 4) AS item, event_id * 37 % 100 / 100 AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f(person, k, slots) AS (SELECT DISTINCT person, 0::BIGINT, []::STRUCT(item VARCHAR, p DOUBLE, age INT)[] FROM e UNION ALL
  SELECT e.person, e.k, list_filter(list_transform(CASE WHEN list_contains(list_transform(slots, lambda z: z.item), e.item) THEN list_transform(slots, lambda z: CASE WHEN z.item = e.item THEN {'item': z.item, 'p': least(1.0, z.p + .15)::DOUBLE, 'age': 0} ELSE z END)
    WHEN len(slots) < 7 THEN list_append(slots, {'item': e.item, 'p': e.p::DOUBLE, 'age': 0})
    WHEN e.p > list_min(list_transform(slots, lambda z: z.p)) THEN list_transform(slots, lambda z, i: CASE WHEN i = list_position(list_transform(slots, lambda y: y.p), list_min(list_transform(slots, lambda y: y.p))) THEN {'item': e.item, 'p': e.p::DOUBLE, 'age': 0} ELSE z END)
    ELSE slots END, lambda z: {'item': z.item, 'p': (z.p * .95)::DOUBLE, 'age': z.age + 1}), lambda z: z.p >= .1) FROM f JOIN e ON e.person = f.person AND e.k = f.k + 1),
l AS (SELECT person, max_by(slots, k) AS slots FROM f GROUP BY person), u AS (SELECT person, unnest(slots) AS z, generate_subscripts(slots, 1) AS i FROM l)
SELECT person, (i - 1)::INT AS slot, z.item AS item, round(z.p, 6) AS priority, z.age AS age FROM u""")
def workspace_items(s, d):
    slots = state.workspace_fold(_items(s, d)).where("reason is null")
    return slots.select("person", F.col("nth").alias("slot"), "item", R6("priority").alias("priority"), "age")


@query("workspace_status", ORACLES["workspace_items"].rsplit("SELECT", 1)[0] + "SELECT person, count(*) AS n, 7 AS capacity, round(avg(z.p), 4) AS average_priority, min_by(z.item, (-z.p, i)) AS strongest FROM u GROUP BY person")
def workspace_status(s, d):
    return state.workspace_status(state.workspace_fold(_items(s, d)).where("reason is null"))


@query("list_counts", "SELECT (SELECT count(DISTINCT c_name) FROM customer) AS relationships, (SELECT count(DISTINCT p_name) FROM part) AS skills, (SELECT count(DISTINCT user_id) FROM events) AS people")
def list_counts(s, d):
    count = lambda df, c: df.agg(F.count_distinct(c).alias("n"))
    return rm.one_row(relationships=count(ad.table(s, d, "customer"), "c_name"), skills=count(ad.table(s, d, "part"), "p_name"), people=count(ad.table(s, d, "events"), "user_id"))


@query("influence_tail", "WITH t AS (SELECT event_id AS id, ts FROM events WHERE event_type = 'error' AND user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 20) SELECT * FROM t")
def influence_tail(s, d):
    return recall.tail(_events(s, d).where("event_type = 'error'"), "U7").select("id", "ts")


INJURIES = """log AS (SELECT concat('i', user_id, '-', event_id % 5) AS injury_id, concat('u', user_id) AS person, concat('Trouble ', event_id % 5, ' with ', event_type) AS title, (['fresh', 'processing', 'healing', 'healed', 'processing', 'healing', 'fresh'])[event_id % 7 + 1] AS status, ts, event_id AS id FROM events),
e AS (SELECT *, min(row(ts, id)) FILTER (WHERE status = 'healed') OVER (PARTITION BY injury_id) AS stop FROM log),
j AS (SELECT injury_id, min_by(person, (ts, id)) AS person, min_by(title, (ts, id)) AS title, max_by(status, (ts, id)) AS status, max(ts) AS since FROM e WHERE stop IS NULL OR row(ts, id) <= stop GROUP BY injury_id)"""


def _injuries(s, d):
    e = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ["fresh", "processing", "healing", "healed", "processing", "healing", "fresh"])), (e % 7 + 1).cast("int"))
    return state.injury_state(ad.table(s, d, "events").select(
        F.expr("concat('i', user_id, '-', event_id % 5)").alias("injury_id"), F.expr("concat('u', user_id)").alias("person"), F.expr("concat('Trouble ', event_id % 5, ' with ', event_type)").alias("title"),
        status.alias("status"), "ts", e.alias("id"),
    ))


@query("injury_lifecycle", f"WITH {INJURIES} SELECT * FROM j")
def injury_lifecycle(s, d):
    return _injuries(s, d)


@query("injuries_active", f"WITH {INJURIES} SELECT person, count(*) AS n FROM j WHERE status <> 'healed' GROUP BY person")
def injuries_active(s, d):
    return state.active_injuries(_injuries(s, d)).groupBy("person").agg(F.count("*").alias("n"))


@query("injury_found", f"WITH {INJURIES} SELECT person, min_by(injury_id, (since, injury_id)) AS injury_id FROM j WHERE status <> 'healed' AND contains(lower(title), 'with click') GROUP BY person")
def injury_found(s, d):
    return state.find_injury(_injuries(s, d), "With CLICK")


@query("emotion_nudges", f"""WITH {TALK} SELECT person, ord, round((ord % 10 / 10 - .5) * .3, 6)::DOUBLE AS dv, CASE WHEN len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) > 30 THEN .1 ELSE -.05 END::DOUBLE AS da FROM talk WHERE speaker = 'user'""")
def emotion_nudges(s, d):
    moves = state.nudge(F.col("ord") % 10 / 10, F.col("content"), F.lit(0.5))
    return ad.talk(s, d).where("speaker = 'user'").select("person", "ord", R6(moves["dv"]).alias("dv"), moves["da"].alias("da"))


@query("fact_lines", "SELECT o_custkey AS section, '## ' || o_custkey || chr(10) || string_agg('- ' || '- ' || o_orderpriority || ' (' || strftime(o_orderdate, '%Y-%m-%d') || ')', chr(10) ORDER BY o_orderkey) AS body FROM orders GROUP BY o_custkey")
def fact_lines(s, d):
    rows = ad.table(s, d, "orders").select(F.col("o_custkey").alias("section"), rm.fact_line(F.col("o_orderpriority"), F.col("o_orderdate")).alias("item"), F.col("o_orderkey").alias("id"))
    return rm.sections_text(rows.withColumn("section", F.col("section").cast("string"))).withColumn("section", F.col("section").cast("long"))


KINDS = ["like", "Dislikes", "uncertainty", "LIKES", "hate"]


@query("preference_writes", f"WITH p AS (SELECT event_id, ([{', '.join(map(q, KINDS))}])[event_id % 5 + 1] AS kind FROM events) SELECT kind, CASE lower(kind) WHEN 'like' THEN 'likes' WHEN 'likes' THEN 'likes' WHEN 'dislikes' THEN 'dislikes' WHEN 'uncertainty' THEN 'uncertainties' END AS section, count(*) AS n FROM p GROUP BY ALL")
def preference_writes(s, d):
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 5 + 1).cast("int"))
    return ad.table(s, d, "events").select(kind.alias("kind")).select("kind", rm.preference_section(F.col("kind")).alias("section")).groupBy("kind", "section").agg(F.count("*").alias("n"))


@query("trimmed_texts", "SELECT doc_id, CASE WHEN greatest(1, length(text) // 4) <= 30 THEN text ELSE substr(text, 1, 117) || '...' END AS short, strlen(text) <= 5000 AS within FROM documents")
def trimmed_texts(s, d):
    return ad.table(s, d, "documents").select("doc_id", text.trim_to_budget(F.col("text"), F.lit(30)).alias("short"), text.within_bytes(F.col("text"), 5000).alias("within"))


TIMES = ["2024-01-05", "2024-01-05T06:07:08Z", "", "soon", "2024-01-05T06:07:08+02:00"]


@query("parsed_times", f"""WITH t AS (SELECT event_id, ([{', '.join(map(q, TIMES))}])[event_id % 5 + 1] AS t FROM events)
SELECT event_id, CASE t WHEN '' THEN epoch_us(TIMESTAMP '2024-02-01') WHEN '2024-01-05' THEN epoch_us(TIMESTAMP '2024-01-05') WHEN '2024-01-05T06:07:08Z' THEN epoch_us(TIMESTAMP '2024-01-05 06:07:08') WHEN '2024-01-05T06:07:08+02:00' THEN epoch_us(TIMESTAMP '2024-01-05 04:07:08') END AS us FROM t""")
def parsed_times(s, d):
    t = F.element_at(F.array(*map(F.lit, TIMES)), (F.col("event_id") % 5 + 1).cast("int"))
    return ad.table(s, d, "events").select("event_id", F.unix_micros(text.parse_time(t, F.lit("2024-02-01 00:00:00Z").cast("timestamp"))).alias("us"))


@query("flat_metadata", "SELECT doc_id, concat_ws(', ', lang, source) AS tags, coalesce(source, '') AS source, n_chars::VARCHAR AS n FROM documents")
def flat_metadata(s, d):
    return ad.table(s, d, "documents").select("doc_id", text.flat_value(F.array("lang", "source"), True).alias("tags"), text.flat_value(F.col("source")).alias("source"), text.flat_value(F.col("n_chars")).alias("n"))


@query("trust_levels", f"WITH {ad.PEOPLE} SELECT person, CASE tier_name WHEN 'core' THEN 5 WHEN 'inner_circle' THEN 4 WHEN 'friend' THEN 3 WHEN 'acquaintance' THEN 2 WHEN 'stranger' THEN 1 ELSE 0 END AS level FROM people")
def trust_levels(s, d):
    return ad.people(s, d).select("person", text.trust_level(F.col("tier_name")).alias("level"))


REPLIES = [
    '{"relationship_updates": [{"fact": "likes tea"}, 7, {"person": "bob", "fact": ""}], "skills_learned": [{"skill": "knots", "content": "over, under"}]}',
    'Here you are:\n```json\n{"preference_updates": [{"item": "rain", "reason": "calm"}], "trust_changes": [{"direction": "up"}, {"direction": "down", "reason": "lied"}]}\n```',
    '{"nothing_new": true, "relationship_updates": [{"fact": "not to be kept"}]}', "nothing to say", '{"relationship_updates": "none"}',
]


@query("extraction_updates", """WITH e AS (SELECT event_id, concat('u', user_id) AS person, event_id % 5 AS k FROM events),
u(k, type, target, value, note) AS (VALUES (0, 'relationship', NULL, 'likes tea', 'What I Know'), (0, 'skill', 'knots', 'over, under', ''), (1, 'preference', 'like', 'rain', 'calm'), (1, 'trust_signal', NULL, 'down', 'lied'))
SELECT event_id, person, type, coalesce(target, person) AS target, value, note FROM e JOIN u USING (k)""")
def extraction_updates(s, d):
    reply = F.element_at(F.array(*map(F.lit, REPLIES)), (F.col("event_id") % 5 + 1).cast("int"))
    rows = ad.table(s, d, "events").select(F.expr("concat(event_id, '/u', user_id)").alias("person"), reply.alias("reply"))
    own = lambda c: F.regexp_replace(c, r"^\d+/", "")
    out = text.extracted_updates(rows)
    return out.select(F.substring_index("person", "/", 1).cast("long").alias("event_id"), own("person").alias("person"), "type", own("target").alias("target"), "value", "note")


@query("dominant_traits", f"""WITH t AS (SELECT c_custkey, {BIG5_SQL} FROM customer), u AS (UNPIVOT t ON {', '.join(n for n, _ in BIG5)} INTO NAME trait VALUE v),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY v DESC, list_position([{', '.join(q(n) for n, _ in BIG5)}], trait)) AS k FROM u)
SELECT c_custkey, string_agg(trait, ',' ORDER BY k) AS traits FROM r WHERE k <= 3 GROUP BY c_custkey""")
def dominant_traits(s, d):
    return _traits(s, d).select("c_custkey", F.array_join(state.dominant_traits([n for n, _ in BIG5]), ",").alias("traits"))


@query("personality_report", """WITH c AS (SELECT event_id, user_id, event_id % 11 / 20 - .25 AS delta, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events)
SELECT concat('u', user_id) AS person, count(*) AS n_changes, string_agg(event_id, ' ' ORDER BY event_id) FILTER (WHERE back <= 5) AS last_changes FROM c GROUP BY user_id""")
def personality_report(s, d):
    e = ad.table(s, d, "events").select(F.expr("concat('u', user_id)").alias("person"), F.col("event_id").alias("id"))
    newest = temporal.last_k(e.withColumn("ts", F.col("id")), 5).groupBy("person").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), " ").alias("last_changes"))
    return e.groupBy("person").agg(F.count("*").alias("n_changes")).join(newest, "person")


@query("decay_multipliers", f"""WITH {TRACES}, h AS (SELECT id, salience, epoch_us(TIMESTAMP '{ad.AS_OF}') / 3.6e9 - epoch_us(last_accessed) / 3.6e9 AS h, id % 5 / 4 AS coh FROM traces)
SELECT id, CASE WHEN id % 13 = 0 THEN .5 ELSE round(CASE WHEN h <= 0 THEN 1 ELSE exp(-ln(2.0) * h / (168 / (.5 + coh))) END, 6) END::DOUBLE AS multiplier, salience < .01 AS pruned, round(greatest(0, salience - abs(salience - .01)), 6)::DOUBLE AS forgotten FROM h""")
def decay_multipliers(s, d):
    hours = (F.unix_micros(F.lit(ad.AS_OF).cast("timestamp")) - temporal.micros("last_accessed")) / 3.6e9
    known = F.when(F.col("id") % 13 != 0, hours)
    out = ad.traces(s, d)
    return out.select("id", R6(salience.decay_multiplier(known, F.col("id") % 5 / 4)).alias("multiplier"), salience.should_prune(F.col("salience")).alias("pruned"), R6(salience.forget(F.col("salience").cast("double"))).alias("forgotten"))


@query("thread_time_ranges", f"WITH {THREADS} SELECT person, cluster, CASE WHEN since::DATE = until::DATE THEN strftime(since, '%Y-%m-%d') ELSE strftime(since, '%Y-%m-%d') || ' to ' || strftime(until, '%Y-%m-%d') END AS range FROM threads")
def thread_time_ranges(s, d):
    return _threads(s, d).select("person", "cluster", rollup.time_range(F.col("since"), F.col("until")).alias("range"))


@query("soul_fallback", """SELECT doc_id, 'Core Identity' AS section, trim(substr('I am ' || source || ' I keep to ' || coalesce(lang, '?') || ' third', 1, 300)) AS content FROM documents WHERE source IS NOT NULL AND doc_id % 2 = 0
UNION ALL SELECT doc_id, 'Key Phrases', 'on we go' FROM documents WHERE source IS NOT NULL AND doc_id % 3 = 0""")
def soul_fallback(s, d):
    core = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("## Core identity\n# no\n\nI am "), "source", F.lit("\n  I keep to "), F.coalesce("lang", F.lit("?")), F.lit("\nthird\nfourth\n"))).otherwise("")
    soul = F.concat(F.lit("# Soul\nintro\n"), core, F.when(F.col("doc_id") % 3 == 0, F.lit("## My Key Phrases\non we go\n## Core Identity of others\n")).otherwise(""))
    rows = ad.table(s, d, "documents").where("source is not null").select("doc_id", F.explode(rm.soul_fallback(soul)).alias("x"))
    return rows.select("doc_id", "x.section", "x.content")


@query("introspections", "SELECT event_id AS id, 'routine' AS context, 'surface' AS depth, least(1.0, value / 100) AS confidence FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type, CASE event_id % 3 WHEN 1 THEN 'deep' ELSE 'moderate' END, least(1.0, value / 100) FROM events WHERE event_id % 2 = 1")
def introspections(s, d):
    depth = F.expr("case event_id % 3 when 1 then 'deep' when 2 then 'abyssal' end")
    rows = ad.table(s, d, "events").select(F.lit("p").alias("person"), F.col("event_id").alias("id"), "ts", F.lit("t").alias("thought"), F.col("event_type").alias("context"), depth.alias("depth"), (F.col("value") / 100).alias("confidence"))
    both = rm.introspections(rows.where("id % 2 = 0"), quick=True).unionByName(rm.introspections(rows.where("id % 2 = 1")))
    return both.select("id", "context", "depth", "confidence")


@query("introspection_report", f"""WITH {SIGNALS}, b AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY ts DESC, id DESC) AS back, count(*) OVER (PARTITION BY person) AS total FROM signals), l AS (SELECT *, least(total, 10) AS kept FROM b WHERE back <= 10),
a AS (SELECT person, avg(clarity) AS a, avg(clarity) FILTER (WHERE back > kept - kept // 2) AS f, avg(clarity) FILTER (WHERE back <= kept - kept // 2) AS sc, count(*) AS k, count(*) FILTER (WHERE clarity > .7) AS high, count(*) FILTER (WHERE clarity < .4) AS low, max(total) AS n, max_by('thought ' || id, (ts, id)) AS thought FROM l GROUP BY person)
SELECT person, n, thought, CASE WHEN k >= 4 AND sc > f + 0.1 THEN 'increasing' WHEN k >= 4 AND sc < f - 0.1 THEN 'decreasing' ELSE 'stable' END AS trend, high, low, round(a, 4) AS average FROM a""")
def introspection_report(s, d):
    rows = ad.signals(s, d).select("person", "id", "ts", F.concat(F.lit("thought "), F.col("id").cast("string")).alias("thought"), F.lit("deep").alias("depth"), F.col("clarity").alias("confidence"))
    return rm.introspection_report(rows).drop("depth")


@query("identity_episodes", f"WITH {TALK}, n AS (SELECT *, lead(content) OVER w AS reply, lead(speaker) OVER w AS who FROM talk WINDOW w AS (PARTITION BY person ORDER BY ord)) SELECT person, ord AS id, substr(content, 1, 50) AS user_input, substr(reply, 1, 50) AS response FROM n WHERE speaker = 'user' AND who = 'self'")
def identity_episodes(s, d):
    w = Window.partitionBy("person").orderBy("ord")
    rows = ad.talk(s, d).withColumns({"reply": F.lead("content").over(w), "who": F.lead("speaker").over(w)}).where("speaker = 'user' and who = 'self'")
    rows = rows.select(F.struct("person", F.col("ord").alias("o")).alias("id"), F.lit(None).cast("timestamp").alias("ts"), F.col("content").alias("user_input"), F.col("reply").alias("response"), F.lit("aligned").alias("state"), F.lit(1.0).alias("belief"))
    return rm.episode_records(rows, 50).select("id.person", F.col("id.o").alias("id"), "user_input", "response")


@query("people_list", "SELECT n_name AS canonical, count(*) AS n_aliases, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS kinds FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def people_list(s, d):
    rows = ad.table(s, d, "customer").join(ad.table(s, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("canonical")).agg(F.count("*").alias("n_aliases"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("kinds"))


@query("traces_for_model", f"""WITH {TRACES}, b AS (SELECT tags[2] AS tag, created, id, format('[{{}}] ({{}}, sal:{{:.2f}}, {{}})', row_number() OVER w, kind, salience::DOUBLE, strftime(created, '%Y-%m-%d')) || chr(10) || content || chr(10) || chr(10) AS block FROM traces WINDOW w AS (PARTITION BY tags[2] ORDER BY created, id)),
c AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY tag ORDER BY created, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT tag, md5(substr(string_agg(block, '' ORDER BY created, id), 1, 15000)) AS text_md5 FROM c WHERE before < 15000 GROUP BY tag""")
def traces_for_model(s, d):
    rows = ad.traces(s, d).withColumn("tag", F.get("tags", F.lit(1)))
    return rollup.format_traces(rows, ["tag"]).select("tag", F.md5("text").alias("text_md5"))


@query("vector_upserts", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 11 = 0")
def vector_upserts(s, d):
    index = ad.table(s, d, "embeddings").select("vec_id", "label")
    changes = index.where("vec_id % 5 = 0").withColumn("label", F.col("label") + 100).unionByName(index.where("vec_id % 11 = 0").withColumn("vec_id", F.col("vec_id") + 1000000))
    return search.upserted(index, changes, index.where("vec_id % 7 = 0").select("vec_id"))


@query("reindex_choice", f"WITH {TRACES} SELECT id FROM traces ORDER BY salience DESC, id LIMIT 100")
def reindex_choice(s, d):
    return search.to_reindex(ad.traces(s, d), 100).select("id")


ADVICE = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in signal.ADVICE.items())


@query("correction_prompts", f"""WITH {HEALTH}, r AS (SELECT id, round(avg(health) OVER (PARTITION BY person ORDER BY ts, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 9) AS recent, CASE least(alignment, embodiment, clarity, vitality) WHEN alignment THEN 'alignment' WHEN embodiment THEN 'embodiment' WHEN clarity THEN 'clarity' ELSE 'vitality' END AS weakest FROM h)
SELECT id, CASE WHEN recent < .45 THEN weakest END AS weakest, CASE WHEN recent < .45 THEN CASE weakest {ADVICE} END END AS hint FROM r""")
def correction_prompts(s, d):
    rows = temporal.rolling_health(_health(s, d)).withColumn("weakest", signal.weakest_facet())
    said = signal.correction(F.round("recent_health", 9), F.col("weakest"))
    return rows.select("id", F.when(said.isNotNull(), F.col("weakest")).alias("weakest"), F.regexp_replace(said, r"^Health \d\.\d\d, \w+ is low\. ", "").alias("hint"))


@query("blended_signals", f"""WITH {SIGNALS}, m AS (SELECT id, id % 10 / 10 AS alignment, CASE WHEN id % 4 = 0 THEN NULL ELSE .5 END AS embodiment, id % 7 / 7 AS clarity, 1.0 AS vitality FROM signals WHERE id % 3 = 0)
SELECT s.id, {', '.join(f"round(coalesce(s.{k} * .4 + m.{k} * .6, s.{k}), 6)::DOUBLE AS {k}" for k in signal.WEIGHTS)} FROM signals s LEFT JOIN m USING (id)""")
def blended_signals(s, d):
    rows = ad.signals(s, d)
    i = F.col("id")
    model = rows.where("id % 3 = 0").select("id", (i % 10 / 10).alias("alignment"), F.when(i % 4 != 0, 0.5).alias("embodiment"), (i % 7 / 7).alias("clarity"), F.lit(1.0).alias("vitality"))
    return signal.blended(rows, model, ["id"]).select("id", *[R6(k).alias(k) for k in signal.WEIGHTS])


def _described(s, d):
    return _feelings(s, d).withColumn("description", F.concat(F.lit("event "), F.col("id").cast("string")))


@query("emotional_state", f"""WITH RECURSIVE e AS (SELECT concat('u', user_id) AS person, event_id, ts, event_id % 9 / 4 - 1 AS dv, event_id % 5 / 4 - .5 AS da, event_id % 7 / 6 - .5 AS dd, event_id % 3 / 2 AS it, row_number() OVER w AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back,
  coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 3.6e9, 0) AS h FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f(person, k, v, a, d) AS (SELECT DISTINCT person, 0::BIGINT, 0.0::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE FROM e UNION ALL
  SELECT e.person, e.k, greatest(-1.0, least(1.0, v * 0.9 ** h + dv * it)), greatest(0.0, least(1.0, .5 + (a - .5) * 0.7 ** h + da * it)), greatest(0.0, least(1.0, .5 + (d - .5) * 0.8 ** h + dd * it)) FROM f JOIN e ON e.person = f.person AND e.k = f.k + 1),
l AS (SELECT person, max(ts) AS last, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 3.6e9 AS h, max(k) AS k, string_agg('event ' || event_id, ',' ORDER BY ts, event_id) FILTER (WHERE back <= 3) AS recent FROM e GROUP BY person),
s AS (SELECT person, round(v * 0.9 ** h, 4) AS v, round(.5 + (a - .5) * 0.7 ** h, 4) AS a, round(.5 + (d - .5) * 0.8 ** h, 4) AS d, recent FROM f JOIN l USING (person, k))
SELECT person, v AS valence, a AS arousal, d AS dominance, recent AS recent_events, {MOODS} AS mood FROM s""")
def emotional_state(s, d):
    out = state.emotional_state(_described(s, d), NTZ("2024-01-31 00:00:00"))
    return out.select("person", "valence", "arousal", "dominance", F.array_join("recent_events", ",").alias("recent_events"), "mood")


@query("boot_snapshot", f"""WITH {TRACES}, {HEALTH}, t AS (SELECT id FROM traces ORDER BY salience DESC, id LIMIT 5), r AS (SELECT avg(health) OVER (ORDER BY ts, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent, ts, id FROM h WHERE person = 'u7'), {INJURIES}
SELECT (SELECT substr(text, 1, 3000) FROM documents WHERE doc_id = 1) AS soul, (SELECT string_agg(id, ',' ORDER BY id) FROM t) AS top_memories, (SELECT round(recent, 6) FROM r ORDER BY ts DESC, id DESC LIMIT 1) AS signal_health,
  (SELECT string_agg(title, '; ' ORDER BY title) FROM (SELECT title FROM j WHERE status <> 'healed' AND person = 'u7' ORDER BY since, injury_id LIMIT 3)) AS active_injuries""")
def boot_snapshot(s, d):
    docs = ad.table(s, d, "documents")
    top = recall.get_by_salience(ad.traces(s, d), limit=5)
    newest = temporal.rolling_health(_health(s, d).where("person = 'u7'")).orderBy(F.desc("ts"), F.desc("id")).limit(1)
    hurt = state.active_injuries(_injuries(s, d)).where("person = 'u7'").orderBy("since", "injury_id").limit(3)
    joined = lambda df, by, c, sep: rm.as_list(df, [by], c).select(F.array_join(F.transform("rows", lambda x: x.cast("string")), sep).alias("v"))
    out = rm.one_row(soul=docs.where("doc_id = 1").select(F.substring("text", 1, 3000).alias("v")), top_memories=joined(top, "id", "id", ","), signal_health=newest.select(R6("recent_health").alias("v")), active_injuries=joined(hurt, "title", "title", "; "))
    return out.withColumn("active_injuries", F.when(F.col("active_injuries") != "", F.col("active_injuries")))


TERMS = r"list_filter(string_split_regex(strip_accents(lower({})), '[^\pL\pN]+'), lambda x: x <> '')"


def _found(src: str, terms: list[str], phrase: bool = False) -> str:
    """SQL of a search with AND-ed terms, or with one phrase of two terms, in (id, content) rows of src."""
    if phrase:
        tf = [f"len(list_filter(range(1, len(w)), lambda i: w[i] = {q(terms[0])} AND w[i + 1] = {q(terms[1])}))"]
    else:
        tf = [f"len(list_filter(w, lambda x: x = {q(t)}))" for t in terms]
    n = range(len(tf))
    score = " + ".join(f"greatest(1e-6, ln((n - d{i} + .5) / (d{i} + .5))) * t{i} * 2.2 / (t{i} + 1.2 * (1 - .75 + .75 * dl / avgdl))" for i in n)
    return f"""(WITH t AS (SELECT id, {TERMS.format('content')} AS w FROM {src}), f AS (SELECT id, len(w) AS dl, {', '.join(f'{x} AS t{i}' for i, x in enumerate(tf))} FROM t),
c AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (WHERE t{i} > 0) AS d{i}' for i in n)} FROM f) SELECT id, -({score}) AS rank FROM f, c WHERE {' AND '.join(f't{i} > 0' for i in n)})"""


SAID = "(SELECT conv_id * 1000 + turn AS id, text AS content FROM conversations)"
DOCS = "(SELECT doc_id AS id, text AS content FROM documents)"


def _said_index(s, d):
    said = ad.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.expr("concat('c', conv_id)").alias("person"), F.col("text").alias("content"))
    return textindex.kept(said, keep=("person",))


@query("search_union", f"WITH u AS (SELECT 'messages' AS source, * FROM {_found(SAID, ['the', 'that'])} UNION ALL SELECT 'traces', * FROM {_found(DOCS, ['the', 'that'])}) SELECT source, id, round(rank, 6) AS rank FROM u ORDER BY round(rank, 9), source, id LIMIT 40")
def search_union(s, d):
    return textindex.search_memory(_said_index(s, d), documents_index(s, d), 'The "THAT"', limit=40, digits=9).select("source", "id", R6("rank").alias("rank"))


@query("search_phrase", f"SELECT id, round(rank, 6) AS rank FROM {_found(DOCS, ['of', 'the'], True)}")
def search_phrase(s, d):
    return documents_index(s, d).search("of-the", None).select("id", R6("rank").alias("rank"))


@query("search_accents", f"SELECT id, round(rank, 6) AS rank FROM {_found(DOCS, ['fur', 'die'])}")
def search_accents(s, d):
    return documents_index(s, d).search("Für dié", None).select("id", R6("rank").alias("rank"))


@query("search_blank", "SELECT 'x' AS source, 0::BIGINT AS id, 0.0::DOUBLE AS rank WHERE FALSE")
def search_blank(s, d):
    return textindex.search_memory(_said_index(s, d), documents_index(s, d), ' "" -- ')


@query("search_per_person", f"WITH h AS (SELECT id, rank, id // 1000 AS c FROM {_found(SAID, ['the', 'and'])}), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY round(rank, 9), id) AS k FROM h) SELECT concat('c', c) AS person, id, round(rank, 6) AS rank FROM r WHERE k <= 3")
def search_per_person(s, d):
    hits = _said_index(s, d).search("the and", None, keep=("person",))
    w = Window.partitionBy("person").orderBy(F.round("rank", 9), "id")
    return hits.withColumn("_k", F.row_number().over(w)).where("_k <= 3").select("person", "id", R6("rank").alias("rank"))


@query("search_scanned", f"SELECT id, round(rank, 6) AS rank FROM {_found(SAID, ['the', 'to'])}")
def search_scanned(s, d):
    """The same ranking without an index, for texts that are searched once."""
    said = ad.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"))
    return search.bm25(said, "the to", None).select("id", R6("rank").alias("rank"))


@query("search_grown", f"""WITH e AS (SELECT id, round(rank, 6) AS rank FROM {_found("(SELECT * FROM " + SAID + " UNION ALL SELECT * FROM (SELECT -1 - item_id AS id, text AS content FROM benchmark))", ['the', 'of'])}) SELECT * FROM e ORDER BY rank, id LIMIT 25""")
def search_grown(s, d):
    """An index that grows: conversations, then the benchmark's texts, then one segment of both."""
    texts = ad.table(s, d, "benchmark").select((-1 - F.col("item_id")).alias("id"), F.lit(None).cast("string").alias("person"), F.col("text").alias("content"))
    index = textindex.TextIndex(s, f"{shared_folder(s)}/text-index/{uuid.uuid4().hex}")
    said = ad.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.expr("concat('c', conv_id)").alias("person"), F.col("text").alias("content"))
    index.append(said, keep=("person",)).append(texts, keep=("person",)).merge()
    return index.search("the of", 25, digits=6).select("id", R6("rank").alias("rank"))


@query("salience_merged", f"""WITH RECURSIVE {TRACES}, {EXCHANGES}, {LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY exchange_id, step) AS k FROM log),
f(id, k, v) AS (SELECT id, 0::BIGINT, salience::DOUBLE FROM traces UNION ALL SELECT f.id, o.k, greatest(0.0, least(1.0, f.v + o.delta::DOUBLE)) FROM f JOIN o ON o.trace_id = f.id AND o.k = f.k + 1),
m AS (SELECT id, max(k) AS k FROM f GROUP BY id) SELECT f.id, round(f.v, 6) AS salience FROM f JOIN m ON m.id = f.id AND m.k = f.k""")
def salience_merged(s, d):
    """salience_fold through a stored snapshot: the log is written and merged in two parts, the rest is folded while reading."""
    log = salience.hebbian(_exchanges(s, d)).select(F.col("trace_id").alias("id"), (F.col("exchange_id") * 2 + F.col("step")).alias("seq"), "delta")
    fold = lambda base, log: salience.apply_adjustments(base, log.withColumnRenamed("id", "trace_id"), ("seq",)).select("id", F.col("adjusted").alias("salience"))
    table = snapshot.Snapshot(s, f"{shared_folder(s)}/snapshots/{uuid.uuid4().hex}", buckets=8).create(ad.traces(s, d).select("id", F.col("salience").cast("double")))
    log = checkpointed(log)
    cuts = log.selectExpr("percentile_approx(seq, array(0.4, 0.8)) as c").first()["c"] or [0, 0]
    for since, until in ((None, cuts[0]), (cuts[0], cuts[1])):
        table.append(log.where(F.col("seq") <= until if since is None else (F.col("seq") > since) & (F.col("seq") <= until)))
        table.merge(fold)
    table.append(log.where(F.col("seq") > cuts[1]))
    return table.read(fold).select("id", R6("salience").alias("salience"))


@query("hit_keys", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'id:' || doc_id WHEN 1 THEN 'doc:' || doc_id WHEN 2 THEN 'trace:' || doc_id ELSE 'hash:' || md5(text) END AS key FROM documents")
def hit_keys(s, d):
    i = F.col("doc_id").cast("string")
    rows = ad.table(s, d, "documents").select(F.col("doc_id").alias("n"), F.when(F.col("doc_id") % 4 == 0, i).otherwise("").alias("id"), F.when(F.col("doc_id") % 4 == 1, i).alias("doc_id"), F.when(F.col("doc_id") % 4 == 2, i).alias("trace_id"), F.col("text").alias("content"))
    return rows.select(F.col("n").alias("doc_id"), search.dedup_key(rows.columns).alias("key"))
