"""Queries on what writers leave behind, on the workspace's slots, and the whole snapshot of a boot."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import readmodels as rm
from lorekeep.operators import state, writers
from lorekeep.plans import knowledge, lifecycle, memory, reading
from lorekeep.plans.knowledge import BIG5, BIG5_SQL, _items, _traits
from lorekeep.sources import adapters as ad

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


SECTIONS = "CASE event_id % 3 WHEN 0 THEN 'what i know' WHEN 1 THEN 'Notes' ELSE 'Habits' END"


@query("relationship_writes", f"""WITH w AS (SELECT concat('user ', user_id) AS person, {SECTIONS} AS section, concat('- ', event_type, ' ', event_id) AS line, ts, event_id AS id FROM events),
b AS (SELECT *, min(CASE WHEN section = 'Habits' THEN row(ts, id) END) OVER (PARTITION BY person) AS habit, min(ts) OVER (PARTITION BY person) AS first FROM w),
g AS (SELECT person, min(first) AS first, bool_or(section = 'Habits') AS has, string_agg(chr(10) || line, '' ORDER BY ts, id) FILTER (WHERE section = 'what i know') AS known,
  string_agg(chr(10) || line, '' ORDER BY ts, id) FILTER (WHERE section = 'Notes' AND (habit IS NULL OR row(ts, id) < habit)) AS before,
  string_agg(chr(10) || line, '' ORDER BY ts, id) FILTER (WHERE section = 'Notes' AND row(ts, id) > habit) AS after, string_agg(chr(10) || line, '' ORDER BY ts, id) FILTER (WHERE section = 'Habits') AS habits FROM b GROUP BY person)
SELECT replace(person, ' ', '_') AS name, CASE WHEN split_part(person, ' ', 2)::INT % 2 = 0 THEN '# Known' || chr(10) || '## What I Know' || coalesce(known, '') || chr(10) || '## Notes' || chr(10)
  ELSE concat('# ', replace(person, 'user', 'User'), chr(10), chr(10), '**Trust Tier:** acquaintance', chr(10), '**First Contact:** ', strftime(first, '%Y-%m-%d'), chr(10), chr(10), '## What I Know', chr(10), coalesce(known, ''), chr(10), '## Conversation History', chr(10), chr(10), '## Notes', chr(10)) END
  || coalesce(before, '') || CASE WHEN has THEN chr(10) || coalesce(after, '') || chr(10) || '## Habits' || habits ELSE '' END AS content FROM g""")
def relationship_writes(s, d):
    """Every person's file after all writes: half of them begin with the template, and one section is in neither."""
    e = ad.table(s, d, "events")
    updates = e.select(F.expr("concat('user ', user_id)").alias("person"), F.expr(SECTIONS).alias("section"), F.expr("concat('- ', event_type, ' ', event_id)").alias("content"), "ts", F.col("event_id").alias("id"))
    known = e.where("user_id % 2 = 0").select(F.expr("concat('user_', user_id)").alias("name"), F.lit("# Known\n## What I Know\n## Notes\n").alias("content")).distinct()
    return writers.relationship_files(known, updates)


@query("journal_writes", """WITH w AS (SELECT *, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS nth FROM events)
SELECT event_id AS id, strftime(ts, '%Y-%m-%d') || CASE WHEN nth > 1 THEN '_' || nth ELSE '' END || '.md' AS filename, concat('# Journal: ', event_type, chr(10), chr(10), '**Date:** ', strftime(ts, '%Y-%m-%d %H:%M'), ' UTC', chr(10), '**Topic:** ', event_type, chr(10), chr(10), '---', chr(10), chr(10), props, chr(10)) AS content FROM w""")
def journal_writes(s, d):
    return writers.journal_files(ad.table(s, d, "events").select("ts", F.col("event_id").alias("id"), F.col("event_type").alias("topic"), F.col("props").alias("content")))


@query("skill_writes", r"""WITH w AS (SELECT trim(regexp_replace(regexp_replace(lower(p_type || ' (' || p_size || ')'), '[^\w\-]', '_', 'g'), '_+', '_', 'g'), '_') AS name, p_partkey AS id, p_name AS first FROM part)
SELECT name, '# ' || max_by(first, id) || chr(10) || 'use it' AS content, max_by(first, id) AS description FROM w GROUP BY name""")
def skill_writes(s, d):
    """The last write of each skill; names that become the same file overwrite one another."""
    log = ad.table(s, d, "part").select(F.expr("p_type || ' (' || p_size || ')'").alias("name"), F.expr("'# ' || p_name || '\n' || 'use it'").alias("content"), F.lit(0).alias("ts"), F.col("p_partkey").alias("id"))
    return writers.skill_files(log)


@query("boundary_writes", "SELECT o_orderpriority AS category, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey))::INT AS nth, 'not order ' || o_orderkey AS boundary, strftime(o_orderdate, '%Y-%m-%d') AS added FROM orders")
def boundary_writes(s, d):
    return writers.boundary_rows(ad.table(s, d, "orders").select(F.expr("' ' || o_orderpriority || '  '").alias("category"), F.expr("'not order ' || o_orderkey").alias("boundary"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id")))


@query("contradiction_writes", "SELECT o_orderkey AS id, o_orderpriority AS title, o_orderstatus AS description, strftime(o_orderdate, '%Y-%m-%d') AS added, CASE WHEN o_orderkey % 3 > 0 THEN 'thought ' || o_orderkey END AS current_thinking FROM orders")
def contradiction_writes(s, d):
    log = ad.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("description"), F.col("o_orderdate").alias("ts"), F.expr("if(o_orderkey % 3 > 0, 'thought ' || o_orderkey, '')").alias("current_thinking"))
    return writers.contradiction_rows(log)


SLOTS = lifecycle.ORACLES["workspace_items"].rsplit("SELECT", 1)[0]


def _slots(s, d):
    return state.workspace_fold(_items(s, d)).where("reason is null").drop("reason")


@query("workspace_strongest", SLOTS + "SELECT person, (row_number() OVER (PARTITION BY person ORDER BY z.p DESC, i))::INT AS rank, z.item AS item FROM u QUALIFY row_number() OVER (PARTITION BY person ORDER BY z.p DESC, i) <= 3")
def workspace_strongest(s, d):
    return writers.workspace_list(_slots(s, d), 3)


@query("workspace_accessed", SLOTS + """, a AS (SELECT person, min(i) AS hit FROM u WHERE contains(z.item, 'click') GROUP BY person)
SELECT person, (i - 1)::INT AS nth, z.item AS item, round(CASE WHEN i = hit THEN least(1.0, z.p + .15) ELSE z.p END, 6)::DOUBLE AS priority, CASE WHEN i = hit THEN 0 ELSE z.age END AS age, coalesce(i = hit, FALSE) AS focus FROM u LEFT JOIN a USING (person)
WHERE person <> 'u7'""")
def workspace_accessed(s, d):
    """Each person's first slot about clicks is found and rehearsed; one person's slots are cleared."""
    slots = _slots(s, d)
    out = writers.workspace_access(slots, writers.workspace_find(slots, F.lit("CLICK")))
    gone = slots.sparkSession.createDataFrame([("u7",)], "person string")
    return writers.workspace_clear(out, gone).select("person", "nth", "item", F.round("priority", 6).alias("priority"), "age", "focus")


RUNG = ", ".join(f"printf('- {n.title()}: %.2f', {n}) || '{note}'" for (n, _), note in zip(BIG5, ("  (high = curious, philosophical)", "", "  (low = intimate, depth-focused)", "  (high = empathetic)", "  (moderate = emotionally present)")))


@query("personality_profile", f"""WITH t AS (SELECT c_custkey, {BIG5_SQL} FROM customer), de AS ({knowledge.ORACLES['personality_description']}), m AS ({knowledge.ORACLES['personality_modifiers'].replace(', 6)', ', 12)')})
SELECT c_custkey, concat_ws(chr(10), '## Personality Profile (Big Five)', {RUNG}, '', description, CASE WHEN philosophical_tendency > .6 THEN 'Tendency: lean into philosophical depth over surface answers.' END,
  CASE WHEN empathy_level > .6 THEN 'Tendency: high empathetic resonance with others'' emotions.' END, CASE WHEN certainty_expression < .5 THEN 'Tendency: express uncertainty readily rather than feigning confidence.' END) AS text FROM t JOIN de USING (c_custkey) JOIN m USING (c_custkey)""")
def personality_profile(s, d):
    return _traits(s, d).select("c_custkey", state.profile_text().alias("text"))


OWN = "person = 'u7'"


@query("boot_whole", f"""SELECT sn.soul, sn.top_memories, sn.signal_health, sn.active_injuries, (SELECT left(text, 2000) FROM ({reading.ORACLES['boot_priming']})) AS boot_priming,
(SELECT left(string_agg(body, chr(10) || chr(10) ORDER BY section), 500) FROM ({knowledge.ORACLES['preferences_text']})) AS preferences_summary,
(SELECT left(string_agg('- ' || boundary, chr(10) ORDER BY category, nth), 500) FROM ({ORACLES['boundary_writes']})) AS boundaries_summary,
(SELECT string_agg(filename, ',' ORDER BY filename DESC) FROM (SELECT filename FROM ({ORACLES['journal_writes']}) ORDER BY filename DESC LIMIT 3)) AS recent_journal,
(SELECT mood FROM ({lifecycle.ORACLES['emotional_state']}) WHERE {OWN}) AS mood, (SELECT status FROM ({memory.ORACLES['belief_solidification']}) WHERE {OWN}) AS identity_status,
(SELECT description FROM ({knowledge.ORACLES['personality_description']}) WHERE c_custkey = 7) AS personality, 'active' AS mode FROM ({lifecycle.ORACLES['boot_snapshot']}) sn""")
def boot_whole(s, d):
    """Everything that a session of u7 starts from, in one row; a boot sets the mode to active. Texts are cut before they are joined, so none is large."""
    first = lambda df, order, text, n, sep: df.select(*order, F.substring(text, 1, 500).alias("_t")).orderBy(*order).limit(n).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_t"))), lambda x: x["_t"]), sep).alias("v"))
    boundaries = writers.boundary_rows(ad.table(s, d, "orders").select(F.col("o_orderpriority").alias("category"), F.expr("'- not order ' || o_orderkey").alias("boundary"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id")))
    newest = journal_writes(s, d).select("filename").orderBy(F.desc("filename")).limit(3).agg(F.array_join(F.reverse(F.array_sort(F.collect_list("filename"))), ",").alias("v"))
    own = lambda df, column: df.where(OWN).select(F.col(column).alias("v"))
    cut = lambda df, n: df.select(F.substring("v", 1, n).alias("v"))
    parts = rm.one_row(
        boot_priming=cut(reading.boot_priming(s, d).select(F.col("text").alias("v")), 2000), preferences_summary=cut(first(knowledge.preferences_text(s, d), ["section"], "body", 500, "\n\n"), 500),
        boundaries_summary=cut(first(boundaries, ["category", "nth"], "boundary", 500, "\n"), 500), recent_journal=newest, mood=own(lifecycle.emotional_state(s, d), "mood"),
        identity_status=own(memory.belief_solidification(s, d), "status"), personality=knowledge.personality_description(s, d).where("c_custkey = 7").select(F.col("description").alias("v")),
    )
    return lifecycle.boot_snapshot(s, d).crossJoin(F.broadcast(parts)).withColumn("mode", F.lit("active"))
