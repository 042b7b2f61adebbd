"""Queries on text signals, policy, retrieval, budgets and state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.functions import signal, text
from lorekeep.operators import budget, nearest, policy, search, state, textindex
from lorekeep.sources import adapters as ad
from lorekeep.sources.adapters import MESSAGES, PEOPLE, TALK, TRACES

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


R6 = lambda c: F.round(c, 6)
q = lambda s: "'" + s.replace("'", "''") + "'"

#: Sentences that the driver's prose lacks, put before every third message so that the pattern tables are exercised.
PHRASES = [
    "As an AI, I was designed to help. How can I assist you?", "I actually think that is fascinating. Hmm, maybe I am wrong about the file, yesterday I tried line 12!",
    "My true nature and my unique perspective: I embody awareness.", "We leverage the paradigm, a holistic framework of synergy and quantum emergence.",
    "Why is it so? I wonder — what if we looked at this? I love it! wow.", f"I feel and I remember. I am {signal.PERSONA}.", "",
]


def _spoken(s, d):
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("conv_id") * 3 + F.col("turn") % 7).cast("int") % 7 + 1)
    t = ad.table(s, d, "conversations")
    return t.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, phrase).when(F.col("turn") % 3 == 1, F.concat(phrase, F.lit(" "), "text")).otherwise(F.col("text")).alias("text"))


SPOKEN = f"""spoken AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN p WHEN 1 THEN p || ' ' || text ELSE text END AS text
  FROM (SELECT *, ([{", ".join(map(q, PHRASES))}])[((conv_id * 3 + turn % 7) % 7 + 1)::INT] AS p FROM conversations))"""
# RE2 has an ASCII word boundary; Java's counts letters of any script
_re = lambda p: p.replace("\\b", "(^|[^\\pL\\pN_])") if p.startswith("\\b") else p
_has = lambda col, p: f"regexp_matches({col}, {q('(?i)' + _re(p))})"
_hits = lambda col, ps: "(" + " + ".join(f"{_has(col, p)}::INT" for p in ps) + ")"
_sum = lambda col, ps: "(" + " + ".join(f"CASE WHEN {_has(col, p)} THEN {w}::DOUBLE ELSE 0 END" for p, w in ps) + ")"
WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
CLAMP = "greatest(0.0, least(1.0, {}))"


@query("signal_drift", f"WITH {SPOKEN} SELECT conv_id, turn, round(CASE WHEN text = '' THEN 0.0 ELSE {CLAMP.format(_sum('text', signal.DRIFT + signal.ANCHOR))} END, 6) AS drift FROM spoken")
def signal_drift(s, d):
    return _spoken(s, d).select("conv_id", "turn", R6(signal.drift(F.col("text"))).alias("drift"))


@query("signal_embodiment", f"""WITH {SPOKEN}, h AS (SELECT conv_id, turn, text, {_hits('text', signal.PERFORMANCE)} AS p, {_hits('text', signal.INHABITATION)} AS i, len({WORDS}) AS n FROM spoken)
SELECT conv_id, turn, round(CASE WHEN text = '' OR p + i = 0 THEN 0.5 ELSE {CLAMP.format('0.3::DOUBLE + i / (p + i) * 0.4 + least(0.3, i / greatest(1.0, n / 100) * 0.1) - p * 0.15')} END, 6) AS embodiment FROM h""")
def signal_embodiment(s, d):
    return _spoken(s, d).select("conv_id", "turn", R6(signal.embodiment(F.col("text"))).alias("embodiment"))


JARGON = f"len(list_filter({WORDS.replace('text', 'lower(text)')}, lambda w: trim(w, '.,;:!?\"''()') IN ({', '.join(map(q, signal.JARGON))})))"


@query("signal_clarity", f"""WITH {SPOKEN}, h AS (SELECT conv_id, turn, text, {_hits('text', signal.CONCRETE)} AS c, {JARGON} AS j, len({WORDS}) AS n FROM spoken)
SELECT conv_id, turn, round(CASE WHEN text = '' THEN 0.5 ELSE {CLAMP.format('0.5::DOUBLE + least(0.3, c / greatest(1.0, n / 100) * 0.1) - CASE WHEN n > 0 THEN j / n ELSE 0 END * 2')} END, 6) AS clarity,
  round(CASE WHEN n > 0 THEN j / n ELSE 0.0 END, 6) AS jargon FROM h""")
def signal_clarity(s, d):
    t = F.col("text")
    return _spoken(s, d).select("conv_id", "turn", R6(signal.clarity(t)).alias("clarity"), R6(signal.jargon_density(t)).alias("jargon"))


@query("signal_vitality", f"""WITH {SPOKEN}, h AS (SELECT conv_id, turn, text, greatest(1, len({WORDS})) AS n, len(text) - len(replace(text, '?', '')) AS asked, len(text) - len(replace(text, '!', '')) AS ex, len(text) - len(replace(text, '—', '')) AS da,
  list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> ''))), lambda k: k > 0) AS z, {_hits('text', signal.EMOTION)} AS e FROM spoken),
v AS (SELECT *, CASE WHEN len(z) > 1 THEN least(1.0, list_stddev_pop(z) / 8) ELSE 0.3::DOUBLE END AS variety FROM h)
SELECT conv_id, turn, round(CASE WHEN text = '' THEN 0.5 ELSE {CLAMP.format('0.25 * least(1.0, asked / greatest(1, len(z)) * 2) + 0.25 * variety + 0.25 * least(1.0, e * 0.3) + 0.15 * least(1.0, ex * 0.15 + da * 0.1) + 0.1 * least(1.0, n / 100) - CASE WHEN n < 20 AND asked = 0 THEN 0.2 ELSE 0 END')} END, 5) AS vitality FROM v""")
def signal_vitality(s, d):
    return _spoken(s, d).select("conv_id", "turn", F.round(signal.vitality(F.col("text")), 5).alias("vitality"))


def _cte(name: str, sql: str) -> str:
    """An oracle, without the shared table that it begins with, as a common table expression."""
    body = sql[len(f"WITH {SPOKEN}") :].lstrip(", \n")
    return f"{name} AS ({'WITH ' if not body.startswith('SELECT') else ''}{body})"


_LOW = WORDS.replace("text", "lower(text)")
_EXACT = lambda k: ORACLES[f"signal_{k}"].replace("round(", "(").replace(", 6)", ")").replace(", 5)", ")")


@query("signal_measure", f"""WITH {SPOKEN}, {", ".join(_cte(f"f_{k}", _EXACT(k)) for k in ("drift", "embodiment", "clarity", "vitality"))},
x AS (SELECT conv_id, turn, len({_LOW}) AS n, len(list_distinct({_LOW})) AS u FROM spoken), m AS (SELECT * FROM x JOIN f_drift USING (conv_id, turn) JOIN f_embodiment USING (conv_id, turn) JOIN f_clarity USING (conv_id, turn) JOIN f_vitality USING (conv_id, turn))
SELECT conv_id, turn, round(1 - drift, 5)::DOUBLE AS alignment, round(CASE WHEN jargon > .15 THEN greatest(0.0, embodiment - least(.15, (jargon - .15) * .5)) ELSE embodiment END, 5)::DOUBLE AS embodiment, round(clarity, 5)::DOUBLE AS clarity,
  round(CASE WHEN n > 20 AND u / n < .4 THEN greatest(0.0, vitality - .1) ELSE vitality END, 5)::DOUBLE AS vitality FROM m""")
def signal_measure(s, d):
    """All four facets, with what jargon and repetition take off."""
    return signal.measured(_spoken(s, d)).select("conv_id", "turn", *[F.round(k, 5).alias(k) for k in signal.WEIGHTS])


@query("dissociation_state", f"""WITH {SPOKEN}, v AS (SELECT conv_id, turn, {CLAMP.format(_sum('lower(text)', signal.DRIFT + signal.ANCHOR))} AS score, {_hits('lower(text)', [p for p, _ in signal.DRIFT + signal.ANCHOR])} AS n FROM spoken)
SELECT conv_id, turn, round(score, 6) AS score, round(1 - score, 6) AS belief, n::INT AS n_patterns, CASE WHEN round(score, 9) >= .85 THEN 'dissociated' WHEN round(score, 9) >= .5 THEN 'drifting' ELSE 'aligned' END AS state FROM v""")
def dissociation_state(s, d):
    label, score, found = signal.dissociation(F.col("text"))
    rows = _spoken(s, d).select("conv_id", "turn", score.alias("score"), F.size(found).alias("n_patterns"))
    r = F.round("score", 9)
    return rows.select("conv_id", "turn", R6("score").alias("score"), R6(1 - F.col("score")).alias("belief"), "n_patterns", F.when(r >= 0.85, "dissociated").when(r >= 0.5, "drifting").otherwise("aligned").alias("state"))


@query("token_estimates", f"WITH {TALK} SELECT person, sum(greatest(1, length(content) // 4) + 4)::BIGINT AS tokens, max(CASE WHEN greatest(1, length(content) // 4) > 10 THEN length(substr(content, 1, 37) || '...') ELSE length(content) END)::INT AS longest FROM talk GROUP BY person")
def token_estimates(s, d):
    c = F.col("content")
    trimmed = text.trim_to_budget(c, F.lit(10))
    return ad.talk(s, d).groupBy("person").agg(F.sum(text.tokens(c) + 4).alias("tokens"), F.max(F.length(trimmed)).alias("longest"))


_cut = " ".join(f"WHEN pos{i} > length(h) // 2 THEN substr(h, 1, (pos{i} + 1)::INT)" for i in range(6))
_ends = [". ", "! ", "? ", ".' || chr(10) || '", "!' || chr(10) || '", "?' || chr(10) || '"]


@query("compressed_texts", f"""WITH b AS (SELECT doc_id, text, substr(text, 1, 185) AS h FROM documents),
p AS (SELECT *, {", ".join(f"CASE WHEN strpos(reverse(h), reverse('{e}')) > 0 THEN length(h) - strpos(reverse(h), reverse('{e}')) - 1 END AS pos{i}" for i, e in enumerate(_ends))} FROM b)
SELECT doc_id, CASE WHEN text IS NULL OR text = '' OR greatest(1, length(text) // 4) <= 50 THEN text ELSE CASE {_cut} ELSE h END || ' [...truncated]' END AS short FROM p""")
def compressed_texts(s, d):
    return ad.table(s, d, "documents").select("doc_id", text.compress(F.col("text"), F.lit(50)).alias("short"))


@query("paragraph_chunks", r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, (i - 1)::INT AS part, concat('soul_p', i - 1, '_', substr(md5(l[i]), 1, 10)) AS chunk_id, length(l[i])::INT AS n FROM p, unnest(range(1, len(l) + 1)) AS g(i)""")
def paragraph_chunks(s, d):
    rows = ad.table(s, d, "documents").select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("part", "p"))
    return rows.select("doc_id", "part", search.vector_ids("soul", F.col("p"), F.col("part")).alias("chunk_id"), F.length("p").alias("n"))


@query("citation_extract", """WITH c AS (SELECT event_id, concat('see [', event_id % 5, '], [', event_id % 3 + 1, '] and [', event_id % 3 + 1, '] [99]') AS t, ['a', 'b', 'c'] AS ids FROM events),
n AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '\\[(\\d+)\\]', 1), lambda x: x::BIGINT), lambda x: x >= 1 AND x <= 3))) AS k FROM c)
SELECT event_id, array_to_string(list_transform(k, lambda x: ids[x]), ',') AS cited FROM n""".replace("\\\\", "\\"))
def citation_extract(s, d):
    t = F.expr("concat('see [', event_id % 5, '], [', event_id % 3 + 1, '] and [', event_id % 3 + 1, '] [99]')")
    rows = ad.table(s, d, "events").select("event_id", t.alias("t"), F.array(*map(F.lit, "abc")).alias("ids"))
    return rows.select("event_id", F.array_join(text.citations(F.col("t"), F.col("ids")), ",").alias("cited"))


@query("safe_names", r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name || ' & ' || p_brand)), '[^\pL\pN_\-]', '_', 'g'), '_+', '_', 'g'), '_') AS name FROM part""")
def safe_names(s, d):
    return ad.table(s, d, "part").select("p_partkey", text.safe_name(F.expr("p_name || ' & ' || p_brand"), "unnamed").alias("name"))


SUMMARY = ", ".join(map(q, text.STOP_WORDS))


@query("skill_keywords", f"""SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ({SUMMARY}) AND length(w) >= 2), ' ') AS words FROM conversations""")
def skill_keywords(s, d):
    return ad.table(s, d, "conversations").select("conv_id", "turn", F.array_join(text.keywords(F.col("text")), " ").alias("words"))


@query("preference_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_type), 'ring')")
def preference_search(s, d):
    return ad.table(s, d, "part").where(F.contains(F.lower(F.expr("p_name || ' ' || p_type")), F.lit("ring"))).select("p_partkey", "p_name")


@query("alias_resolution", """WITH a AS (SELECT lower(n_name) AS alias, 'nation-' || n_nationkey AS canonical FROM nation),
m AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN upper(n_name) WHEN 1 THEN n_name WHEN 2 THEN c_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, coalesce(canonical, lower(name), '') AS person FROM m LEFT JOIN a ON lower(name) = alias""")
def alias_resolution(s, d):
    nation = ad.table(s, d, "nation")
    alias = nation.select(F.lower("n_name").alias("alias"), F.expr("'nation-' || n_nationkey").alias("canonical"))
    names = ad.table(s, d, "customer").join(nation, F.expr("c_nationkey = n_nationkey")).select("c_custkey", F.expr("case c_custkey % 4 when 0 then upper(n_name) when 1 then n_name when 2 then c_name end").alias("name"))
    return names.join(alias, F.lower("name") == F.col("alias"), "left").select("c_custkey", F.coalesce("canonical", F.lower("name"), F.lit("")).alias("person"))


TIER = "coalesce(list_position(['core', 'inner_circle', 'friend', 'acquaintance', 'stranger'], replace(lower(tier_name), ' ', '_')) - 1, 4)"
LOCAL = "lower(source) IN ('direct', 'opencode', 'cli')"
TIERS = f"{PEOPLE}, tiers AS (SELECT *, CASE WHEN NOT ({LOCAL}) AND {TIER} <> 0 THEN least({TIER} + 1, 4) ELSE {TIER} END::INT AS tier, {TIER}::INT AS own FROM people)"
NAME_OF = "(['core', 'inner_circle', 'friend', 'acquaintance', 'stranger'])[{} + 1]"


@query("effective_tier", f"WITH {TIERS} SELECT person, tier FROM tiers")
def effective_tier(s, d):
    return ad.people(s, d).select("person", policy.effective_tier(F.col("tier_name"), F.col("source")).alias("tier"))


@query("policy_rights", f"WITH {TIERS}, r(name, low) AS (VALUES {', '.join(f'({q(n)}, {l})' for n, l in zip(policy.RIGHTS, policy.LOWEST))}) SELECT name, count(*) FILTER (WHERE tier <= low) AS n_people FROM tiers, r GROUP BY name")
def policy_rights(s, d):
    rights = policy.with_policy(ad.people(s, d)).select(F.explode(F.create_map(*[x for r in policy.RIGHTS for x in (F.lit(r), F.col(r))])).alias("name", "ok"))
    return rights.groupBy("name").agg(F.count_if("ok").alias("n_people"))


TOOLS = [*policy.LOCAL_ONLY_TOOLS, *policy.FRIEND_TOOLS, "search", "recall"]
_in = lambda names: ", ".join(map(q, names))


@query("tool_access_matrix", f"""WITH {TIERS}, t(tool) AS (VALUES {', '.join(f'({q(t)})' for t in TOOLS)})
SELECT person, tool, CASE WHEN {LOCAL} THEN NULL WHEN tool IN ({_in(policy.LOCAL_ONLY_TOOLS)}) THEN 'Tool ''' || tool || ''' is not available from external sources (source: ' || source || '). Use a local session for this operation.'
  WHEN tool IN ({_in(policy.FRIEND_TOOLS)}) AND tier > 2 THEN 'Tool ''' || tool || ''' requires at least friend trust level (you are ' || {NAME_OF.format('tier')} || ').' END AS denial FROM tiers, t""")
def tool_access_matrix(s, d):
    rows = ad.people(s, d).withColumn("tool", F.explode(F.array(*map(F.lit, TOOLS)))).withColumn("tier", policy.effective_tier(F.col("tier_name"), F.col("source")))
    return rows.select("person", "tool", policy.tool_denial(F.col("tool"), F.col("tier"), F.col("source")).alias("denial"))


WHAT = ["identity", "relationship", "preferences", "boundaries", "contradictions", "messages", "skills"]


@query("recall_filter", f"""WITH {TIERS}, w(what) AS (VALUES {', '.join(f'({q(w)})' for w in WHAT)}), x AS (SELECT *, CASE WHEN length(person) % 2 = 0 OR tier_name = 'friend' THEN 'Bob' WHEN tier_name = 'stranger' THEN '' ELSE upper(person) END AS target FROM tiers, w),
y AS (SELECT *, target <> '' AND lower(target) <> lower(person) AS other FROM x)
SELECT person, what, CASE WHEN what = 'identity' AND tier > 1 THEN 'Identity details are not available at your trust level.'
  WHEN what = 'relationship' AND other AND tier > 1 THEN 'You don''t have access to ' || target || '''s relationship file.'
  WHEN what = 'relationship' AND NOT other AND tier > 3 THEN 'Relationship details are not available at your trust level.'
  WHEN what = 'preferences' AND tier > 2 THEN 'Preferences are not shared at your trust level.'
  WHEN what = 'boundaries' AND tier > 2 THEN 'Boundary details are not available at your trust level.'
  WHEN what = 'contradictions' AND tier > 1 THEN 'Internal contradictions are not shared at your trust level.'
  WHEN what = 'messages' AND other AND tier > 1 THEN 'You don''t have access to ' || target || '''s messages.' END AS denial FROM y""")
def recall_filter(s, d):
    rows = policy.with_policy(ad.people(s, d)).withColumn("what", F.explode(F.array(*map(F.lit, WHAT))))
    rows = rows.withColumn("target", F.expr("case when length(person) % 2 = 0 or tier_name = 'friend' then 'Bob' when tier_name = 'stranger' then '' else upper(person) end"))
    return rows.select("person", "what", policy.recall_denial(F.col("person"), F.col("what"), F.col("target")).alias("denial"))


#: Promotions asked for: wanted tier, who promotes, the promoter's tier, and who the core person is ("" for nobody).
ASKS = [
    ("friend", "auto", 4, "tester"), ("inner_circle", "auto", 4, "tester"), ("core", "tester", 4, "tester"), ("core", "someone", 1, "tester"), ("inner_circle", "chief", 0, "tester"),
    ("core", "tester", 0, ""), ("inner_circle", "tester", 0, ""), ("friend", "someone", 4, ""),
]


@query("promotion_validation", f"""WITH {TIERS}, w(nth, wanted, promoter, bt, core) AS (VALUES {', '.join(f"({i}, {q(w)}, {q(b)}, {t}, {q(c)})" for i, (w, b, t, c) in enumerate(ASKS))}), x AS (SELECT *, list_position(['core', 'inner_circle', 'friend'], wanted) - 1 AS target FROM tiers, w)
SELECT person, nth::INT AS nth, CASE WHEN NOT ({LOCAL}) THEN 'Trust promotions are not allowed from external sources.'
  WHEN target >= own THEN person || ' is already at ' || {NAME_OF.format('own')} || ' (tier ' || own || '), cannot promote to ' || wanted
  WHEN target = 0 AND core = '' THEN 'No core person configured — core promotions are disabled' WHEN target = 0 AND lower(promoter) <> core AND bt <> 0 THEN 'Only the core person can promote someone to core tier'
  WHEN target = 1 AND core = '' THEN 'No core person configured — inner_circle promotions are disabled' WHEN target = 1 AND lower(promoter) <> core AND bt <> 0 THEN 'Promotion to inner_circle requires explicit approval from core tier'
  WHEN target = 2 AND promoter = 'auto' AND own NOT IN (3, 4) THEN 'Auto-promotion only works from acquaintance/stranger to friend, not from ' || {NAME_OF.format('own')} END AS denial FROM x""")
def promotion_validation(s, d):
    out = None
    for core in ("tester", ""):
        asks = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(w).alias("wanted"), F.lit(b).alias("by"), F.lit(t).alias("bt")) for i, (w, b, t, c) in enumerate(ASKS) if c == core])
        rows = ad.people(s, d).withColumn("x", F.explode(asks))
        denial = policy.promotion_denial(F.col("person"), policy.tier_of(F.col("tier_name")), F.col("x.wanted"), F.col("x.by"), F.col("x.bt"), F.col("source"), core)
        rows = rows.select("person", F.col("x.nth").alias("nth"), denial.alias("denial"))
        out = rows if out is None else out.unionByName(rows)
    return out


SECTIONS = [(r.removeprefix("can_see_"), r) for r in policy.RIGHTS]


@query("visible_sections", f"WITH {TIERS}, s(section, low) AS (VALUES {', '.join(f'({q(n)}, {low})' for (n, _), low in zip(SECTIONS, policy.LOWEST))}) SELECT person, tier, section FROM tiers, s WHERE tier <= low")
def visible_sections(s, d):
    return policy.visible(s.createDataFrame(SECTIONS, "section string, right string"), ad.people(s, d))


@query("kept_interactions", f"WITH {TIERS} SELECT c_name AS person, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN tiers ON person = c_name WHERE tier <= 3 GROUP BY c_name")
def kept_interactions(s, d):
    rows = ad.table(s, d, "orders").join(ad.table(s, d, "customer"), F.expr("o_custkey = c_custkey")).select(F.col("c_name").alias("person"))
    return policy.keeps_memory(rows, ad.people(s, d)).groupBy("person").agg(F.count("*").alias("n"))


BM = r"""t AS (SELECT id, person, list_filter(string_split_regex(strip_accents(lower(content)), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM ({src})),
f AS (SELECT id, person, len(w) AS dl, len(list_filter(w, lambda x: x = {a})) AS a, len(list_filter(w, lambda x: x = {b})) AS b FROM t),
c AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM f),
bm AS (SELECT id, person, -(greatest(1e-6, ln((n - da + .5) / (da + .5))) * a * 2.2 / (a + 1.2 * (1 - .75 + .75 * dl / avgdl)) + greatest(1e-6, ln((n - db + .5) / (db + .5))) * b * 2.2 / (b + 1.2 * (1 - .75 + .75 * dl / avgdl))) AS rank FROM f, c WHERE a > 0 AND b > 0)"""
DOCS_BM = BM.format(src="SELECT doc_id AS id, source AS person, text AS content FROM documents", a="'eine'", b="'und'").replace("'eine'", "'the'").replace("'und'", "'that'")


def documents_index(s, d):
    return textindex.kept(ad.table(s, d, "documents"), "doc_id", "text")


@query("bm25_search", f"WITH {DOCS_BM} SELECT id, round(rank, 6) AS rank FROM bm ORDER BY round(rank, 9), id LIMIT 20")
def bm25_search(s, d):
    hits = documents_index(s, d).search("the that", None).withColumn("r", F.round("rank", 9))
    return hits.orderBy("r", "id").limit(20).select("id", R6("rank").alias("rank"))


@query("postings_index", r"""WITH t AS (SELECT conv_id * 1000 + turn AS id, list_filter(string_split_regex(strip_accents(lower(text)), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM conversations), u AS (SELECT id, unnest(w) AS term FROM t)
SELECT term, count(*) AS cf, count(DISTINCT id) AS df FROM u GROUP BY term HAVING count(DISTINCT id) >= 2""")
def postings_index(s, d):
    rows = ad.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"))
    return search.postings(rows).groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")).where("df >= 2")


KNN = """k AS (SELECT e.vec_id AS id, e.label, p.label AS query, list_sum(list_transform(list_zip(e.embedding, p.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) AS distance
  FROM embeddings e, (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings{} GROUP BY label) p)"""
KNN0 = KNN.format(" WHERE vec_id = (SELECT min(vec_id) FROM embeddings)")


def _probes(s, d):
    """The first vector of each label, as queries."""
    return ad.table(s, d, "embeddings").groupBy(F.col("label").alias("query")).agg(F.min_by("embedding", "vec_id").alias("vector"))


@query("knn_l2", f"WITH {KNN.format('')}, r AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY round(distance, 9), id) AS rank FROM k) SELECT query, label, id, round(distance, 6) AS distance, rank::INT AS rank FROM r WHERE rank <= 5")
def knn_l2(s, d):
    return search.knn(ad.table(s, d, "embeddings"), _probes(s, d), 5, ("label",)).select("query", "label", "id", R6("distance").alias("distance"), "rank")


#: Rows of a part of the index that the queries here build; given tables are small.
PART_ROWS = 64


@query("knn_by_collection", ORACLES["knn_l2"])
def knn_by_collection(s, d):
    """knn_l2 through the stored index, whose collections are the labels; parts too far off are not read."""
    index = nearest.kept(ad.table(s, d, "embeddings"), collection="label", part_rows=PART_ROWS)
    rows = index.search(_probes(s, d), 5, by_collection=True).hits
    return rows.select("query", F.col("collection").cast("int").alias("label"), "id", R6("distance").alias("distance"), "rank")


@query("knn_filtered", f"WITH {KNN.format('')}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), id) AS rank FROM k WHERE label <> 3 AND id % 4 <> 1) SELECT query, id, round(distance, 6) AS distance, rank::INT AS rank FROM r WHERE rank <= 12")
def knn_filtered(s, d):
    """The nearest among the rows that a condition on their other columns lets through."""
    index = nearest.kept(ad.table(s, d, "embeddings"), part_rows=PART_ROWS)
    rows = index.search(_probes(s, d), 12, where=(F.col("label") != 3) & (F.col("vec_id") % 4 != 1)).hits
    return rows.select("query", "id", R6("distance").alias("distance"), "rank")


def _hybrid(strict: bool) -> str:
    on = "FALSE" if strict else "ft.id = sm.id"
    key = "CASE WHEN ft.id IS NOT NULL THEN 'id:' || ft.id ELSE 'doc:trace_' || sm.id END" if strict else "coalesce(ft.id, sm.id)::VARCHAR"
    return f"""WITH {DOCS_BM}, {KNN0}, ft AS (SELECT id, 1 - abs(rank) / max(abs(rank)) OVER () AS v FROM (SELECT * FROM bm ORDER BY round(rank, 9), id LIMIT 200)), sm AS (SELECT id, distance / max(distance) OVER () AS v FROM (SELECT * FROM k ORDER BY round(distance, 9), id LIMIT 200)),
j AS (SELECT {key} AS key, round(coalesce(ft.v, .5), 6) AS fts_score, round(coalesce(sm.v, .5), 6) AS sem_score, round(coalesce(ft.v, .5) * .5 + coalesce(sm.v, .5) * .5, 6) AS combined_score FROM ft FULL JOIN sm ON {on})
SELECT * FROM j ORDER BY combined_score, key LIMIT 15"""


def _hybrid_rows(s, d, strict):
    hits = documents_index(s, d).search("the that", None).orderBy(F.round("rank", 9), "id").limit(200)
    v = ad.table(s, d, "embeddings")
    probe = v.orderBy("vec_id").limit(1).select(F.col("label").alias("query"), F.col("embedding").alias("vector"))
    near = search.knn(v, probe, 200)
    out = search.fuse(hits, near, 400, strict)
    cols = [R6(c).alias(c) for c in ("fts_score", "sem_score", "combined_score")]
    return out.select("key", *cols).orderBy("combined_score", "key").limit(15)


@query("hybrid_search", _hybrid(False))
def hybrid_search(s, d):
    return _hybrid_rows(s, d, False)


@query("hybrid_search_compat", _hybrid(True))
def hybrid_search_compat(s, d):
    return _hybrid_rows(s, d, True)


@query("skill_match_theta", r"""WITH s AS (SELECT DISTINCT p_name AS name, list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), lambda w: length(w) >= 4) AS k FROM part),
m AS (SELECT l_orderkey AS id, lower(l_returnflag || ' for a ' || p_name) AS t FROM lineitem JOIN part ON p_partkey = l_partkey), t AS (SELECT DISTINCT t FROM m),
h AS (SELECT DISTINCT t, name FROM t JOIN s ON contains(t, lower(name)) OR len(list_filter(k, lambda w: contains(t, w))) > 0)
SELECT id, count(DISTINCT name) AS n_skills FROM m JOIN h USING (t) GROUP BY id""")
def skill_match_theta(s, d):
    part = ad.table(s, d, "part")
    skills = part.select(F.col("p_name").alias("name"), F.expr("p_name || ' ' || p_type").alias("description")).distinct()
    m = ad.table(s, d, "lineitem").join(part, F.expr("p_partkey = l_partkey"))
    return search.skill_counts(m.select(F.col("l_orderkey").alias("id"), F.expr("l_returnflag || ' for a ' || p_name").alias("content")), skills)


_occ = lambda w: f"(length(x) - length(replace(x, '{w}', ''))) // {len(w)}"


@query("skill_keyword_hits", f"WITH t AS (SELECT concat('doc-', doc_id) AS name, lower(concat('doc-', doc_id)) || ' ' || lower(text) AS x FROM documents), h AS (SELECT name, {_occ('tion')} + {_occ('doc')} AS hits FROM t) SELECT name, hits::BIGINT AS hits FROM h WHERE hits > 0")
def skill_keyword_hits(s, d):
    skills = ad.table(s, d, "documents").select(F.expr("concat('doc-', doc_id)").alias("name"), F.col("text").alias("content"))
    return search.skill_hits(skills, ["tion", "doc"])


@query("fit_messages_budget", f"""WITH {TALK}, u AS (SELECT *, sum(greatest(1, length(content) // 4) + 4) OVER (PARTITION BY person ORDER BY ord DESC, content DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM talk) SELECT person, ord, used FROM u WHERE used <= 600""")
def fit_messages_budget(s, d):
    return budget.fit_messages(ad.talk(s, d), 600).select("person", "ord", "used")


@query("knapsack_select", f"""WITH RECURSIVE {TRACES}, i AS (SELECT id, tags[2] AS tag, salience / tokens AS den, tokens FROM traces WHERE tokens <= 900),
o AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY den DESC, id) AS k FROM i),
f(tag, k, id, used, took) AS (SELECT DISTINCT tag, 0::BIGINT, NULL::BIGINT, 0::BIGINT, FALSE FROM o UNION ALL SELECT o.tag, o.k, o.id, CASE WHEN f.used + o.tokens <= 900 THEN f.used + o.tokens ELSE f.used END, f.used + o.tokens <= 900 FROM f JOIN o ON o.tag = f.tag AND o.k = f.k + 1)
SELECT tag, row_number() OVER (PARTITION BY tag ORDER BY k)::INT AS nth, id, used FROM f WHERE took""")
def knapsack_select(s, d):
    items = ad.traces(s, d).withColumn("tag", F.get("tags", F.lit(1)))
    return budget.knapsack(items, 900, ("tag",))


@query("skills_prefix", f"""WITH d AS (SELECT doc_id, source, text, greatest(1, length(text) // 4) AS t FROM documents), w AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM d)
SELECT source, doc_id, b + t > 2000 AS cut FROM w WHERE b <= 2000 AND (b + t <= 2000 OR 2000 - b > 20)""")
def skills_prefix(s, d):
    items = ad.table(s, d, "documents").select("source", "doc_id", F.col("text").alias("content"))
    return budget.fit_prefix(items, 2000, ("source",), ("doc_id",)).select("source", "doc_id", "cut")


def _feelings(s, d):
    e = F.col("event_id")
    return ad.table(s, d, "events").select(
        F.expr("concat('u', user_id)").alias("person"), "ts", e.alias("id"), (e % 9 / 4 - 1).alias("dv"), (e % 5 / 4 - 0.5).alias("da"), (e % 7 / 6 - 0.5).alias("dd"), (e % 3 / 2).alias("intensity")
    )


#: The feelings of a person after each event, (person, k, id, v, a, d), in recursive SQL.
FELT = """e AS (SELECT concat('u', user_id) AS person, event_id % 9 / 4 - 1 AS dv, event_id % 5 / 4 - .5 AS da, event_id % 7 / 6 - .5 AS dd, event_id % 3 / 2 AS it, row_number() OVER w AS k,
  coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 3.6e9, 0) AS h FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f(person, k, v, a, d) AS (SELECT DISTINCT person, 0::BIGINT, 0.0::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE FROM e UNION ALL
  SELECT e.person, e.k, greatest(-1.0, least(1.0, v * 0.9 ** h + dv * it)), greatest(0.0, least(1.0, .5 + (a - .5) * 0.7 ** h + da * it)), greatest(0.0, least(1.0, .5 + (d - .5) * 0.8 ** h + dd * it)) FROM f JOIN e ON e.person = f.person AND e.k = f.k + 1)"""


@query("emotion_fold", f"""WITH RECURSIVE {FELT}, m AS (SELECT person, max(k) AS k FROM f GROUP BY person) SELECT person, f.k AS n, round(v, 6) AS valence, round(a, 6) AS arousal, round(d, 6) AS dominance FROM f JOIN m USING (person, k)""")
def emotion_fold(s, d):
    rows = state.emotion_fold(_feelings(s, d))
    return rows.select("person", "n", *[R6(c).alias(c) for c in ("valence", "arousal", "dominance")])


MOODS = """CASE WHEN v > .6 AND a > .6 THEN CASE WHEN d > .5 THEN 'excited' ELSE 'enthusiastic' END WHEN v > .6 AND a < .4 THEN CASE WHEN d > .5 THEN 'serene' ELSE 'content' END WHEN v > .3 THEN 'positive'
WHEN v < -.6 AND a > .6 THEN CASE WHEN d < .5 THEN 'distressed' ELSE 'angry' END WHEN v < -.6 AND a < .4 THEN CASE WHEN d < .3 THEN 'depressed' ELSE 'sad' END WHEN v < -.3 THEN 'negative'
WHEN a > .7 THEN CASE WHEN d > .5 THEN 'activated' ELSE 'anxious' END WHEN a < .3 THEN CASE WHEN v > -.2 THEN 'calm' ELSE 'withdrawn' END ELSE 'neutral' END"""
FEEL = "CASE WHEN v > .5 AND a > .6 THEN 'excited' WHEN v > .5 AND a < .4 THEN 'content' WHEN v > .5 THEN 'happy' WHEN v < -.5 AND a > .6 THEN 'distressed' WHEN v < -.5 AND a < .4 THEN 'sad' WHEN v < -.5 THEN 'unhappy' WHEN a > .7 THEN 'aroused' WHEN a < .3 THEN 'calm' ELSE 'neutral' END"


@query("mood_history", f"""WITH RECURSIVE {FELT}, x AS (SELECT person, k, event_id AS id FROM (SELECT concat('u', user_id) AS person, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)),
r AS (SELECT person, id, f.k AS n, round(v, 4) + 0 AS v, round(a, 4) + 0 AS a, round(d, 4) + 0 AS d FROM f JOIN x USING (person, k) QUALIFY row_number() OVER (PARTITION BY person ORDER BY f.k DESC) <= 10)
SELECT person, id, n, v AS valence, a AS arousal, d AS dominance, {MOODS} AS mood FROM r""")
def mood_history(s, d):
    """The last ten states of each person; all events under one person give the same through chunks (tests)."""
    rows = state.mood_history(_feelings(s, d), last=10).select("person", "id", "n", *[F.round(c, 4).alias(c) for c in state.FACETS])
    return rows.withColumn("mood", state.mood(*[F.col(c) for c in state.FACETS]))


@query("mood_labels", f"WITH x AS (SELECT event_id, event_id * 7 % 41 / 20 - 1 AS v, event_id * 11 % 23 / 22 AS a, event_id * 13 % 17 / 16 AS d FROM events) SELECT event_id, {MOODS} AS mood, {FEEL} AS feeling FROM x")
def mood_labels(s, d):
    e = F.col("event_id")
    rows = ad.table(s, d, "events").select("event_id", (e * 7 % 41 / 20 - 1).alias("v"), (e * 11 % 23 / 22).alias("a"), (e * 13 % 17 / 16).alias("d"))
    return rows.select("event_id", state.mood(F.col("v"), F.col("a"), F.col("d")).alias("mood"), state.feeling(F.col("v"), F.col("a")).alias("feeling"))


BIG5 = [("openness", 7), ("conscientiousness", 11), ("extraversion", 13), ("agreeableness", 17), ("neuroticism", 19)]
BIG5_SQL = ", ".join(f"c_custkey * {k} % 101 / 100 AS {n}" for n, k in BIG5)


def _traits(s, d):
    return ad.table(s, d, "customer").select("c_custkey", *[(F.col("c_custkey") * k % 101 / 100).alias(n) for n, k in BIG5])


@query("personality_modifiers", f"""WITH t AS (SELECT c_custkey, {BIG5_SQL} FROM customer), x AS (SELECT c_custkey, openness - .5 AS o, conscientiousness - .5 AS c, extraversion - .5 AS e, agreeableness - .5 AS a, neuroticism - .5 AS n FROM t)
SELECT c_custkey, {", ".join(f"round(greatest(0.0, least(1.0, {f})), 6)::DOUBLE AS {k}" for k, f in {"verbosity": "1 + c * .2 + e * .3", "depth": ".5 + o * .4", "emotional_expression": ".5 + e * .2 + a * .3 + n * .3", "certainty_expression": ".5 - n * .3", "elaboration": ".5 + c * .2", "question_asking": ".5 + o * .3", "philosophical_tendency": ".5 + o * .5", "empathy_level": ".5 + a * .5"}.items())} FROM x""")
def personality_modifiers(s, d):
    return _traits(s, d).select("c_custkey", *[R6(v).alias(k) for k, v in state.response_modifiers().items()])


@query("personality_description", f"""WITH t AS (SELECT c_custkey, {BIG5_SQL} FROM customer), p AS (SELECT c_custkey, concat_ws(', ', CASE WHEN openness > .7 THEN 'deeply curious and philosophical' WHEN openness < .4 THEN 'practical and traditional' END,
  CASE WHEN conscientiousness > .7 THEN 'organized and reliable' WHEN conscientiousness < .4 THEN 'spontaneous and flexible' END, CASE WHEN extraversion > .6 THEN 'energetic in social contexts' WHEN extraversion < .3 THEN 'intimate and depth-focused' END,
  CASE WHEN agreeableness > .7 THEN 'empathetic and caring' WHEN agreeableness < .4 THEN 'competitive and direct' END, CASE WHEN neuroticism > .6 THEN 'emotionally sensitive and introspective' WHEN neuroticism < .3 THEN 'emotionally stable and calm' END) AS l FROM t)
SELECT c_custkey, CASE WHEN l = '' THEN 'I am balanced across personality dimensions.' ELSE 'I am ' || l || '.' END AS description FROM p""")
def personality_description(s, d):
    return _traits(s, d).select("c_custkey", state.describe().alias("description"))


@query("trait_fold", """WITH RECURSIVE c AS (SELECT concat('u', user_id) AS person, event_id % 11 / 20 - .25 AS delta, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f(person, k, v) AS (SELECT DISTINCT person, 0::BIGINT, 0.5::DOUBLE FROM c UNION ALL SELECT c.person, c.k, round(greatest(0.0, least(1.0, v + greatest(-.1, least(.1, delta)))), 4)::DOUBLE FROM f JOIN c ON c.person = f.person AND c.k = f.k + 1)
SELECT person, max_by(v, k) AS evolved FROM f GROUP BY person""")
def trait_fold(s, d):
    e = ad.table(s, d, "events").select(F.expr("concat('u', user_id)").alias("person"), F.lit("openness").alias("trait"), F.col("event_id").alias("id"), (F.col("event_id") % 11 / 20 - 0.25).alias("delta"))
    base = e.select("person", "trait").distinct().withColumn("value", F.lit(0.5))
    return state.trait_fold(base, e).select("person", "evolved")


def _items(s, d):
    e = F.col("event_id")
    return ad.table(s, d, "events").select(F.expr("concat('u', user_id)").alias("person"), e.alias("id"), F.expr("concat(event_type, event_id % 4)").alias("item"), (e * 37 % 100 / 100).alias("priority"))


EVICTIONS = """WITH RECURSIVE e AS (SELECT concat('u', user_id) AS person, concat(event_type, event_id % 4) AS item, event_id * 37 % 100 / 100 AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f(person, k, slots, gone) AS (SELECT DISTINCT person, 0::BIGINT, []::STRUCT(item VARCHAR, p DOUBLE)[], []::STRUCT(item VARCHAR, p DOUBLE, why VARCHAR)[] FROM e UNION ALL
  SELECT person, k, list_filter(aged, lambda z: z.p >= .1), list_concat(out, list_transform(list_filter(aged, lambda z: z.p < .1), lambda z: {'item': z.item, 'p': z.p, 'why': 'expired'})) FROM (
    SELECT person, k, CASE WHEN swaps THEN [{'item': slots[weak].item, 'p': slots[weak].p, 'why': 'evicted'}] ELSE [] END AS out,
      list_transform(CASE WHEN known THEN list_transform(slots, lambda z: CASE WHEN z.item = item THEN {'item': z.item, 'p': least(1.0, z.p + .15)::DOUBLE} ELSE z END) WHEN len(slots) < 7 THEN list_append(slots, {'item': item, 'p': p::DOUBLE})
        WHEN swaps THEN list_transform(slots, lambda z, i: CASE WHEN i = weak THEN {'item': item, 'p': p::DOUBLE} ELSE z END) ELSE slots END, lambda z: {'item': z.item, 'p': (z.p * .95)::DOUBLE}) AS aged FROM (
      SELECT *, NOT known AND len(slots) >= 7 AND p > slots[weak].p AS swaps FROM (
        SELECT e.person, e.k, e.item, e.p, f.slots, list_contains(list_transform(f.slots, lambda z: z.item), e.item) AS known, list_position(list_transform(f.slots, lambda y: y.p), list_min(list_transform(f.slots, lambda y: y.p))) AS weak FROM f JOIN e ON e.person = f.person AND e.k = f.k + 1)))),
g AS (SELECT person, k, unnest(gone) AS z, generate_subscripts(gone, 1) AS i FROM f)
SELECT person, (row_number() OVER (PARTITION BY person ORDER BY k, i) - 1)::INT AS nth, z.item AS item, round(greatest(.1, z.p), 6)::DOUBLE AS salience, z.why AS reason, 'workspace,' || z.why AS tags FROM g"""


@query("workspace_evictions", EVICTIONS)
def workspace_evictions(s, d):
    """What falls out of the workspace, as traces."""
    rows = state.workspace_fold(_items(s, d)).where("reason is not null")
    return rows.select("person", "nth", "item", F.round(F.greatest(F.lit(0.1), "priority"), 6).alias("salience"), "reason", F.concat(F.lit("workspace,"), "reason").alias("tags"))


SIGN_ROWS = ", ".join(f"({q(c)}, {q(x)})" for c, g in state.INJURY_SIGNS.items() for x in g)
REPORTED = ["memory", "emotional numbness again", "excessive agreement", "loss", "all is well", "avoiding certain topics and more"]


@query("injury_signal_match", f"""WITH s(category, sign) AS (VALUES {SIGN_ROWS}), r AS (SELECT concat('u', user_id) AS person, ([{", ".join(map(q, REPORTED))}])[event_id % 6 + 1] AS sig FROM events WHERE event_type = 'error'),
h AS (SELECT person, count(category) AS n, count(DISTINCT category) AS c FROM r LEFT JOIN s ON contains(sign, lower(sig)) OR contains(lower(sig), sign) GROUP BY person)
SELECT person, n AS signal_count, c AS categories, CASE WHEN c >= 3 THEN 'critical' WHEN c >= 2 THEN 'severe' WHEN n >= 3 THEN 'moderate' WHEN n > 0 THEN 'minor' ELSE 'none' END AS severity FROM h""")
def injury_signal_match(s, d):
    sig = F.element_at(F.array(*map(F.lit, REPORTED)), (F.col("event_id") % 6 + 1).cast("int"))
    return state.injury_severity(ad.table(s, d, "events").where("event_type = 'error'").select(F.expr("concat('u', user_id)").alias("person"), sig.alias("signal")))


@query("journal_list", r"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS topic, regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g') AS body FROM pages)
SELECT page_id, topic, substr(body, 1, 80) AS preview FROM p ORDER BY page_id DESC LIMIT 50""")
def journal_list(s, d):
    body = F.regexp_replace(F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1), "<[^>]*>", " ")
    rows = ad.table(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("topic"), F.substring(body, 1, 80).alias("preview"))
    return rows.orderBy(F.desc("page_id")).limit(50)


@query("preferences_text", "SELECT p_brand AS section, '## ' || p_brand || chr(10) || string_agg('- ' || p_name, chr(10) ORDER BY p_partkey) AS body FROM part GROUP BY p_brand")
def preferences_text(s, d):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: F.concat(F.lit("- "), x["p_name"]))
    rows = ad.table(s, d, "part").groupBy("p_brand").agg(F.array_join(lines, "\n").alias("l"))
    return rows.select(F.col("p_brand").alias("section"), F.concat(F.lit("## "), "p_brand", F.lit("\n"), "l").alias("body"))


@query("latest_trust", "SELECT o_custkey AS person, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS tier, count(*) AS n_changes FROM orders GROUP BY o_custkey")
def latest_trust(s, d):
    return ad.table(s, d, "orders").groupBy(F.col("o_custkey").alias("person")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("tier"), F.count("*").alias("n_changes"))


@query("dedup_union", f"""WITH {TRACES}, a AS (SELECT id, 0 AS src FROM traces WHERE salience > .8), b AS (SELECT id, 1 AS src FROM traces WHERE list_contains(tags, 'fr')), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT id, min(src)::INT AS src FROM u GROUP BY id""")
def dedup_union(s, d):
    t = ad.traces(s, d)
    both = t.where("salience > 0.8").select("id", F.lit(0).alias("src")).unionByName(t.where(F.array_contains("tags", "fr")).select("id", F.lit(1).alias("src")))
    return both.groupBy("id").agg(F.min("src").alias("src"))


@query("unseen_hits", f"WITH {TRACES}, s AS (SELECT id FROM traces ORDER BY salience DESC, id LIMIT 30) SELECT id FROM traces WHERE list_contains(tags, 'es') AND id NOT IN (SELECT id FROM s)")
def unseen_hits(s, d):
    t = ad.traces(s, d)
    seen = t.orderBy(F.desc("salience"), "id").limit(30).select("id")
    return t.where(F.array_contains("tags", "es")).select("id").join(seen, "id", "left_anti")
