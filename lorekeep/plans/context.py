"""Context assembly: what a reply to a person is given, within a token budget.

A request is a row; its sections are columns. Each section may use its share and no more than what those before it left,
so what is left is carried along as a column. Conversation, memories and skills are chosen by the budget operators, one
grouped job over all requests, and the sections are then joined in order.

Memories are chosen from the person's most salient traces, and from the traces that hold every word of the message to be
answered, found in the stored index. Messages have no embeddings in the tables, so the vector half of hybrid search finds
nothing and each hit has its neutral score there. Skills are those that the message names. People whose memory is not kept
get no history and no memories; the workspace is shown to those who may see preferences.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import CUT_MARK, SENTENCE_ENDS, tokens
from lorekeep.operators import budget, policy, recall
from lorekeep.operators.search import skill_matches, terms
from lorekeep.operators.textindex import TextIndex
from lorekeep.plans.knowledge import SUMMARY, documents_index
from lorekeep.session import checkpointed
from lorekeep.sources import adapters as ad

#: Shares of the budget, and what is held back.
SHARES = {"identity": 0.16, "relationship": 0.12, "grounding": 0.10, "recent": 0.22, "episodic": 0.16, "procedural": 0.06}
RESERVE = 0.18
#: Tokens that must be left for an identity to be cut to fit.
FORCE = 50
HINT = "\nWhen your response draws on these memories, cite them as [1], [2], etc."


#: Salient traces of a person, hits that a request may have besides, words that a message needs for a search, recent messages, and workspace items.
SALIENT, HITS, WORDS, RECENT, ITEMS = 30, 10, 3, 20, 5


def last_heard(messages: DataFrame) -> DataFrame:
    """(person, content): each person's last message that is not the engine's own."""
    heard = messages.where(~F.col("speaker").eqNullSafe("self"))
    newest = Window.partitionBy("person").orderBy(F.desc("ord"), F.desc("content"))
    return heard.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").select("person", "content")


def hits(asked: DataFrame, index: TextIndex, limit: int = HITS) -> DataFrame:
    """(person, id, salience): of asked (person, content) the limit best traces of the index that hold every word of it, by BM25.

    A hit's salience is 1 less its combined score. Equal messages are searched once. Of the index the blocks of words that are
    asked for are read, and no text. Ids are unique in the index.
    """
    words = F.array_sort(F.array_distinct(terms(F.col("content"))))
    asked = asked.where(F.size(F.split(F.trim("content"), r"\s+")) >= WORDS).select("person", words.alias("words")).where(F.size("words") > 0)
    asked = checkpointed(asked.withColumn("q", F.unhex(F.sha2(F.array_join("words", " "), 256))))
    top = index.best_holding(asked.select("q", "words").distinct(), limit)
    combined = (1 - F.col("score") / F.max("score").over(Window.partitionBy("q"))) * 0.5 + 0.25
    return asked.join(top.withColumn("salience", 1 - combined), "q").select("person", "id", "salience")


def memories(requests: DataFrame, traces: DataFrame, index: TextIndex) -> DataFrame:
    """person, id, kind, content, salience that requests (person, content: the message, null for none) may choose from.

    Of the most salient traces (id, kind, tags, content, salience), three times SALIENT, those that carry the person as a tag,
    SALIENT at most, and the traces that the message finds beside these.
    """
    top = traces.orderBy(F.desc("salience"), "id").limit(3 * SALIENT)  # a few rows, for all requests
    tagged = top.select("id", "kind", "content", "salience", F.explode(F.array_distinct(F.transform("tags", F.lower))).alias("_tag"))
    own = requests.select("person", F.lower("person").alias("_tag")).join(F.broadcast(tagged), "_tag").drop("_tag")
    own = own.withColumn("_rank", F.row_number().over(Window.partitionBy("person").orderBy(F.desc("salience"), "id"))).where(F.col("_rank") <= SALIENT).drop("_rank")
    own = checkpointed(own)
    found = hits(requests.select("person", "content"), index).join(own.select("person", "id"), ["person", "id"], "left_anti")
    found = checkpointed(found).join(traces.select("id", "content"), "id").withColumn("kind", F.lit("traces"))
    return checkpointed(own.select("person", "id", "kind", "content", "salience").unionByName(found.select("person", "id", "kind", "content", "salience")))


def assemble(requests: DataFrame, messages: DataFrame, traces: DataFrame, skills: DataFrame, total: int = 6000) -> DataFrame:
    """person, context, tokens_used, memories_loaded, trace_ids from requests (person, correction, identity, relationship, grounding).

    messages (person, ord, speaker, content), traces (person, id, kind, content, salience) and skills (person, ord, content)
    are fitted to their shares. Texts are joined to the chosen traces only. A correction is always given, an identity that does not fit is cut further, a
    relationship that does not fit is dropped, the other sections shrink to what is left. The count of tokens is taken anew
    from the whole text, headings included.
    """
    share = {k: int(total * v) for k, v in SHARES.items()}
    available = int(total * (1 - RESERVE))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = checkpointed(_head(requests, share, available))

    budget_of = lambda k: rows.select("person", F.least(F.lit(share[k]), F.lit(available) - F.col("_used")).alias("_budget")).where("_budget > 0")
    told = budget.fit_messages(messages.join(budget_of("recent"), "person"), F.col("_budget"))
    line = F.concat(F.lit("["), F.coalesce("speaker", F.lit("?")), F.lit("]: "), F.coalesce("content", F.lit("")))
    recent = told.groupBy("person").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("recent"), F.count("*").alias("n_recent"))
    rows = checkpointed(_spend(rows.join(recent, "person", "left"), "recent"))

    size = tokens(F.col("content")).alias("tokens")
    choice = traces.join(budget_of("episodic"), "person").select("person", "id", "salience", size, "_budget")
    took = budget.knapsack(choice, F.col("_budget"), ("person",))
    memory = F.format_string("[%d] [%s | sal:%.2f] %s {trace:%s}", "nth", "kind", F.col("salience").cast("double"), "content", F.col("id").cast("string"))
    chosen = took.join(traces, ["person", "id"]).select("person", "nth", "id", "used", memory.alias("l"))
    ordered = F.array_sort(F.collect_list(F.struct("nth", "id", "l")))
    episodic = chosen.groupBy("person").agg(
        F.concat(F.array_join(F.transform(ordered, lambda x: x["l"]), "\n"), F.lit(HINT)).alias("episodic"), F.count("*").alias("n_traces"), F.transform(ordered, lambda x: x["id"]).alias("trace_ids"), F.max("used").alias("_took"),
    )
    rows = checkpointed(rows.join(episodic, "person", "left").withColumn("_used", F.col("_used") + F.coalesce("_took", F.lit(0))))

    known = budget.fit_prefix(skills.join(budget_of("procedural"), "person"), F.col("_budget"), ("person",), ("ord",))
    skilled = known.groupBy("person").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), "\n---\n").alias("skills"), F.count("*").alias("n_skills"))
    rows = rows.join(skilled, "person", "left")

    part = lambda title, c: F.when(text(c) != "", F.concat(F.lit("--- "), title, F.lit(" ---\n"), c))
    sections = F.array_compact(F.array(
        part(F.lit("CORRECTION"), "correction"), part(F.lit("IDENTITY"), "identity"), part(F.concat(F.lit("RELATIONSHIP: "), "person"), "relationship"), part(F.lit("GROUNDING"), "grounding"),
        part(F.lit("RECENT CONVERSATION"), "recent"), part(F.lit("RELEVANT MEMORIES"), "episodic"), part(F.lit("RELEVANT SKILLS"), "skills"),
    ))
    whole = F.array_join(sections, "\n\n")
    loaded = sum((F.coalesce(k, F.lit(0)) for k in ("n_recent", "n_traces", "n_skills")), F.lit(0))
    return rows.select("person", whole.alias("context"), tokens(whole).alias("tokens_used"), loaded.alias("memories_loaded"), "trace_ids")


def _head(requests: DataFrame, share: dict[str, int], available: int) -> DataFrame:
    """requests with the first sections cut, shrunk or dropped (null), and _used, the tokens that they cost.

    Each of them depends on what the one before cost. As columns these steps would repeat one another's expressions, so
    a request's few texts are cut in a small function over Arrow batches.
    """
    ends, mark, force = SENTENCE_ENDS, CUT_MARK, FORCE

    def cost(text):
        return max(1, len(text) // 4)

    def short(text, most):
        if not text or cost(text) <= most:
            return text
        head = text[: max(0, most * 4 - len(mark))]
        for end in ends:
            at = head.rfind(end)
            if at > len(head) // 2:
                return head[: at + 1] + mark
        return head + mark

    def sections(correction, identity, relationship, grounding):
        used = cost(correction) if correction else 0
        left = available - used
        if identity:
            cut = short(identity, share["identity"])
            identity = cut if cost(cut) <= left else short(identity, left) if left > force else None
        used += cost(identity) if identity else 0
        if relationship:
            cut = short(relationship, share["relationship"])
            relationship = cut if used + cost(cut) <= available else None
        used += cost(relationship) if relationship else 0
        most = min(share["grounding"], available - used)
        if grounding:
            cut = short(grounding, most)
            grounding = cut if most > 0 and used + cost(cut) <= available else None
        return correction, identity, relationship, grounding, used + (cost(grounding) if grounding else 0)

    def run(batches):
        for b in batches:
            own = b.columns[0]
            cut = [sections(*r) for r in zip(*(c.to_pylist() for c in b.columns[1:]))]
            yield pa.RecordBatch.from_arrays([own, *(pa.array([r[k] for r in cut], pa.string()) for k in range(4)), pa.array([r[4] for r in cut], pa.int64())], ["person", "correction", "identity", "relationship", "grounding", "_used"])

    cols = ["person", "correction", "identity", "relationship", "grounding"]
    return requests.select(cols).mapInArrow(run, "person string, correction string, identity string, relationship string, grounding string, _used long")


def _spend(rows: DataFrame, column: str) -> DataFrame:
    """rows with what the section in column costs added to _used; an absent one costs nothing."""
    return rows.withColumn("_used", F.col("_used") + F.when(F.col(column).isNotNull(), tokens(F.col(column))).otherwise(0))


def _requests(s: SparkSession, d: str, talk: DataFrame) -> DataFrame:
    """A request for every conversation: its rights, its last message heard, and the texts of its sections."""
    n = F.regexp_extract("person", r"(\d+)", 1).cast("long")
    people = talk.select("person").distinct().withColumns({"tier_name": F.element_at(F.array(*map(F.lit, policy.TIERS)), (n % 5 + 1).cast("int")), "source": F.lit("direct")})
    people = policy.with_policy(people).select("person", "memory_persistent", "can_see_preferences")
    slot = talk.where(~F.col("speaker").eqNullSafe("self")).select("person", "ord", F.substring("content", 1, 24).alias("item"), (F.col("ord") * 37 % 100 / 100).alias("priority"))
    top = Window.partitionBy("person").orderBy(F.desc("priority"), "ord", "item")
    slot = slot.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= ITEMS)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("nth", F.concat(F.lit("- "), "item").alias("l")))), lambda x: x["l"])
    workspace = slot.groupBy("person").agg(F.concat(F.lit("Currently in working memory:\n"), F.array_join(lines, "\n")).alias("workspace"))
    rows = people.join(workspace, "person", "left").join(last_heard(talk), "person", "left")
    grounding = F.when(n % 5 != 0, F.repeat(F.lit("Be kind! "), (n % 70).cast("int")))
    return rows.select(
        "person", "memory_persistent", "content", F.when(n % 4 == 0, F.lit("Name the thing. ")).alias("correction"), F.repeat(F.lit("I keep what matters. "), (n % 60).cast("int")).alias("identity"),
        F.concat(F.lit("Known as "), "person", F.lit(". "), F.repeat(F.lit("Met before. "), (n % 90).cast("int"))).alias("relationship"),
        F.concat_ws("\n\n", F.when(grounding != "", grounding), F.when(F.col("can_see_preferences"), F.col("workspace"))).alias("grounding"),
    )


def _context(s: SparkSession, d: str, total: int) -> DataFrame:
    """A context for every conversation."""
    talk = ad.talk(s, d)
    requests = checkpointed(_requests(s, d, talk))
    kept = requests.where("memory_persistent")
    skill = ad.table(s, d, "benchmark").select(F.col("item_id").alias("ord"), F.format_string("skill-%d", "item_id").alias("name"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("description"), "text")
    named = skill_matches(requests.where("content is not null").select(F.col("person").alias("id"), "content"), skill.select("name", "description"))
    skills = named.join(skill, "name").select(F.col("id").alias("person"), "ord", F.concat(F.lit("Skill "), "name", F.lit(": "), "text").alias("content"))
    traces = ad.traces(s, d).withColumn("tags", F.array_append("tags", F.concat(F.lit("C"), (F.col("id") % 97).cast("string")))).select("id", "kind", "tags", "content", "salience")
    chosen = memories(kept, traces, documents_index(s, d))
    recent = recall.recent_per_person(talk.join(kept.select("person"), "person", "left_semi"), RECENT, ("ord", "content"))
    out = assemble(requests, recent, chosen, skills, total)
    return out.select("person", F.md5("context").alias("context_md5"), "tokens_used", "memories_loaded")


_END = ["'. '", "'! '", "'? '", "'.' || chr(10)", "'!' || chr(10)", "'?' || chr(10)"]
#: A text cut to a token budget, as DuckDB macros: the same rule as functions.text.compress.
_CUT = "CASE " + " ".join(f"WHEN strpos(reverse(h), reverse({e})) > 0 AND length(h) - strpos(reverse(h), reverse({e})) - 1 > length(h) // 2 THEN substr(h, 1, (length(h) - strpos(reverse(h), reverse({e})))::INT)" for e in _END) + " ELSE h END || ' [...truncated]'"


def _short(text: str, budget: str) -> str:
    head = f"substr({text}, 1, greatest(0, ({budget}) * 4 - 15)::INT)"
    return f"CASE WHEN {text} IS NULL OR {text} = '' OR greatest(1, length({text}) // 4) <= ({budget}) THEN {text} ELSE ({_CUT.replace('(h)', f'({head})').replace('(h,', f'({head},').replace('ELSE h ', f'ELSE {head} ')}) END"


def _oracle(total: int) -> str:
    share, available = {k: int(total * v) for k, v in SHARES.items()}, int(total * (1 - RESERVE))
    tok = lambda c: f"greatest(1, length({c}) // 4)"
    words = r"list_filter(string_split_regex(strip_accents(lower({})), '[^\pL\pN]+'), lambda x: x <> '')"
    part = lambda title, c: f"CASE WHEN coalesce({c}, '') <> '' THEN '--- ' || {title} || ' ---' || chr(10) || {c} END"
    return rf"""WITH RECURSIVE {ad.TALK}, {ad.TRACES}, p AS (SELECT DISTINCT person, regexp_extract(person, '(\d+)', 1)::BIGINT AS n FROM talk),
wk AS (SELECT person, 'Currently in working memory:' || chr(10) || string_agg('- ' || item, chr(10) ORDER BY k) AS workspace FROM (SELECT person, substr(content, 1, 24) AS item, row_number() OVER (PARTITION BY person ORDER BY ord * 37 % 100 DESC, ord, substr(content, 1, 24)) AS k FROM talk WHERE speaker IS DISTINCT FROM 'self') WHERE k <= {ITEMS} GROUP BY person),
r0 AS (SELECT person, n, n % 5 <= 3 AS kept, CASE WHEN n % 4 = 0 THEN 'Name the thing. ' END AS correction, repeat('I keep what matters. ', n % 60) AS identity, 'Known as ' || person || '. ' || repeat('Met before. ', n % 90) AS relationship, concat_ws(chr(10) || chr(10), CASE WHEN n % 5 <> 0 AND n % 70 > 0 THEN repeat('Be kind! ', n % 70) END, CASE WHEN n % 5 <= 2 THEN workspace END) AS grounding FROM p LEFT JOIN wk USING (person)),
r1 AS (SELECT *, CASE WHEN coalesce(correction, '') <> '' THEN {tok('correction')} ELSE 0 END AS u0, {_short('identity', str(share['identity']))} AS i1 FROM r0),
r2 AS (SELECT *, CASE WHEN coalesce(identity, '') = '' THEN NULL WHEN {tok('i1')} <= {available} - u0 THEN i1 WHEN {available} - u0 > {FORCE} THEN {_short('identity', f'{available} - u0')} END AS i2 FROM r1),
r3 AS (SELECT *, u0 + CASE WHEN i2 IS NULL THEN 0 ELSE {tok('i2')} END AS u1, {_short('relationship', str(share['relationship']))} AS e1 FROM r2),
r4 AS (SELECT *, CASE WHEN {tok('e1')} <= {available} - u1 THEN e1 END AS e2 FROM r3),
r5 AS (SELECT *, u1 + CASE WHEN e2 IS NULL THEN 0 ELSE {tok('e2')} END AS u2 FROM r4), r6 AS (SELECT *, {_short('grounding', f"least({share['grounding']}, {available} - u2)")} AS g1 FROM r5),
r7 AS (SELECT *, CASE WHEN coalesce(grounding, '') <> '' AND {available} - u2 > 0 AND {tok('g1')} <= {available} - u2 THEN g1 END AS g2 FROM r6), r8 AS (SELECT *, u2 + CASE WHEN g2 IS NULL THEN 0 ELSE {tok('g2')} END AS u3 FROM r7),
m AS (SELECT t.*, sum({tok('content')} + 4) OVER (PARTITION BY person ORDER BY ord DESC, content DESC ROWS UNBOUNDED PRECEDING) AS used, least({share['recent']}, {available} - u3) AS b FROM talk t JOIN r8 USING (person) WHERE kept QUALIFY row_number() OVER (PARTITION BY person ORDER BY ord DESC, content DESC) <= {RECENT}),
mm AS (SELECT person, string_agg('[' || coalesce(speaker, '?') || ']: ' || coalesce(content, ''), chr(10) ORDER BY ord, content) AS recent, count(*) AS n_recent FROM m WHERE b > 0 AND used <= b GROUP BY person),
r9 AS (SELECT r8.*, recent, coalesce(n_recent, 0) AS n_recent, u3 + CASE WHEN recent IS NULL THEN 0 ELSE {tok('recent')} END AS u4 FROM r8 LEFT JOIN mm USING (person)),
sal AS (SELECT person, id, kind, content, salience FROM r0 JOIN (SELECT * FROM traces ORDER BY salience DESC, id LIMIT 3 * {SALIENT}) t ON person = concat('c', id % 97) WHERE kept QUALIFY row_number() OVER (PARTITION BY person ORDER BY salience DESC, id) <= {SALIENT}),
ask AS (SELECT person, arg_max(content, (ord, content)) AS content FROM talk WHERE speaker IS DISTINCT FROM 'self' GROUP BY person),
asked AS (SELECT person, list_sort(list_distinct({words.format('content')})) AS w FROM ask JOIN r0 USING (person) WHERE kept AND len(string_split_regex(trim(content), '\s+')) >= {WORDS}), want AS (SELECT person, unnest(w) AS term, len(w) AS need FROM asked WHERE len(w) > 0),
dt AS (SELECT id, {words.format('content')} AS w FROM traces), du AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM dt), tf AS (SELECT id, dl, term, count(*) AS tf FROM du GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), c AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM dt),
hit AS (SELECT person, id, sum(greatest(1e-6, ln((n - df + .5) / (df + .5))) * tf * 2.2 / (tf + 1.2 * (1 - .75 + .75 * dl / avgdl))) AS score FROM want JOIN tf USING (term) JOIN df USING (term), c GROUP BY person, id, need HAVING count(*) = need),
best AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY score DESC, id) AS k FROM hit), own AS (SELECT person, id, 1 - ((1 - score / max(score) OVER (PARTITION BY person)) * .5 + .25) AS salience FROM best WHERE k <= {HITS}),
ch AS (SELECT person, id, kind, content, salience::DOUBLE AS salience, least({share['episodic']}, {available} - u4) AS b FROM r9 JOIN sal USING (person) UNION ALL SELECT person, id, 'traces', content, own.salience, least({share['episodic']}, {available} - u4) FROM own JOIN traces USING (id) JOIN r9 USING (person) WHERE (person, id) NOT IN (SELECT (person, id) FROM sal)),
o AS (SELECT *, {tok('content')} AS t, row_number() OVER (PARTITION BY person ORDER BY salience / {tok('content')} DESC, id) AS k FROM ch WHERE b > 0 AND {tok('content')} <= b),
f(person, k, id, nth, used, took) AS (SELECT DISTINCT person, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, FALSE FROM o UNION ALL
  SELECT o.person, o.k, o.id, nth + (f.used + o.t <= o.b)::INT, CASE WHEN f.used + o.t <= o.b THEN f.used + o.t ELSE f.used END, f.used + o.t <= o.b FROM f JOIN o ON o.person = f.person AND o.k = f.k + 1),
ep AS (SELECT f.person, string_agg(format('[{{}}] [{{}} | sal:{{:.2f}}] {{}} {{{{trace:{{}}}}}}', nth, kind, salience, content, f.id), chr(10) ORDER BY nth) || chr(10) || {HINT.strip()!r} AS episodic, count(*) AS n_traces, max(used) AS took FROM f JOIN o ON o.person = f.person AND o.id = f.id WHERE f.took GROUP BY f.person),
ra AS (SELECT r9.*, episodic, coalesce(n_traces, 0) AS n_traces, u4 + coalesce(took, 0) AS u5 FROM r9 LEFT JOIN ep USING (person)),
sd AS (SELECT item_id AS ord, concat('skill-', item_id) AS name, text, list_filter(regexp_extract_all(lower(array_to_string(string_split(text, ' ')[1:3], ' ')), '[a-z0-9]+'), lambda w: w NOT IN ({SUMMARY}) AND length(w) >= 4) AS k FROM benchmark),
sk AS (SELECT person, ord, 'Skill ' || name || ': ' || text AS content, least({share['procedural']}, {available} - u5) AS b FROM ra JOIN ask USING (person) JOIN sd ON contains(lower(ask.content), name) OR len(list_filter(k, lambda w: contains(lower(ask.content), w))) > 0),
s1 AS (SELECT *, coalesce(sum({tok('content')}) OVER (PARTITION BY person ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sk WHERE b > 0),
s2 AS (SELECT person, ord, CASE WHEN before + {tok('content')} <= b THEN content ELSE {_short('content', 'b - before')} END AS content FROM s1 WHERE before <= b AND (before + {tok('content')} <= b OR b - before > 20)),
s3 AS (SELECT person, string_agg(content, chr(10) || '---' || chr(10) ORDER BY ord) AS skills, count(*) AS n_skills FROM s2 GROUP BY person),
z AS (SELECT person, n_recent + n_traces + coalesce(n_skills, 0) AS loaded, concat_ws(chr(10) || chr(10), {part("'CORRECTION'", 'correction')}, {part("'IDENTITY'", 'i2')}, {part("'RELATIONSHIP: ' || person", 'e2')}, {part("'GROUNDING'", 'g2')},
  {part("'RECENT CONVERSATION'", 'recent')}, {part("'RELEVANT MEMORIES'", 'episodic')}, {part("'RELEVANT SKILLS'", 'skills')}) AS x FROM ra LEFT JOIN s3 USING (person))
SELECT person, md5(x) AS context_md5, {tok('x')}::BIGINT AS tokens_used, loaded::BIGINT AS memories_loaded FROM z"""


def context_assembly(s: SparkSession, d: str) -> DataFrame:
    return _context(s, d, 6000)


def context_small(s: SparkSession, d: str) -> DataFrame:
    """With a budget in which sections are cut, shrunk and dropped."""
    return _context(s, d, 700)


def context_tiny(s: SparkSession, d: str) -> DataFrame:
    """With a budget for little more than an identity."""
    return _context(s, d, 90)


QUERIES = {"context_assembly": context_assembly, "context_small": context_small, "context_tiny": context_tiny}
ORACLES = {"context_assembly": _oracle(6000), "context_small": _oracle(700), "context_tiny": _oracle(90)}
