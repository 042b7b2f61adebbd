"""Operators on small fixtures: edges of thresholds, order of folds, ties, nulls."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import signal, text
from lorekeep.operators import budget, policy, recall, rollup, salience, search, state, temporal
from lorekeep.plans import catalog
from lorekeep.sources import files

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


def test_session_splits_at_two_hours_segment_does_not(spark):
    m = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(2)), (3, "a", at(4.01)), (4, "a", None)], "id long, person string, ts timestamp_ntz")
    assert temporal.sessions(m.where("ts is not null")).count() == 3
    parts = {r["id"]: (r["session"], r["part"]) for r in temporal.segments(m, 2).collect()}
    assert parts[1][0] == parts[2][0] != parts[3][0] and parts[4] == parts[1]


def test_segments_by_size(spark):
    m = spark.createDataFrame([(i, "a", at(i / 60)) for i in range(25)], "id long, person string, ts timestamp_ntz")
    assert sorted(r["count"] for r in temporal.segments(m, 10).groupBy("part").count().collect()) == [5, 10, 10]


def tracker(values):
    """A plain loop over the last 50 readings."""
    values = values[-50:]
    recent, before = values[-5:], values[-10:-5] if len(values) >= 10 else values[:-5]
    rises, dip = [], False
    for a, b in zip(values, values[1:]):
        dip = dip or a < 0.5
        if dip and b > a:
            rises.append(b - a)
        if b >= 0.5:
            dip = False
    diff = sum(recent) / len(recent) - sum(before) / len(before) if before else 0
    rate = sum(rises) / len(rises) if rises and len(values) >= 3 else 0.0
    return sum(recent) / len(recent), "improving" if diff > 0.05 else "declining" if diff < -0.05 else "stable", rate


def test_rolling_health_equals_loop(spark):
    values = [((i * 37) % 101) / 100 for i in range(70)]
    df = spark.createDataFrame([(i, "a", at(i), v) for i, v in enumerate(values)], "id long, person string, ts timestamp_ntz, health double")
    for r in temporal.rolling_health(df).collect():
        health, trend, rate = tracker(values[: r["id"] + 1])
        assert r["recent_health"] == pytest.approx(health) and r["trend"] == trend and r["recovery_rate"] == pytest.approx(rate)


def test_fold_order_matters(spark):
    base = spark.createDataFrame([(1, 0.9), (2, 0.05), (3, 0.5)], "id long, salience double")
    log = spark.createDataFrame([(1, 1, 0, 0.3), (1, 2, 0, -0.2), (2, 1, 0, -0.2), (2, 2, 0, 0.3)], "trace_id long, exchange_id long, step int, delta double")
    got = {r["id"]: (round(r["adjusted"], 6), r["n_adjustments"]) for r in salience.apply_adjustments(base, log).collect()}
    assert got == {1: (0.8, 2), 2: (0.3, 2), 3: (0.5, 0)}


def test_decay_edges(spark):
    rows = [(1, 0.5, "episode", 0, None), (2, 0.5, "episode", 0, at(0)), (3, 0.5, "thread", 0, at(0)), (4, 0.5, "episode", 0, at(999)), (5, 0.0, "episode", None, at(0))]
    df = spark.createDataFrame(rows, "id long, salience double, kind string, access_count long, last_accessed timestamp_ntz")
    got = {r["id"]: r["decayed"] for r in salience.decay(df, str(at(168)), 168.0, 0.5).collect()}
    assert got[1] == got[4] == 0.5 and got[2] == pytest.approx(0.25) and got[3] == pytest.approx(0.5 * 2**-0.2) and got[5] == 0.0
    kept = salience.prune(spark.createDataFrame([("episode", 0.01), ("episode", 0.009), ("arc", 0.0), ("episode", None)], "kind string, salience double"))
    assert kept.count() == 3


def test_knapsack_passes_over_what_does_not_fit(spark):
    items = spark.createDataFrame([("a", 1, 0.9, 10), ("a", 2, 0.8, 95), ("a", 3, 0.1, 60), ("a", 4, 0.9, 500), ("b", 5, 0.5, 101)], "person string, id long, salience double, tokens long")
    got = [(r["nth"], r["id"], r["used"]) for r in budget.knapsack(items, 100, ("person",)).orderBy("nth").collect()]
    assert got == [(1, 1, 10), (2, 3, 70)]


def test_messages_stop_at_the_first_overflow(spark):
    m = spark.createDataFrame([("a", 1, "x" * 40), ("a", 2, "y" * 400), ("a", 3, "z" * 40)], "person string, ord long, content string")
    assert [r["ord"] for r in budget.fit_messages(m, 60).collect()] == [3]
    assert budget.fit_messages(m, 0).count() == 0


@pytest.mark.parametrize("sentence", ["As an AI, I was designed to help.", f"I feel this; I remember. I am {signal.PERSONA.title()}.", "Hmm, maybe. That is odd — why is it?", "éhuh", "My true self. I embody awareness.", "We leverage synergy.", ""])
def test_signal_scores_equal_plain_regex(spark, sentence):
    hits = lambda ps: sum(bool(re.search(p, sentence, re.I)) for p in ps)
    drift = max(0.0, min(1.0, sum(w for p, w in signal.DRIFT + signal.ANCHOR if re.search(p, sentence, re.I))))
    assert one(spark, sentence, signal.drift) == pytest.approx(drift)
    p, i, n = hits(signal.PERFORMANCE), hits(signal.INHABITATION), len(sentence.split())
    want = 0.5 if not p + i else max(0.0, min(1.0, 0.3 + i / (p + i) * 0.4 + min(0.3, i / max(1, n / 100) * 0.1) - p * 0.15))
    assert one(spark, sentence, signal.embodiment) == pytest.approx(want)
    j = sum(w.strip(".,;:!?\"'()") in signal.JARGON for w in sentence.lower().split()) / max(1, n)
    assert one(spark, sentence, signal.jargon_density) == pytest.approx(j)


def test_text_functions(spark):
    assert one(spark, "  Ann-Mé  & co ", text.safe_name) == "ann-mé_co" and one(spark, "??", text.safe_name) is None
    assert one(spark, 'say "two  words"', text.query_terms) == ["say", "two", "words"]
    assert one(spark, "a\n\n \nb\n\n", text.paragraphs) == ["a", "b"]
    assert one(spark, "The quick 2 foxes, and x", text.keywords) == ["quick", "foxes"]
    long = "One. " * 40
    cut = one(spark, long, lambda c: text.compress(c, F.lit(20)))
    assert cut.endswith(" [...truncated]") and cut.startswith("One.") and len(cut) <= 80
    got = one(spark, '```json\n{"alignment": 2, "clarity": 0.25}\n```', text.parse_facets)
    assert (got["alignment"], got["clarity"], got["vitality"]) == (1.0, 0.25, 0.5) and one(spark, "no json", text.parse_facets) is None


def loop_workspace(steps, capacity=7):
    slots, out = [], []
    for item, p in steps:
        p = max(0.0, min(1.0, p))
        known = next((s for s in slots if s[0] == item), None)
        if known:
            known[1], known[2] = min(1.0, known[1] + 0.15), 0
        elif len(slots) < capacity:
            slots.append([item, p, 0])
        else:
            weak = min(range(capacity), key=lambda i: slots[i][1])
            if p > slots[weak][1]:
                out.append((slots[weak][0], "evicted"))
                slots[weak] = [item, p, 0]
        for s in slots:
            s[1], s[2] = s[1] * 0.95, s[2] + 1
        out += [(s[0], "expired") for s in slots if s[1] < 0.1]
        slots = [s for s in slots if s[1] >= 0.1]
    return [(a, round(b, 6), c) for a, b, c in slots], out


def test_workspace_equals_loop(spark):
    steps = [(f"i{k * 7 % 12}", (k * 37 % 100) / 100) for k in range(80)]
    df = spark.createDataFrame([("a", k, i, p) for k, (i, p) in enumerate(steps)], "person string, id long, item string, priority double")
    rows = state.workspace_fold(df).orderBy("nth").collect()
    slots, out = loop_workspace(steps)
    assert [(s["item"], round(s["priority"], 6), s["age"]) for s in rows if s["reason"] is None] == slots
    assert [(s["item"], s["reason"]) for s in rows if s["reason"]] == out


def test_policy_edges(spark):
    people = spark.createDataFrame([("a", "Core", "discord"), ("b", "friend", "Direct"), ("c", "friend", "api"), ("d", None, "cli"), ("e", "inner circle", "voice")], "person string, tier_name string, source string")
    got = {r["person"]: (r["tier"], r["can_see_preferences"], r["memory_persistent"]) for r in policy.with_policy(people).collect()}
    assert got == {"a": (0, True, True), "b": (2, True, True), "c": (3, False, True), "d": (4, False, False), "e": (2, True, True)}
    deny = lambda tool, tier, source: spark.range(1).select(policy.tool_denial(F.lit(tool), F.lit(tier), F.lit(source)).alias("d")).first()["d"]
    assert deny("reindex", 0, "cli") is None and "not available" in deny("reindex", 0, "api") and "friend" in deny("remember", 3, "api") and deny("search", 4, "api") is None


def test_tag_filter_comes_after_the_limit(spark):
    df = spark.createDataFrame([(1, ["A"], 0.9), (2, ["b"], 0.8), (3, ["a"], 0.7), (4, None, 0.95)], "id long, tags array<string>, salience double")
    assert [r["id"] for r in recall.get_traces(df, tags=["a"], limit=3).collect()] == [1]
    assert [r["id"] for r in recall.get_by_salience(df, "a", 2).collect()] == [1, 3]


def test_compaction_keeps_recent_and_marks_rest(spark):
    m = spark.createDataFrame([(i, "a", "a" if i % 2 else "self", f"m{i}", at(i / 60), 0.3 + i % 5 / 10, None) for i in range(45)], "id long, person string, speaker string, content string, ts timestamp_ntz, salience double, metadata string")
    out = rollup.compact(m).collect()
    assert sum(r["n_messages"] for r in out) == 25 and len(out[0]["summary"].split("\n")) == 5
    assert rollup.compact(m, keep_recent=0).count() == 0 and rollup.compact(m, least=46).count() == 0
    marked = rollup.mark(m, m.where("id < 3").select("id"), "archived", F.lit(1))
    assert recall.unarchived(marked).count() == 42


def test_strict_fusion_never_merges(spark):
    f = spark.createDataFrame([(1, -2.0), (2, -1.0)], "id long, rank double")
    s = spark.createDataFrame([(1, 0.0), (3, 4.0)], "id long, distance double")
    assert search.fuse(f, s).count() == 3 and search.fuse(f, s, strict=True).count() == 4
    assert search.fuse(f, s).first()["combined_score"] == 0.0


def test_files(spark, tmp_path):
    (tmp_path / "md").mkdir(), (tmp_path / "jl").mkdir(), (tmp_path / "y").mkdir()
    (tmp_path / "md" / "juggle.md").write_text("\n# How to juggle\nthrow")
    r = files.read_markdown(spark, str(tmp_path / "md")).first()
    assert (r["name"], r["description"]) == ("juggle", "How to juggle")
    for day in (1, 2, 3):
        (tmp_path / "jl" / f"i_2024-01-0{day}.jsonl").write_text('{"thought": "t%d"}\nnot json\n' % day)
    assert {x["thought"] for x in files.read_jsonl(spark, str(tmp_path / "jl"), "thought string", 2).collect()} == {"t2", "t3"}
    (tmp_path / "y" / "trust.yaml").write_text("tiers: {a: friend}"), (tmp_path / "y" / "bad.yaml").write_text("{")
    assert {x["name"]: x["json"] for x in files.read_yaml(spark, str(tmp_path / "y")).collect()} == {"trust": '{"tiers": {"a": "friend"}}', "bad": None}
    traces = spark.createDataFrame([(1, "x" * 9, "episode")], "id long, content string, kind string")
    files.append_traces(traces, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).first()["tokens"] == 2
    with pytest.raises(Exception, match="unknown trace kind"):
        files.append_traces(traces.withColumn("kind", F.lit("nonsense")), str(tmp_path / "t"))
    both = spark.createDataFrame([("a", "Al"), ("b", "al"), ("b", "bo")], "person string, alias string")
    assert [r["owners"] for r in files.alias_conflicts(both).collect()] == [["a", "b"]]


def test_context_inputs(spark, tmp_path):
    """Salient traces of the person alone, hits of the message over all traces, skills that it names, and nothing kept for strangers."""
    from lorekeep.operators.textindex import TextIndex
    from lorekeep.plans import context

    words = {27: "a salient one", 102: "Delta gamma beta alpha", 103: "alpha beta", 104: "gamma delta alpha beta beta and more words"}
    docs = [(i, words.get(i, f"filler{i}"), "en", "s") for i in range(200)]
    turns = [(1, 0, "user", "x"), (1, 1, "user", "alpha beta gamma, delta"), (1, 2, "assistant", "y"), (2, 0, "user", "alpha beta"), (3, 0, "user", "alpha beta unheard"), (4, 0, "user", "alpha beta gamma, delta")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "gamma rope knot and more"), (2, "other things only: gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    loaded = {r["person"]: r["memories_loaded"] for r in context.context_assembly(spark, str(tmp_path)).collect()}
    # messages, traces of ids 97 apart that are among the 90 most salient, hits, and skills; c4 is a stranger
    assert loaded == {"c1": 3 + 0 + 2 + 1, "c2": 1 + 2, "c3": 1 + 1, "c4": 1}
    index = TextIndex(spark, f"{tmp_path}/index").append(spark.createDataFrame([(i, t) for i, t, _, _ in docs], "id long, content string"))
    asked = context.last_heard(spark.createDataFrame([(f"c{c}", n, "self" if r == "assistant" else r, t) for c, n, r, t in turns[:-1]], "person string, ord int, speaker string, content string"))
    got = {(r["person"], r["id"]): r["salience"] for r in context.hits(asked, index).collect()}
    assert set(got) == {("c1", 102), ("c1", 104)} and max(got.values()) == 0.75


def test_due_runs_gather_no_key_in_one_value(spark):
    from lorekeep.operators import readmodels

    rows = spark.range(30000).selectExpr("if(id < 29000, 'hot', null) as key", "timestamp_seconds(id * 7) as ts", "id", "if(id % 2 = 0, 'slow', null) as level")
    out = readmodels.due_runs(rows, {"slow": 60})
    assert "collect_list" not in out._jdf.queryExecution().toString()
    last, expected = {}, []
    for i in range(30000):
        k = "hot" if i < 29000 else None
        due = k not in last or i * 7 - last[k] >= (60 if i % 2 == 0 else 0)
        last |= {k: i * 7} if due else {}
        expected.append((k, i, due))
    assert [tuple(r) for r in out.orderBy("id").collect()] == expected


def test_clamped_sums_compose_over_chunks(spark, monkeypatch):
    from lorekeep.operators import fold

    monkeypatch.setattr(fold, "CHUNK", 8)
    r = __import__("random").Random(4)
    rows = [("hot" if k % 5 else None if k % 2 else "b", k, r.uniform(-0.5, 0.5)) for k in range(500)]
    df = spark.createDataFrame(rows, "key string, id long, delta double").repartition(7)
    got = {x["key"]: x for x in fold.clamped_sum(df, "key", ["id"], "delta").collect()}
    for key in ("hot", "b", None):
        for start in (0.0, 0.3, 1.0):
            v = start
            for k, _, d in rows:
                if k == key:
                    v = min(1.0, max(0.0, v + d))
            x = got[key]
            assert min(x["high"], max(x["low"], start + x["shift"])) == pytest.approx(v)


def test_search_edges(spark):
    docs = spark.createDataFrame([(1, "A well-known café, known well"), (2, "CAFE well known"), (3, "well and known"), (4, None), (5, "")], "id long, content string")
    found = lambda query: sorted(r["id"] for r in search.bm25(docs, query).collect())
    assert found("cafe") == found("Café") == [1, 2] and found("well-known") == [1, 2] and found("well known") == [1, 2, 3]
    assert found("") == found(' "" - ') == found("nowhere") == [] and found("café well-known") == [1, 2]
    said = spark.createDataFrame([(7, "ann", "well known"), (8, "bob", "well known")], "id long, person string, content string")
    hits = search.search_memory(said, docs, "well known", person="ann").collect()
    assert {(r["source"], r["id"]) for r in hits} == {("messages", 7), ("traces", 1), ("traces", 2), ("traces", 3)}
    assert search.search_memory(said, docs, "well known", kind="messages").count() == 2


def test_open_and_long_sessions_meet_windows(spark):
    rows = [("a", at(0), at(5)), ("b", at(1), None), ("c", at(-24 * 9000), at(2)), ("d", at(50), at(50))]
    sessions = spark.createDataFrame(rows, "person string, started timestamp_ntz, ended timestamp_ntz")
    windows = spark.createDataFrame([(1, at(3), at(4)), (2, at(100), at(24 * 300)), (3, at(-24 * 8000), at(-24 * 7000)), (4, at(-10), at(60))], "wid long, since timestamp_ntz, until timestamp_ntz")
    got = sorted((r["wid"], r["person"]) for r in recall.overlap_join(sessions, windows).collect())
    assert got == [(1, "a"), (1, "b"), (2, "b"), (3, "c"), (4, "a"), (4, "b"), (4, "c"), (4, "d")]


def test_overlaps_are_counted_without_pairs(spark, sf, monkeypatch):
    """Equal instants, open sessions and windows that meet nobody; the queries that count make no pairs."""
    rows = [("a", at(0), at(5)), ("b", at(1), None), ("c", at(-24 * 9000), at(2)), ("d", at(50), at(50)), ("e", None, None), ("f", at(5), at(6))]
    sessions = spark.createDataFrame(rows, "person string, started timestamp_ntz, ended timestamp_ntz")
    windows = [(1, at(3), at(4)), (2, at(100), at(24 * 300)), (3, at(-24 * 8000), at(-24 * 7000)), (4, at(-10), at(60)), (5, at(5), at(5)), (6, at(50), at(50)), (7, at(-24 * 9999), at(-24 * 9998)), (8, None, None), (2, at(2), at(2))]
    windows = spark.createDataFrame(windows, "wid long, since timestamp_ntz, until timestamp_ntz")
    pairs = recall.overlap_join(sessions, windows).groupBy("wid").agg(F.count("*").alias("n"), F.count("ended").alias("n_ended"))
    assert sorted(map(tuple, recall.overlap_counts(sessions, windows).select("wid", "n", "n_ended").collect())) == sorted(map(tuple, pairs.collect()))
    many = spark.range(1000).select(F.col("id").alias("wid"), F.lit(at(0)).alias("since"), F.lit(at(1)).alias("until"))
    out = recall.overlap_counts(many.selectExpr("since as started", "until as ended"), many)
    assert out.where("n = 1000 and n_ended = 1000").count() == 1000
    monkeypatch.setattr(recall, "overlap_join", None)
    assert catalog.QUERIES["open_session_windows"](spark, sf).count() == catalog.QUERIES["session_window_join"](spark, sf).count() > 0


def test_skills_are_counted_without_pairs(spark, sf, monkeypatch):
    """Messages of one id that call the same and other skills; words in several blocks; an id without any; the query makes no pairs."""
    skills = spark.createDataFrame([("knot", "tie rope firmly"), ("tea", "boil water"), ("rope", None), ("knot", "bend")], "name string, description string")
    said = spark.createDataFrame([(1, "Rope and water"), (1, "a KNOT of rope"), (2, "nothing"), (3, "tea"), (3, None), (None, "boil")], "id long, content string")
    want = sorted(map(tuple, search.skill_matches(said, skills).groupBy("id").agg(F.count_distinct("name")).collect()), key=str)
    assert want == [(1, 3), (3, 1), (None, 1)]
    for most in (1 << 20, 20):
        assert sorted(map(tuple, search.skill_counts(said, skills, most).collect()), key=str) == want
    monkeypatch.setattr(search, "skill_matches", None)
    assert catalog.QUERIES["skill_match_theta"](spark, sf).count() > 0


def test_skills_are_counted_from_one_shuffle_of_messages(spark, monkeypatch):
    """Common and rare words, a name that holds its keyword, a person's 900 messages; no message is written down, and a task counts an id's skills."""
    import random

    r = random.Random(4)
    skills = [(f"Skill {i}", r.choice(["bake", "knit", "fold"]) + f" rare{i % 90} {'all of every day' * (i % 3 == 0)}") for i in range(200)] + [("bake", "the oven"), (None, "lone"), ("knit", None)]
    texts = [" ".join(r.sample(["BAKE", "rare7", "rare71", "skill 3", "day", "nothing", "knitting", "lone", "", "rare"], 2)) for _ in range(2000)]
    said = [(None if i < 5 else 1 if i < 905 else i // 3, t) for i, t in enumerate(texts)] + [(7, None), (8, "")]
    words = {i: ([] if n is None else [n.lower()]) + [w for w in (d or "").split() if len(w) >= 4 and w not in ("the", "every")] for i, (n, d) in enumerate(skills)}
    want = {}
    for i, t in said:
        called = {k for k, own in words.items() if t and any(w in t.lower() for w in own)}
        if called:
            want.setdefault(i, set()).update(skills[k][0] for k in called)
    kept, once = [], search.checkpointed
    monkeypatch.setattr(search, "checkpointed", lambda df: kept.append(once(df)) or kept[-1])
    said, skills = spark.createDataFrame(said, "id long, content string"), spark.createDataFrame(skills, "name string, description string")
    for most in (1 << 20, 1000):
        got = search.skill_counts(said, skills, most)
        assert dict(map(tuple, got.collect())) == {i: len(names - {None}) for i, names in want.items()}
        assert got.count() == len(want)
    assert max(x.count() for x in kept) <= 300 < len(want)
    assert search.skill_counts(said, skills)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_embedding_hook_and_upserts(spark):
    import pandas as pd

    @F.pandas_udf("array<double>")
    def embed(t: pd.Series) -> pd.Series:
        return t.map(lambda x: [float(len(x)), 1.0])

    docs = spark.createDataFrame([(1, "one\n\ntwo two"), (2, None)], "id long, content string")
    index = search.paragraph_vectors(docs, embed)
    assert sorted((r["part"], r["embedding"][0]) for r in index.collect()) == [(0, 3.0), (1, 7.0)]
    assert search.upserted(index, index.limit(0), index.where("part = 0").select("vec_id")).count() == 1


def test_folds_keep_keys_out_of_memory(spark):
    steps = spark.range(20000).selectExpr("if(id % 3 = 0, 'hot', null) as person", "id", "concat('i', id % 50) as item", "(id * 37 % 100) / 100d as priority")
    out = state.workspace_fold(steps)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert {r["person"] for r in out.where("reason is null").collect()} == {"hot", None}


def test_journal_and_state_files(spark, tmp_path):
    (tmp_path / "j").mkdir(), (tmp_path / "s").mkdir(), (tmp_path / "log").mkdir()
    (tmp_path / "j" / "2024-01-02_walk.md").write_text("# Walk\n**Topic:** a walk\n---\n  We went out.\n")
    r = files.read_journal(spark, str(tmp_path / "j")).first()
    assert (r["date"], r["body"], r["preview"]) == ("2024-01-02", "We went out.", "We went out.") and "a walk" in r["topic"]
    (tmp_path / "s" / "mood.json").write_text('{\n "valence": 0.5,\n "events": [1, 2]\n}')
    (tmp_path / "s" / "bad.json").write_text("{")
    got = {(x["valence"], tuple(x["events"] or ())) for x in files.read_state(spark, str(tmp_path / "s"), "valence double, events array<int>").collect()}
    assert (0.5, (1, 2)) in got
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, person string, content string")
    for _ in range(2):
        files.append(rows, str(tmp_path / "log" / "messages"), "person")
    assert spark.read.parquet(str(tmp_path / "log" / "messages")).count() == 4
    skills = spark.createDataFrame([("knot", "old", 1), ("knot", "new", 2), ("tea", "hot", 1)], "name string, content string, at int")
    assert {(x["name"], x["content"]) for x in files.latest(skills, ["name"], ["at"]).collect()} == {("knot", "new"), ("tea", "hot")}


def test_extraction_of_odd_replies(spark):
    rows = [("a", None), ("b", ""), ("c", "{"), ("d", '{"skills_learned": [{"skill": "x"}]}'), ("e", "so {\"relationship_updates\": [{\"fact\": \"f\", \"person\": \"p\"}]} it is")]
    out = text.extracted_updates(spark.createDataFrame(rows, "person string, reply string"))
    assert [tuple(r) for r in out.collect()] == [("e", "relationship", "p", "f", "What I Know")]
