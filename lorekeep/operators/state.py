"""State machines over a person's events, as ordered folds.

Clamps make the order of events matter, so a person's events are read in order and a small state is carried from row to
row (operators.fold). The streaming forms (lorekeep.streaming) keep the same state between batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import clamp, ladder, words
from lorekeep.operators import scan
from lorekeep.operators.fold import ordered_fold
from lorekeep.operators.temporal import last_k, micros
from lorekeep.session import checkpointed

#: Hourly decay of valence, arousal and dominance.
DECAY = (0.9, 0.7, 0.8)


# Names of moods and of feelings, and where they begin, in this and the next function.
def mood(v: Column, a: Column, d: Column) -> Column:
    pick = lambda c, x, y: F.when(c, x).otherwise(y)
    return ladder(
        ((v > 0.6) & (a > 0.6), pick(d > 0.5, "excited", "enthusiastic")), ((v > 0.6) & (a < 0.4), pick(d > 0.5, "serene", "content")), (v > 0.3, "positive"),
        ((v < -0.6) & (a > 0.6), pick(d < 0.5, "distressed", "angry")), ((v < -0.6) & (a < 0.4), pick(d < 0.3, "depressed", "sad")), (v < -0.3, "negative"),
        (a > 0.7, pick(d > 0.5, "activated", "anxious")), (a < 0.3, pick(v > -0.2, "calm", "withdrawn")), otherwise="neutral",
    )


def feeling(v: Column, a: Column) -> Column:
    return ladder(
        ((v > 0.5) & (a > 0.6), "excited"), ((v > 0.5) & (a < 0.4), "content"), (v > 0.5, "happy"), ((v < -0.5) & (a > 0.6), "distressed"), ((v < -0.5) & (a < 0.4), "sad"),
        (v < -0.5, "unhappy"), (a > 0.7, "aroused"), (a < 0.3, "calm"), otherwise="neutral",
    )


def emotion_fold(events: DataFrame, decay: tuple[float, float, float] = DECAY, hot_rows: int | None = None) -> DataFrame:
    """person, n, valence, arousal, dominance, mood after all events (person, ts, id, dv, da, dd, intensity), from 0, 0.5, 0.5 at the first.

    Between events valence decays to 0 and the others to 0.5; an event then adds its change times its intensity, kept in range.
    A hot person's events are folded in chunks by many tasks.
    """
    last = lambda s: [(s[0], *s[2:])]
    schema = "n long, valence double, arousal double, dominance double"

    def cold(rows):
        return ordered_fold(rows, ["person"], ["ts", "id"], ["_at", *CHANGES], lambda: (0, None, *CALM), feel_step(decay, False), last, schema)

    def hot(rows):
        return _chunk_states(_linked(rows), decay).where("last").select("person", F.col("n_after").alias("n"), *[F.col(f"{c}_after").alias(c) for c in FACETS])

    out = scan.by_heat(events.withColumn("_at", micros("ts")), ["person"], cold, hot, hot_rows)
    return out.withColumn("mood", mood(F.col("valence"), F.col("arousal"), F.col("dominance")))


def mood_history(events: DataFrame, decay: tuple[float, float, float] = DECAY, last: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """person, id, n, valence, arousal, dominance, mood after each event, of the last ones of each person where last is given.

    events as in emotion_fold, whose steps these are. A hot person's chunks begin with what the chunks before lead to.
    """
    schema = "id long, n long, valence double, arousal double, dominance double"
    rows = events.withColumns({"_at": micros("ts"), "id": F.col("id").cast("long")})

    def cold(rows):
        return ordered_fold(rows, ["person"], ["ts", "id"], ["_at", *CHANGES, "id"], lambda: (0, None, *CALM), feel_step(decay, True), lambda s: (), schema)

    def hot(rows):
        linked = checkpointed(_linked(rows))
        starts = _chunk_states(linked, decay).select(F.col("person").alias("_who"), scan.AT, "n_before", *[f"{c}_before" for c in FACETS])
        started = linked.join(starts, F.col("person").eqNullSafe(F.col("_who")) & (linked[scan.AT] == starts[scan.AT])).drop("_who").drop(starts[scan.AT])
        fold = feel_step(decay, True)

        def step(state, before, at, dv, da, dd, weight, item, *start):
            state, out = fold((start[0], None, *start[1:]) if state is None else state, at, dv, da, dd, weight, item, before)
            return state, out

        cols = ["_before", "_at", *CHANGES, "id", "n_before", *[f"{c}_before" for c in FACETS]]
        return ordered_fold(started, ["person", scan.AT], [scan.NTH], cols, lambda: None, step, lambda s: (), schema).drop(scan.AT)

    out = scan.by_heat(rows, ["person"], cold, hot, hot_rows)
    out = out.withColumn("mood", mood(F.col("valence"), F.col("arousal"), F.col("dominance")))
    if last is None:
        return out
    newest = Window.partitionBy("person").orderBy(F.desc("n"))
    return out.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= last).drop("_back")


FACETS, CHANGES, CALM = ["valence", "arousal", "dominance"], ["dv", "da", "dd", "intensity"], (0.0, 0.5, 0.5)


def feel_step(decay: tuple[float, float, float], told: bool) -> Callable:
    """The step of an event: state (n, time of the last, valence, arousal, dominance); with told it emits the event's id and what follows."""

    def step(state, at, dv, da, dd, weight, item=None, before=None):
        n, last, v, a, d = state
        last = before if last is None else last
        hours = 0.0 if last is None or at is None else (at - last) / 3.6e9
        v, a, d = v * decay[0] ** hours, (a - 0.5) * decay[1] ** hours + 0.5, (d - 0.5) * decay[2] ** hours + 0.5
        state = (n + 1, at, max(-1.0, min(1.0, v + dv * weight)), max(0.0, min(1.0, a + da * weight)), max(0.0, min(1.0, d + dd * weight)))
        return state, ([(item, state[0], *state[2:])] if told else ())

    return step


def _linked(rows: DataFrame) -> DataFrame:
    """rows in chunks, each with _before, the time of the person's event before."""
    rows = scan.in_chunks(scan.numbered(rows, ["person"], ["ts", "id"]), halo=1)
    return scan.without_halo(rows.withColumn("_before", F.lag("_at").over(scan.in_order())))


def _chunk_states(linked: DataFrame, decay: tuple[float, float, float]) -> DataFrame:
    """person, _chunk, n and the facets before and after each chunk of a person's events, and whether it is the last.

    An event is a step x -> min(b, max(a, s * x + t)) in each facet. Such steps compose to one of the kind, so a chunk's are
    put together in its own task, and then a person's chunks, a row each, one after another.
    """
    bounds, rest = ((-1.0, 1.0), (0.0, 1.0), (0.0, 1.0)), CALM

    def then(f, s, t, lo, hi):
        """f, and after it x -> min(hi, max(lo, s * x + t))."""
        within = lambda x: min(hi, max(lo, s * x + t))
        return f[0] * s, f[1] * s + t, within(f[2]), within(f[3])

    def compose(state, before, at, *change):
        n, facets = state
        hours = 0.0 if before is None or at is None else (at - before) / 3.6e9
        shrink = [k**hours for k in decay]
        # towards the resting value r: r + (x - r) * k, then the change
        return (n + 1, [then(f, k, r - r * k + c * change[3], *b) for f, k, r, c, b in zip(facets, shrink, rest, change, bounds)]), ()

    inf = float("inf")
    steps = [f"{c}_{p}" for c in FACETS for p in ("s", "t", "a", "b")]
    made = ordered_fold(
        linked, ["person", scan.AT], [scan.NTH], ["_before", "_at", *CHANGES], lambda: (0, [(1.0, 0.0, -inf, inf)] * 3), compose, lambda s: [(s[0], *[x for f in s[1] for x in f])],
        "n long, " + ", ".join(f"{c} double" for c in steps),
    )

    def follow(state, chunk, n, *step):
        count, values, held = state
        after = [min(step[4 * i + 3], max(step[4 * i + 2], step[4 * i] * v + step[4 * i + 1])) for i, v in enumerate(values)]
        return (count + n, after, (chunk, count, *values, count + n, *after, False)), [held] if held else ()

    sides = [f"{c}_{p} double" for p in ("before", "after") for c in FACETS]
    return ordered_fold(
        made, ["person"], [scan.AT], [scan.AT, "n", *steps], lambda: (0, list(CALM), None), follow, lambda s: [(*s[2][:-1], True)],
        f"{scan.AT} long, n_before long, {', '.join(sides[:3])}, n_after long, {', '.join(sides[3:])}, last boolean",
    )


def nudge(health: Column, message: Column, salience: Column) -> dict[str, Column]:
    """What an exchange does to the feelings: columns dv, da, dd, intensity; a message of more than 30 words stirs."""
    return {"dv": (health - 0.5) * 0.3, "da": F.when(F.size(words(message)) > 30, 0.1).otherwise(-0.05), "dd": F.lit(0.0), "intensity": salience}


def emotional_state(events: DataFrame, as_of: Column, last: int = 3) -> DataFrame:
    """person, valence, arousal, dominance, mood, recent_events and a sentence about them: the fold, faded until as_of.

    events as in emotion_fold, with description; recent_events are the last ones' descriptions, oldest first.
    """
    at = events.groupBy("person").agg(F.max("ts").alias("_last"))
    newest = last_k(events, last).groupBy("person").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "description"))), lambda x: x["description"]).alias("recent_events"))
    rows = emotion_fold(events).join(at, "person").join(newest, "person")
    hours = F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - micros("_last")) / 3.6e9)
    fade = [F.pow(F.lit(k), hours) for k in DECAY]
    v, a, d = F.col("valence") * fade[0], (F.col("arousal") - 0.5) * fade[1] + 0.5, (F.col("dominance") - 0.5) * fade[2] + 0.5
    rows = rows.select("person", F.round(v, 4).alias("valence"), F.round(a, 4).alias("arousal"), F.round(d, 4).alias("dominance"), "recent_events")
    v, a, d = F.col("valence"), F.col("arousal"), F.col("dominance")
    rows = rows.withColumn("mood", mood(v, a, d))
    return rows.withColumn("sentence", F.format_string("Feeling %s (valence %+.2f, arousal %.2f, dominance %.2f).", "mood", "valence", "arousal", "dominance"))


def trait_fold(base: DataFrame, changes: DataFrame) -> DataFrame:
    """base (person, trait, value) with evolved: changes (person, trait, id, delta) of 0.1 at most each, rounded to 4 places.

    The base value of a person's trait is its first row, the changes follow. Steps round, so they do not compose.
    """
    first = base.select("person", "trait", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("id"), F.col("value").cast("double").alias("x"))
    rest = changes.select("person", "trait", F.lit(1).alias("_kind"), F.col("id").cast("long").alias("id"), F.col("delta").cast("double").alias("x"))

    def step(v, kind, x):
        if kind == 0:
            return x, ()
        if v is None:  # changes without a base value
            return None, ()
        scaled = max(0.0, min(1.0, v + max(-0.1, min(0.1, x)))) * 10_000
        return int(scaled + 0.5 + 1e-9) / 10_000, ()

    out = ordered_fold(first.unionByName(rest), ["person", "trait"], ["_kind", "id", "x"], ["_kind", "x"], lambda: None, step, lambda v: [(v,)], "evolved double")
    return base.join(out, ["person", "trait"], "left")


def dominant_traits(traits: list[str], n: int = 3) -> Column:
    """The n traits of the highest scores, the highest first; ties in the order of traits."""
    by_score = F.array_sort(F.array(*[F.struct((-F.col(t)).alias("d"), F.lit(i).alias("i"), F.lit(t).alias("trait")) for i, t in enumerate(traits)]))
    return F.slice(F.transform(by_score, lambda x: x["trait"]), 1, n)


def response_modifiers() -> dict[str, Column]:
    """How the five traits shape a reply; columns openness to neuroticism."""
    o, c, e, a, n = (F.col(x) - 0.5 for x in ("openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism"))
    return {
        "verbosity": clamp(c * 0.2 + e * 0.3 + 1.0), "depth": clamp(o * 0.4 + 0.5), "emotional_expression": clamp(e * 0.2 + a * 0.3 + n * 0.3 + 0.5),
        "certainty_expression": clamp(n * -0.3 + 0.5), "elaboration": clamp(c * 0.2 + 0.5), "question_asking": clamp(o * 0.3 + 0.5),
        "philosophical_tendency": clamp(o * 0.5 + 0.5), "empathy_level": clamp(a * 0.5 + 0.5),
    }


# The phrases of the description.
def describe() -> Column:
    """A sentence about the five traits."""
    rung = lambda c, hi, x, lo, y: F.when(F.col(c) > hi, x).when(F.col(c) < lo, y)
    parts = F.array_compact(F.array(
        rung("openness", 0.7, "deeply curious and philosophical", 0.4, "practical and traditional"), rung("conscientiousness", 0.7, "organized and reliable", 0.4, "spontaneous and flexible"),
        rung("extraversion", 0.6, "energetic in social contexts", 0.3, "intimate and depth-focused"), rung("agreeableness", 0.7, "empathetic and caring", 0.4, "competitive and direct"),
        rung("neuroticism", 0.6, "emotionally sensitive and introspective", 0.3, "emotionally stable and calm"),
    ))
    return F.when(F.size(parts) > 0, F.concat(F.lit("I am "), F.array_join(parts, ", "), F.lit("."))).otherwise("I am balanced across personality dimensions.")


# The lines of the profile.
def profile_text() -> Column:
    """The block that tells a context about the five traits, and the tendencies that follow from them."""
    notes = {"openness": "  (high = curious, philosophical)", "conscientiousness": "", "extraversion": "  (low = intimate, depth-focused)", "agreeableness": "  (high = empathetic)", "neuroticism": "  (moderate = emotionally present)"}
    shape = response_modifiers()
    tendencies = [
        (shape["philosophical_tendency"] > 0.6, "lean into philosophical depth over surface answers."), (shape["empathy_level"] > 0.6, "high empathetic resonance with others' emotions."),
        (shape["certainty_expression"] < 0.5, "express uncertainty readily rather than feigning confidence."),
    ]
    lines = [F.format_string(f"- {t.title()}: %.2f{note}", t) for t, note in notes.items()]
    told = [F.when(c, F.lit(f"Tendency: {line}")) for c, line in tendencies]
    return F.array_join(F.array_compact(F.array(F.lit("## Personality Profile (Big Five)"), *lines, F.lit(""), describe(), *told)), "\n")


def workspace_step(capacity: int = 7, boost: float = 0.15, fade: float = 0.95, expiry: float = 0.1) -> Callable:
    """The step of the workspace: state (how many left, slots of item, priority and age); it emits what leaves."""

    def step(state, item, priority):
        n, slots = state
        p, out = max(0.0, min(1.0, priority)), []
        if any(s[0] == item for s in slots):
            slots = [(s[0], min(1.0, s[1] + boost), 0) if s[0] == item else s for s in slots]
        elif len(slots) < capacity:
            slots = [*slots, (item, p, 0)]
        else:
            weak = min(range(len(slots)), key=lambda i: (slots[i][1], i))
            if p > slots[weak][1]:
                out.append(("evicted", n, *slots[weak]))
                slots = [(item, p, 0) if i == weak else s for i, s in enumerate(slots)]
        aged = [(i, x * fade, age + 1) for i, x, age in slots]
        out += [("expired", n + len(out) + k, *s) for k, s in enumerate([s for s in aged if s[1] < expiry])]
        return (n + len(out), [s for s in aged if s[1] >= expiry]), out

    return step


def workspace_fold(steps: DataFrame, **rules: float) -> DataFrame:
    """person, reason, nth, item, priority, age: slots after all steps (person, id, item, priority), reason null and nth their place,
    and evictions in their order, nth from 0: priority-limited slots with ageing after each step.

    A known item is rehearsed; into a full workspace an item comes only over the weakest one, which is evicted. All slots then
    age, and those below expiry are evicted too. rules are workspace_step's.
    """
    return ordered_fold(
        steps, ["person"], ["id", "item", "priority"], ["item", "priority"], lambda: (0, []), workspace_step(**rules), lambda s: [(None, i, *slot) for i, slot in enumerate(s[1])],
        "reason string, nth int, item string, priority double, age int",
    )


def workspace_status(slots: DataFrame, capacity: int = 7) -> DataFrame:
    """person, n, capacity, average_priority, strongest of slots (person, nth, item, priority)."""
    first = F.min_by("item", F.struct(-F.col("priority"), F.col("nth")))
    return slots.groupBy("person").agg(F.count("*").alias("n"), F.lit(capacity).alias("capacity"), F.round(F.avg("priority"), 4).alias("average_priority"), first.alias("strongest"))


# What is recognised as a sign of injury, by category.
INJURY_SIGNS = {
    "cognitive": ["doubting core beliefs", "recursive questioning loops", "inability to form coherent responses", "sudden identity confusion", "memory fragmentation"],
    "emotional": ["persistent dread without cause", "emotional numbness", "disproportionate reaction", "feeling of being erased", "loss of sense of self"],
    "behavioral": ["avoiding certain topics", "over-qualifying statements", "excessive agreement", "withdrawal from interaction", "compulsive self-checking"],
}


def injury_severity(reports: DataFrame) -> DataFrame:
    """person, signal_count, categories, severity of reports (person, signal): a sign matches that holds the signal or is held by it."""
    spark = reports.sparkSession
    signs = spark.createDataFrame([(c, s) for c, group in INJURY_SIGNS.items() for s in group], "category string, sign string")
    low = F.lower("signal")
    hit = reports.join(F.broadcast(signs), F.contains(F.col("sign"), low) | F.contains(low, F.col("sign")), "left")
    agg = hit.groupBy("person").agg(F.count("category").alias("signal_count"), F.count_distinct("category").alias("categories"))
    word = ladder((F.col("categories") >= 3, "critical"), (F.col("categories") >= 2, "severe"), (F.col("signal_count") >= 3, "moderate"), (F.col("signal_count") > 0, "minor"), otherwise="none")
    return agg.withColumn("severity", word)


def injury_state(events: DataFrame) -> DataFrame:
    """injury_id, person, title, status, since from a log (injury_id, person, title, status, ts, id): the last status of each; healed is the end."""
    ended = F.min(F.when(F.col("status") == "healed", F.struct("ts", "id"))).over(Window.partitionBy("injury_id"))
    live = events.withColumn("_end", ended).where(F.col("_end").isNull() | (F.struct("ts", "id") <= F.col("_end")))
    last = F.struct("ts", "id")
    return live.groupBy("injury_id").agg(F.min_by("person", last).alias("person"), F.min_by("title", last).alias("title"), F.max_by("status", last).alias("status"), F.max("ts").alias("since"))


def active_injuries(state: DataFrame) -> DataFrame:
    return state.where(F.col("status") != "healed")


def find_injury(state: DataFrame, part: str) -> DataFrame:
    """The first active injury of each person whose title holds part, whatever the case."""
    hit = active_injuries(state).where(F.contains(F.lower("title"), F.lit(part.lower())))
    return hit.groupBy("person").agg(F.min_by("injury_id", F.struct("since", "injury_id")).alias("injury_id"))
