"""Read models: what a session starts from, and texts made of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import clamp, ladder
from lorekeep.operators import scan
from lorekeep.operators.fold import ordered_fold
from lorekeep.operators.temporal import confidence_report


def recent_by_day(events: DataFrame, n: int = 2) -> DataFrame:
    """Of the last n days that have events, the last n events of each; of these the first n, newest day first."""
    rows = events.withColumn("day", F.to_date("ts"))
    days = rows.select("day").distinct().orderBy(F.desc("day")).limit(n)
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("ts"), F.desc("id")))
    top = rows.join(F.broadcast(days), "day").withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
    return top.orderBy(F.desc("day"), F.desc("ts"), F.desc("id")).limit(n)


def deepest_first(thoughts: DataFrame, n: int = 1) -> DataFrame:
    """The first n thoughts, deep ones before others, then the newest."""
    return thoughts.orderBy(F.desc(F.coalesce(F.col("depth") == "deep", F.lit(False))), F.desc("ts"), F.desc("id")).limit(n)


def priming(realizations: DataFrame, emotional: DataFrame, thoughts: DataFrame, fallback: DataFrame) -> DataFrame:
    """One row: the sections' lines (ord, line) joined in the order of sections, and how many memories they name.

    The fallback's lines are used only where all others are empty. The parts are a few rows each, chosen before.
    """
    parts = [p.select(F.lit(i).alias("section"), "ord", "line") for i, p in enumerate((realizations, emotional, thoughts))]
    main = parts[0].unionByName(parts[1]).unionByName(parts[2])
    spare = fallback.select(F.lit(3).alias("section"), "ord", "line").join(main.select(F.lit(3).alias("section")).limit(1), "section", "left_anti")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "ord", "line"))), lambda x: x["line"]), "\n")
    return main.unionByName(spare).agg(text.alias("text"), F.coalesce(F.sum(F.regexp_count("line", F.lit(r"\[MEMORY\]"))), F.lit(0)).alias("memories"))


def memory_line(title: Column, body: Column) -> Column:
    return F.concat(F.lit("[MEMORY] "), title, F.lit(": "), F.substring(body, 1, 200))


def sections_text(rows: DataFrame, section: str = "section", item: str = "item", order: str = "id") -> DataFrame:
    """section and its items as a Markdown list under a heading."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, item))), lambda x: F.concat(F.lit("- "), x[item]))
    out = rows.groupBy(section).agg(F.array_join(lines, "\n").alias("_l"))
    return out.select(section, F.concat(F.lit("## "), section, F.lit("\n"), "_l").alias("body"))


def with_core_person(trust: DataFrame, core: str) -> DataFrame:
    """trust (person, tier) in which core has tier core, whether or not it was there."""
    own = trust.sparkSession.createDataFrame([(core, "core")], "person string, tier string")
    return trust.where(F.lower("person") != core.lower()).select("person", "tier").unionByName(own)


def due_step(interval: dict[str, int]) -> Callable:
    """The step of a check: state the time of the last due one in microseconds; it emits the check's id and whether it is due."""

    def step(last, time, item, level):
        now = True if last is None else None if time is None else time - last >= interval.get(level, 0) * 1_000_000
        return (time if now else last), [(item, now)]

    return step


def due_runs(checks: DataFrame, interval: dict[str, int], hot_rows: int | None = None) -> DataFrame:
    """Checks (key, ts, id, level) with due: whether the level's interval in seconds has gone by since the last due one.

    Whether a check is due depends on the ones before, so a key's checks are read in order, and only the time of the last
    due one is carried from row to row. The checks of a key with more than hot_rows go through chunks, see _due_in_chunks.
    Checks without a time come first and are due; a level without an interval waits for nothing; repeated rows count each.
    """
    rows = checks.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("id").cast("bigint").alias("id"), "level")
    cold = lambda df: ordered_fold(df, ["key"], ["at", "id", "level"], ["at", "id", "level"], lambda: None, due_step(interval), lambda s: (), "id long, due boolean")
    return scan.by_heat(rows, ["key"], cold, lambda df: _due_in_chunks(df, interval), hot_rows)


def _due_in_chunks(rows: DataFrame, interval: dict[str, int]) -> DataFrame:
    """key, id, due of rows (key, at, id, level) of hot keys, whose chunks are read by many tasks twice.

    After a due check at time t, the next is the first with at - wait >= t. So within a chunk, read from its end, each check
    points to the next due one and to the last one of its path. What a chunk makes of the time t that it begins with is a step
    function: the last of the path that starts at the first check with at - wait >= t, which is a new highest one. Its steps,
    fewer than the checks within the longest wait, tell each chunk's first t; then the chunk is read once more from there.
    """
    chunks = scan.without_halo(scan.in_chunks(scan.numbered(rows, ["key"], ["at", "id", "level"])))
    chunks = chunks.withColumn("_since", F.col("at") - waits(interval))

    def collect(held, at, since):
        if at is not None:
            held.append((at, since))
        return held, ()

    def steps(held):
        from bisect import bisect_right

        ahead, ends = [], []  # minus the sinces that none before exceeds, and their paths' ends, the nearest last
        last = None
        for at, since in reversed(held):
            n = bisect_right(ahead, -at)
            last = ends[n - 1] if n else at
            while ahead and -ahead[-1] <= since:
                ahead.pop()
                ends.pop()
            ahead.append(-since)
            ends.append(last)
        if held:
            yield None, last
        for i in range(len(ends) - 1, -1, -1):
            if i == 0 or ends[i - 1] != ends[i]:
                yield -ahead[i], ends[i]

    made = ordered_fold(chunks, [scan.KEY, scan.AT], [scan.NTH], ["at", "_since"], list, collect, steps, "bound long, out long")

    def carry(state, chunk, bound, out):
        own, entry, after, found = state
        begins = []
        if chunk != own:
            own, entry, found = chunk, after, False
            begins = [(chunk, entry)]
        if not found and (entry is None or (bound is not None and bound >= entry)):
            after, found = out, True
        return (own, entry, after, found), begins

    begins = ordered_fold(made, [scan.KEY], [scan.AT, F.asc_nulls_first("bound")], [scan.AT, "bound", "out"], lambda: (None, None, None, False), carry, lambda s: (), f"{scan.AT} long, _entry long")
    step = due_step(interval)

    def follow(state, entry, at, item, level):
        begun, last = state
        last, told = step(last if begun else entry, at, item, level)
        return (True, last), told

    placed = chunks.join(begins, [scan.KEY, scan.AT], "left")
    told = ordered_fold(placed, [scan.KEY, scan.AT], [scan.NTH], ["_entry", "at", "id", "level"], lambda: (False, None), follow, lambda s: (), "id long, due boolean")
    return told.select(F.col(scan.KEY)["key"].alias("key"), "id", "due")


def waits(interval: dict[str, int]) -> Column:
    """The interval of column level in microseconds; 0 for other levels."""
    out = F.lit(0).cast("long")
    for level, seconds in interval.items():
        out = F.when(F.col("level") == level, F.lit(seconds * 1_000_000).cast("long")).otherwise(out)
    return out


def introspections(thoughts: DataFrame, quick: bool = False) -> DataFrame:
    """Rows for the introspection log from thoughts (person, id, ts, thought, context, depth, confidence): depth is surface,
    moderate or deep (else moderate), confidence within 0 and 1; a quick one is a surface thought of routine."""
    depth = F.when(F.lit(quick), "surface").when(F.col("depth").isin("surface", "moderate", "deep"), F.col("depth")).otherwise("moderate")
    context = F.when(F.lit(quick), "routine").otherwise(F.coalesce("context", F.lit("")))
    return thoughts.select("person", "id", "ts", "thought", context.alias("context"), depth.alias("depth"), clamp(F.col("confidence")).alias("confidence"))


def introspection_report(thoughts: DataFrame) -> DataFrame:
    """By person: how many thoughts there are, the last one with its depth, and the report on their confidence."""
    last = F.max_by(F.struct("thought", "depth"), F.struct("ts", "id"))
    state = thoughts.groupBy("person").agg(F.count("*").alias("n"), last.alias("_last")).select("person", "n", "_last.thought", "_last.depth")
    return state.join(confidence_report(thoughts), "person")


def episode_records(exchanges: DataFrame, most: int = 200) -> DataFrame:
    """Rows for the identity log from exchanges (id, ts, user_input, response, state, belief): texts cut to most characters."""
    return exchanges.select("id", "ts", F.substring("user_input", 1, most).alias("user_input"), F.substring("response", 1, most).alias("response"), "state", F.round("belief", 4).alias("belief"))


def soul_fallback(text: Column, sections: tuple[str, ...] = ("Core Identity", "Key Phrases"), lines: int = 3, most: int = 300) -> Column:
    """An array of structs (section, content): of each Markdown section that is there, its first lines that are no headings."""
    out = []
    for name in sections:
        found = F.regexp_extract(text, rf"(?is)(##[^\n]*{name}.*?)(?=##|\z)", 1)
        body = F.filter(F.transform(F.split(found, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
        out.append(F.when(F.size(body) > 0, F.struct(F.lit(name).alias("section"), F.substring(F.array_join(F.slice(body, 1, lines), " "), 1, most).alias("content"))))
    return F.array_compact(F.array(*out))


def one_row(**parts: DataFrame) -> DataFrame:
    """One row with a column for each part: a value where the part has one column, else a struct; each part is one row already."""
    out = None
    for name, df in parts.items():
        cols = [F.col(f"`{c}`") for c in df.columns]
        one = df.agg(F.first(cols[0] if len(cols) == 1 else F.struct(*cols)).alias(name))  # one row also of an empty part
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def as_list(df: DataFrame, order: list[str], *columns: str) -> DataFrame:
    """The rows of df, a few that were chosen before, as one array in the order given."""
    return df.agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in columns]))), lambda x: F.struct(*[x[f"_{c}"].alias(c) for c in columns]) if len(columns) > 1 else x[f"_{columns[0]}"]).alias("rows"))


#: Which section a kind of preference belongs to.
PREFERENCE_SECTIONS = {"like": "likes", "likes": "likes", "dislike": "dislikes", "dislikes": "dislikes", "uncertainty": "uncertainties", "uncertainties": "uncertainties"}


def preference_section(kind: Column) -> Column:
    """The section of a kind of preference, whatever the case; null for others, which a writer rejects."""
    return ladder(*[(F.lower(kind) == k, v) for k, v in PREFERENCE_SECTIONS.items()], otherwise=None)


def fact_line(fact: Column, day: Column) -> Column:
    """A fact as it is written under What I Know."""
    return F.concat(F.lit("- "), fact, F.lit(" ("), F.date_format(day, "yyyy-MM-dd"), F.lit(")"))
