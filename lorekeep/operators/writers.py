"""What the writers of relationships, journals, skills and boundaries leave behind, from logs of writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import safe_name
from lorekeep.operators.fold import ordered_fold
from lorekeep.sources.files import latest


def profile_template(person: str, day: str) -> str:
    """The file of a person who has none yet. Its headings."""
    head = [f"# {person.title()}", "", "**Trust Tier:** acquaintance", f"**First Contact:** {day}", ""]
    return "\n".join([*head, "## What I Know", "", "## Conversation History", "", "## Notes", ""])


def _put(lines: list[str], section: str, content: str) -> list[str]:
    """content at the end of the section, before the next one; a section that is not there begins at the end of the text."""
    wanted = f"## {section}".lower()
    at = next((i for i, line in enumerate(lines) if line.strip().lower() == wanted), None)
    new = content.split("\n")
    if at is None:
        return [*lines, "", f"## {section}", *new]
    end = next((i for i in range(at + 1, len(lines)) if lines[i].startswith("## ")), len(lines))
    return [*lines[:end], *new, *lines[end:]]


def _section_step() -> Callable:
    def step(lines, kind, section, text, person, day):
        if kind == 0:
            return (text or "").split("\n"), ()
        return _put(profile_template(person or "", day or "").split("\n") if lines is None else lines, section or "", text or ""), ()

    return step


def relationship_files(files: DataFrame, updates: DataFrame) -> DataFrame:
    """name, content of all files (name, content) after updates (person, section, content, ts, id), in the order of (ts, id).

    A file's name is the person's safe name. A person without a file gets the template, with the day of the first update. A file
    is one text, so its updates are one task's work; null sections and contents count as empty.
    """
    old = files.select("name", F.lit(0).alias("_kind"), F.lit(None).cast("timestamp").alias("_ts"), F.lit(None).cast("long").alias("_id"), F.lit(None).cast("string").alias("section"), F.col("content").alias("text"), F.lit(None).cast("string").alias("person"), F.lit(None).cast("string").alias("day"))
    new = updates.select(safe_name(F.coalesce("person", F.lit("")), "unnamed").alias("name"), F.lit(1), F.col("ts").cast("timestamp"), F.col("id").cast("long"), "section", "content", "person", F.date_format("ts", "yyyy-MM-dd"))
    return ordered_fold(old.union(new), ["name"], ["_kind", "_ts", "_id"], ["_kind", "section", "text", "person", "day"], lambda: None, _section_step(), lambda lines: [("\n".join(lines),)], "content string")


def journal_files(entries: DataFrame) -> DataFrame:
    """filename, content of entries (ts, id, topic, content): a day's first file is named by the day, the next ones are numbered from 2."""
    day, nth = F.date_format("ts", "yyyy-MM-dd"), F.row_number().over(Window.partitionBy(F.to_date("ts")).orderBy("ts", "id"))
    rows = entries.withColumns({"_day": day, "_nth": nth, "topic": F.coalesce("topic", F.lit("")), "content": F.coalesce("content", F.lit(""))})
    body = F.concat(F.lit("# Journal: "), "topic", F.lit("\n\n**Date:** "), "_day", F.lit(" "), F.date_format("ts", "HH:mm"), F.lit(" UTC\n**Topic:** "), "topic", F.lit("\n\n---\n\n"), "content", F.lit("\n"))
    return rows.select("id", F.concat("_day", F.when(F.col("_nth") > 1, F.concat(F.lit("_"), F.col("_nth").cast("string"))).otherwise(""), F.lit(".md")).alias("filename"), body.alias("content"))


def skill_files(log: DataFrame) -> DataFrame:
    """name, content, description of a log (name, content, ts, id): the last write of each safe name; the description is its first line that is not blank."""
    rows = latest(log.withColumn("name", safe_name(F.coalesce("name", F.lit("")), "unnamed")), ["name"], ["ts", "id"])
    return rows.select("name", "content", F.regexp_extract("content", r"(?m)^[# \t]*(\S[^\n]*?)[ \t]*$", 1).alias("description"))


def boundary_rows(log: DataFrame) -> DataFrame:
    """category, nth, boundary, added of a log (category, boundary, ts, id): categories without spaces around them, each in the order of writes."""
    rows = log.withColumn("category", F.trim("category"))
    return rows.select("category", F.row_number().over(Window.partitionBy("category").orderBy("ts", "id")).alias("nth"), "boundary", F.date_format("ts", "yyyy-MM-dd").alias("added"))


def contradiction_rows(log: DataFrame) -> DataFrame:
    """id, title, description, added, current_thinking, which is null where nothing was thought."""
    return log.select("id", "title", "description", F.date_format("ts", "yyyy-MM-dd").alias("added"), F.nullif(F.col("current_thinking"), F.lit("")).alias("current_thinking"))


def workspace_list(slots: DataFrame, n: int | None = None) -> DataFrame:
    """person, rank, item of slots (person, nth, item, priority): the strongest first, equal ones in the order of slots; n of each at most."""
    rank = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("priority"), "nth"))
    rows = slots.select("person", rank.alias("rank"), "item")
    return rows if n is None else rows.where(F.col("rank") <= n)


def workspace_find(slots: DataFrame, part: Column) -> DataFrame:
    """person, nth: the first slot whose item holds part, whatever the case; no row where none does."""
    return slots.where(F.contains(F.lower("item"), F.lower(part))).groupBy("person").agg(F.min("nth").alias("nth"))


def workspace_access(slots: DataFrame, accessed: DataFrame, boost: float = 0.15) -> DataFrame:
    """slots after one access of each person's slot (person, nth): it is rehearsed and in focus. A place that is empty changes nothing."""
    rows = slots.join(accessed.select("person", "nth").distinct().withColumn("focus", F.lit(True)), ["person", "nth"], "left").withColumn("focus", F.coalesce("focus", F.lit(False)))
    return rows.withColumns({"priority": F.when(F.col("focus"), F.least(F.lit(1.0), F.col("priority") + boost)).otherwise(F.col("priority")), "age": F.when(F.col("focus"), 0).otherwise(F.col("age"))})


def workspace_clear(slots: DataFrame, people: DataFrame) -> DataFrame:
    """slots without those of people (person); what is cleared leaves no trace."""
    return slots.join(people.select("person").distinct(), "person", "left_anti")
