"""Writers' results by the cases that tables do not hold."""

import datetime as dt

from lorekeep.operators import state, writers

T = dt.datetime(2024, 1, 1, 9, 5)


def test_relationship_files(spark):
    files = spark.createDataFrame([("ann", "# Ann\n##  Notes \nold\n## Other\nx"), ("empty", None)], "name string, content string")
    updates = spark.createDataFrame(
        [("Ann!", "other", "y", T, 2), ("ann", "##", None, T, 3), ("Ann", "NEW", "## Other\nsub", T, 4), ("ann", "other", "z", T, 5), ("Bob Ray", "What I Know", "- a", T, 1), (None, "Notes", "n", T, 1), ("empty", "S", "t", T, 1)],
        "person string, section string, content string, ts timestamp, id long",
    )
    got = {r["name"]: r["content"] for r in writers.relationship_files(files, updates).collect()}
    # a heading is matched whole: "##  Notes" is no "## Notes"; contents that hold headings begin sections of their own
    assert got["ann"] == "# Ann\n##  Notes \nold\n## Other\nx\ny\n\nz\n## ##\n\n\n## NEW\n## Other\nsub"
    assert got["bob_ray"].startswith("# Bob Ray\n\n**Trust Tier:** acquaintance\n**First Contact:** 2024-01-01\n\n## What I Know\n\n- a\n## Conversation History")
    assert got["unnamed"].endswith("## Notes\n\nn") and got["empty"] == "\n\n## S\nt"


def test_journal_files(spark):
    rows = spark.createDataFrame([(T, 1, "a", "x"), (T, 2, None, None), (T + dt.timedelta(days=1), 3, "c", "z")], "ts timestamp, id long, topic string, content string")
    got = {r["id"]: (r["filename"], r["content"]) for r in writers.journal_files(rows).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == ["2024-01-01.md", "2024-01-01_2.md", "2024-01-02.md"]
    assert got[1][1] == "# Journal: a\n\n**Date:** 2024-01-01 09:05 UTC\n**Topic:** a\n\n---\n\nx\n"


def test_skills_and_rows(spark):
    log = spark.createDataFrame([("Bake Bread!", "# first", T, 1), ("bake_bread", "\n\n# second  \nx", T, 2), ("  ", None, T, 3)], "name string, content string, ts timestamp, id long")
    got = {r["name"]: (r["content"], r["description"]) for r in writers.skill_files(log).collect()}
    assert got == {"bake_bread": ("\n\n# second  \nx", "second"), "unnamed": (None, None)}
    rows = spark.createDataFrame([(" Safety ", "a", T, 2), ("Safety", "b", T, 1)], "category string, boundary string, ts timestamp, id long")
    assert [(r["category"], r["nth"], r["boundary"]) for r in writers.boundary_rows(rows).orderBy("nth").collect()] == [("Safety", 1, "b"), ("Safety", 2, "a")]


def test_workspace(spark):
    slots = spark.createDataFrame([("a", 0, "Old Tea", 0.95, 3), ("a", 1, "tea", 0.95, 1), ("b", 0, "x", 0.2, 0)], "person string, nth int, item string, priority double, age int")
    from pyspark.sql import functions as F

    found = writers.workspace_find(slots, F.lit("TEA"))
    assert [tuple(r) for r in found.collect()] == [("a", 0)]
    got = {(r["person"], r["nth"]): (r["priority"], r["age"], r["focus"]) for r in writers.workspace_access(slots, found).collect()}
    assert got == {("a", 0): (1.0, 0, True), ("a", 1): (0.95, 1, False), ("b", 0): (0.2, 0, False)}
    assert [r["item"] for r in writers.workspace_list(slots, 1).orderBy("person").collect()] == ["Old Tea", "x"]
    assert writers.workspace_clear(slots, slots.where("person = 'a'")).count() == 1


def test_traits(spark):
    row = spark.createDataFrame([(0.8, 0.5, 0.8, 0.75, 0.6)], "openness double, conscientiousness double, extraversion double, agreeableness double, neuroticism double")
    names = row.columns
    top, text = row.select(state.dominant_traits(names), state.profile_text()).first()
    assert top == ["openness", "extraversion", "agreeableness"]
    assert text.split("\n")[1] == "- Openness: 0.80  (high = curious, philosophical)" and text.count("Tendency: ") == 3
